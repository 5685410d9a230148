"""Every registered query against its oracle at the smallest scale."""

import importlib.util
import pathlib

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as contract
from hailgrid.operators import baseline, counts, joins, weather
from hailgrid.operators.counts import cell_hour_counts
from hailgrid.plans import catalog
from hailgrid.sources.tables import Tables

spec = importlib.util.spec_from_file_location(
    "check_oracle", pathlib.Path(__file__).resolve().parent.parent / "tools" / "check_oracle.py"
)
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_matches_oracle(spark, con, name):
    assert check.compare(QUERIES[name](spark, SMALL), con, ORACLE[name]).startswith("ok")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(catalog.queries()) <= set(ORACLE)


def test_entry_has_one_row(spark):
    assert contract.entry(spark).count() == 1


def test_known_totals(spark):
    """Figures recorded for these views at scale 0.01 in FIXTURES.md."""
    t = Tables(spark, "/root/testdata/sf0.01")
    counted = cell_hour_counts(t.rides())
    row = counted.agg(F.count("*"), F.sum("count"), F.max("count")).first()
    assert t.rides().count() == 30_157 and tuple(row) == (5_485, 17_982, 25)
    hourly = weather.clean_metar(t.metar())
    bands = hourly.agg(
        F.count("*"), F.count_if(F.col("precip_in") >= 0.3), F.count_if(F.col("precip_in") < 0.1),
        F.count_if(F.col("fahrenheit") < 20), F.count_if(F.col("fahrenheit") > 82),
    ).first()
    assert tuple(bands) == (840, 428, 131, 43, 0)
    assert joins.join_rides_metar(counted, hourly).count() == 6_831
    assert joins.rides_without_weather(counted, hourly).count() == 549
    model = baseline.fit_baseline(counts.scale_counts(counted))
    size, total = model.agg(F.count("*"), F.round(F.sum("mean_count"), 6)).first()
    assert (size, total) == (4_098, 13_316.25)

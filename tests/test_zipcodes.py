import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from hailgrid.operators import zipcodes
from hailgrid.plans import workflows
from hailgrid.sources.tables import Tables

RIDE = "ride_id int, pickup_latitude double, pickup_longitude double"
PLACE = "zip string, lat double, lon double"


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2
    h += math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return round(2 * 6371.0 * math.asin(math.sqrt(h)), 6)


def nearest(lat, lon, places, radius):
    if lat is None or lon is None:
        return "missing"
    found = [(km(lat, lon, a, b), z) for z, a, b in places if km(lat, lon, a, b) <= radius]
    return min(found)[1] if found else "missing"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    places = [(f"{i:05d}", rng.uniform(40.4, 41.1), rng.uniform(-74.2, -73.6)) for i in range(300)]
    # a crowd of centroids in one bucket, exact copies, and one beyond the equator's other side
    places += [(f"9{i:04d}", 40.7 + i * 1e-4, -74.0) for i in range(50)]
    places += [("00000", places[0][1], places[0][2]), ("z", -40.7, -74.0)]
    spots = [(rng.uniform(40.4, 41.1), rng.uniform(-74.2, -73.6)) for _ in range(200)]
    # a third of the rides at one broken position
    rides = [(i, *spot) for i, spot in enumerate(spots + [(0.0, 0.0)] * 100 + [(None, -74.0), (40.7, -74.0)])]
    return rides, places


@pytest.mark.parametrize("radius", [0.5, 1.0, 5.0])
def test_labels_equal_brute_force(spark, rows, data, radius):
    rides, places = data
    want = sorted((i, nearest(a, b, places, radius)) for i, a, b in rides)
    r, p = spark.createDataFrame(rides, RIDE), spark.createDataFrame(places, PLACE)
    for limits in ({}, {"max_broadcast": 0}):
        labelled = zipcodes.label_zip(r, p, radius, **limits)
        assert rows(labelled, "ride_id", "zip") == want
        assert labelled.columns == [*r.columns, "zip"]


def test_labels_stay_in_the_jvm(spark, data):
    rides, places = data
    labelled = zipcodes.label_zip(spark.createDataFrame(rides, RIDE), spark.createDataFrame(places, PLACE), 1.0)
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("radius", [1.0, 300.0])
def test_labels_wrap_around_and_near_the_poles(spark, rows, radius):
    rng = random.Random(8)
    edge = [-180.0, -179.9995, -179.99, 179.99, 179.9995, 180.0]
    places = [(f"{i:04d}", rng.choice([0.0, 60.0, 0.004]), rng.choice(edge)) for i in range(30)]
    spots = [(rng.choice([0.0, 0.003, 60.0, 60.002]), rng.choice(edge)) for _ in range(60)]
    for more in ([], [("pole", 89.999, 10.0), ("south", -89.9995, -170.0)]):
        own = places + more
        at = spots + [(89.9995, -170.0), (-90.0, 0.0)]
        rides = [(i, *x) for i, x in enumerate(at)]
        labelled = zipcodes.label_zip(spark.createDataFrame(rides, RIDE), spark.createDataFrame(own, PLACE), radius)
        assert rows(labelled, "ride_id", "zip") == sorted((i, nearest(a, b, own, radius)) for i, a, b in rides)


def test_rides_are_not_shuffled(spark):
    t = Tables(spark, SMALL)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = zipcodes.label_zip(t.rides(), t.centroids(), 1.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("events.parquet") == 1 and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_no_centroids_and_missing(spark, rows, data):
    rides, _ = data
    r = spark.createDataFrame(rides, RIDE)
    labelled = zipcodes.label_zip(r, spark.createDataFrame([], PLACE), 1.0)
    assert labelled.filter(F.col("zip") == "missing").count() == len(rides)
    assert zipcodes.unexplained_missing(labelled).filter("pickup_latitude = 0").count() == 0
    assert workflows.label_rides(r, spark.createDataFrame([], PLACE), 1.0).count() == 0


def test_lists_are_short_on_the_given_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    places = zipcodes._distinct_places(t.centroids())
    index, levels, entries = zipcodes.build_index(places, *zipcodes._bucket_sizes(41.0, 1.0), 1.0)
    sizes = index.agg(F.avg(F.size("_near")), F.max(F.size("_near")), F.sum(F.size("_near"))).first()
    assert sizes[0] < 5 and sizes[1] <= zipcodes.LEAF + zipcodes.MORE * (len(levels) - 1) and sizes[2] == entries and len(levels) > 1


def test_a_crowd_of_places_builds_no_long_list(spark):
    # 20,000 places within some 300 m, beside others kilometres apart
    crowd = spark.range(20_000).selectExpr(
        "lpad(id, 6, '0') zip", "40.7 + (pmod(xxhash64(id), 1000003) / 1000003) * 0.003 lat", "-74.0 + (pmod(xxhash64(id, 7), 1000003) / 1000003) * 0.004 lon"
    )
    places = crowd.union(spark.range(100).selectExpr("concat('x', id)", "40.5 + id * 0.005", "-74.1 + id * 0.003"))
    index, levels, _ = zipcodes.build_index(places, *zipcodes._bucket_sizes(41.1, 1.0), 1.0)
    assert index.agg(F.max(F.size("_near"))).first()[0] <= zipcodes.LEAF + zipcodes.MORE * (len(levels) - 1) and 3 < len(levels) < 9
    # each place is the nearest one to itself
    held = index.select(F.explode("_near.zip").alias("zip")).distinct().count()
    assert held == 20_100

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hailgrid import clean_metar, clean_precip, clean_temperature, count_rides, counts_by_grid_cell, join_rides_metar
from hailgrid.functions import clock
from hailgrid.operators import counts, joins, weather

T0 = datetime(2014, 1, 6)  # a Monday


def rides(spark, items):
    return spark.createDataFrame(items, "pickup_datetime timestamp_ntz, pickup_longitude double, pickup_latitude double")


def metar(spark, items):
    return spark.createDataFrame(items, "datetime timestamp_ntz, fahrenheit string, precip_in string")


@pytest.fixture(scope="module")
def some_rides(spark):
    at = [(T0 + timedelta(minutes=m), -74.0, 40.7) for m in (0, 59, 60)]
    at += [(T0 + timedelta(minutes=5), -73.7, 40.5), (T0, 0.0, 0.0), (None, -74.0, 40.7)]
    return rides(spark, at)


def test_counts_and_scaling(some_rides, rows):
    got = rows(count_rides(some_rides))
    assert got == [(T0, 4, 32, 2, 1.0), (T0, 30, 55, 1, 0.5), (T0 + timedelta(hours=1), 4, 32, 1, 0.5)]


def test_counts_add_up_to_the_rides_in_the_box(some_rides):
    total = counts.cell_hour_counts(some_rides).agg(F.sum("count")).first()[0]
    timed = some_rides.filter(F.col("pickup_datetime").isNotNull())
    assert total == counts.clean_rides(timed).count() == 4


def test_cell_counts_keep_edge_cells(some_rides, rows):
    assert rows(counts_by_grid_cell(some_rides)) == [(4, 32, 4), (30, 55, 1)]


def test_scaling_by_period(spark, rows):
    df = rides(spark, [(T0, -74.0, 40.7)] * 4 + [(T0, -73.9, 40.7)] * 2 + [(T0 + timedelta(days=40), -74.0, 40.7)] * 2)
    whole = sorted(r.count_scaled for r in count_rides(df).collect())
    by_month = count_rides(df, period=clock.month_floor)
    assert whole == [0.5, 0.5, 1.0]
    assert sorted(r.count_scaled for r in by_month.collect()) == [0.5, 1.0, 1.0]
    assert [r[0] for r in by_month.groupBy("period").agg(F.max("count_scaled")).select(F.max("max(count_scaled)")).collect()] == [1.0]


@pytest.fixture(scope="module")
def some_metar(spark):
    h = timedelta(hours=1)
    m = timedelta(minutes=1)
    return metar(spark, [
        (T0 + 51 * m, "30", "0.10"), (T0 + 51 * m, "M", "0.20"), (T0 + 10 * m, "40", "T"),  # two routine records
        (T0 + h + 51 * m, "-5.0", "T"), (T0 + h + 40 * m, "5", "0.05"), (T0 + h + 20 * m, "6", "0.50"),
        (T0 + 2 * h + 51 * m, "M", "0.00"),  # no temperature
        (T0 - h + 51 * m, "20", "0.00"),  # last record of the day before
        (T0 + 3 * h + 5 * m, "50", ""),  # no precipitation at all
    ])


def test_precipitation(some_metar, rows):
    assert rows(clean_precip(some_metar)) == [
        (T0 - timedelta(hours=1), 0.0), (T0, 0.1), (T0, 0.2), (T0 + timedelta(hours=2), 0.0)]


def test_temperature_keeps_negative_readings(some_metar, rows):
    got = dict(rows(clean_temperature(some_metar)))
    assert got[T0] == 35.0 and got[T0 + timedelta(hours=1)] == 2.0
    assert dict(rows(clean_temperature(some_metar, match="prefix")))[T0 + timedelta(hours=1)] == 5.5


def test_hourly_weather_fans_out(some_metar, rows):
    assert rows(clean_metar(some_metar)) == [(T0 - timedelta(hours=1), 20.0, 0.0), (T0, 35.0, 0.1), (T0, 35.0, 0.2)]


def test_full_join(some_metar, rows):
    got = rows(clean_metar(some_metar, how="full"))
    assert (T0 + timedelta(hours=2), None, 0.0) in got and (T0 + timedelta(hours=3), 50.0, None) in got
    assert len(got) == 6
    with pytest.raises(ValueError):
        clean_metar(some_metar, how="left")


def test_one_record_an_hour_takes_the_nearest_reading(some_metar, rows):
    got = rows(clean_metar(some_metar, dedupe=True))
    assert got == [(T0 - timedelta(hours=1), 20.0, 0.0), (T0, 35.0, 0.1), (T0 + timedelta(hours=1), 2.0, 0.05)]


def test_records_fold_equal_rows(spark, some_metar, rows):
    more = some_metar.union(some_metar)
    folded = weather.weather_records(more)
    assert rows(folded) == [(T0 - timedelta(hours=1), 20.0, 0.0, 2), (T0, 35.0, 0.1, 2), (T0, 35.0, 0.2, 2)]
    assert folded.agg(F.sum("n_records")).first()[0] == clean_metar(more).count()


def test_join_drops_and_audit_counts_the_loss(some_rides, some_metar, rows):
    counted = count_rides(some_rides)
    joined = join_rides_metar(counted, clean_metar(some_metar))
    assert rows(joined, "grid_x", "count", "precip_in", "weekday", "hour") == [
        (4, 2, 0.1, 0, 0), (4, 2, 0.2, 0, 0), (30, 1, 0.1, 0, 0), (30, 1, 0.2, 0, 0)]
    assert "pickup_datetime" not in join_rides_metar(counted, clean_metar(some_metar), keep_time=False).columns
    left = join_rides_metar(counted, clean_metar(some_metar), how="left")
    assert left.filter(F.col("fahrenheit").isNull()).count() == 1
    audit = joins.audit_dropped(counted, clean_metar(some_metar)).first()
    assert tuple(audit) == (4, 3, 1, 3, 2, 1)
    lost = joins.rides_without_weather(counts.clean_rides(some_rides), clean_metar(some_metar))
    assert rows(lost.filter(F.col("pickup_datetime").isNotNull()), "pickup_datetime") == [(T0 + timedelta(hours=1),)]


def test_completeness(some_metar, rows):
    assert rows(weather.completeness(some_metar)) == [("01/05", 1, 1), ("01/06", 8, 4)]
    assert weather.on_days(some_metar, [5]).count() == 1


def test_box_filter_reaches_a_parquet_scan_and_no_python_runs(spark, some_rides, tmp_path):
    path = f"{tmp_path}/rides"
    some_rides.withColumn("fare", F.lit(1.0)).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = count_rides(spark.read.parquet(path))._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "PushedFilters" in line][0]
    assert "GreaterThanOrEqual(pickup_latitude,40.5)" in scan and "LessThanOrEqual(pickup_longitude,-73.7)" in scan
    assert "fare" not in scan.split("ReadSchema")[1]
    assert "Python" not in plan


def _at(*minutes):
    return [datetime(2024, 3, 1) + timedelta(minutes=m) for m in minutes]


def test_nearest_reading_on_either_side(spark):
    rng = random.Random(3)
    times = _at(*[rng.randrange(0, 4000) / 4 for _ in range(300)], 500, 500, 0)
    held = _at(*[rng.randrange(0, 4000) / 4 for _ in range(60)], *[100 + k / 60 for k in range(30)], 2000)
    rides = [(i, t, 1.0) for i, t in enumerate(times)] + [(900, None, 1.0)]
    readings = [(t, float(k % 7), "x") for k, t in enumerate(held + held[:10])] + [(None, 0.0, "x")]
    r = spark.createDataFrame(rides, "ride_id int, pickup_datetime timestamp_ntz, tmpf double")
    w = spark.createDataFrame(readings, "datetime timestamp_ntz, tmpf double, note string")
    for minutes in (1, 7, 60):
        limit = timedelta(minutes=minutes)
        want = []
        for i, t, _ in rides:
            near = [(abs(x - t), x, v) for x, v, _ in readings if x is not None and t is not None and abs(x - t) <= limit]
            want.append((i, *(min(near)[1:] if near else (None, None))))
        got = joins.join_nearest_reading(r, w, minutes)
        assert got.columns == ["ride_id", "pickup_datetime", "tmpf", "datetime", "reading_tmpf", "note"]
        key = lambda x: x[0]
        assert sorted(map(tuple, got.select("ride_id", "datetime", "reading_tmpf").collect()), key=key) == want
        assert joins.join_nearest_reading(r, w, minutes, how="inner").count() == sum(x[1] is not None for x in want)
    assert joins.join_nearest_reading(r, w.filter("false"), 5).filter("datetime IS NULL").count() == len(rides)


def test_missing_stretches_cross_months(spark):
    start = datetime(2024, 1, 30)
    hours = [start + timedelta(hours=h) for h in (0, 1, 1, 2, 5, 6, 60, 61, 2000, 2001)] + [None]
    rows = spark.createDataFrame([(h + timedelta(minutes=51) if h else None,) for h in hours], "datetime timestamp_ntz")
    got = sorted(tuple(r) for r in weather.missing_stretches(rows).collect())
    at = lambda h: start + timedelta(hours=h)
    assert got == [(at(3), at(4), 2), (at(7), at(59), 53), (at(62), at(1999), 1938)]
    assert weather.missing_stretches(rows.limit(1)).count() == 0


def test_nearest_reading_in_a_crowded_bucket_has_no_frame_to_the_end(spark):
    """Many times in one bucket: the next reading comes from a growing frame, not one recomputed to the bucket's end at each row."""
    base = datetime(2024, 1, 1)
    readings = [(base + timedelta(seconds=7 * i), float(i)) for i in range(200)]
    rides = [(i, base + timedelta(seconds=5 * i + 2)) for i in range(300)]
    w = spark.createDataFrame(readings, "datetime timestamp_ntz, fahrenheit double")
    r = spark.createDataFrame(rides, "ride_id long, pickup_datetime timestamp_ntz")
    got = joins.join_nearest_reading(r, w, 10)
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan
    want = {}
    for i, t in rides:
        near = min(readings, key=lambda x: (abs((x[0] - t).total_seconds()), x[0]))
        want[i] = near[1] if abs((near[0] - t).total_seconds()) <= 600 else None
    assert {x.ride_id: x.fahrenheit for x in got.collect()} == want

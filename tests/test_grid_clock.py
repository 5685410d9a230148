from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hailgrid import NYC, GridSpec, clean_rides
from hailgrid.functions import clock, numeric


def points(spark, coords):
    return spark.createDataFrame(coords, "pickup_latitude double, pickup_longitude double")


def test_box_is_inclusive_and_drops_null_and_nan(spark):
    coords = [(41.0, -74.05), (40.5, -73.7), (40.49, -74.0), (40.7, -73.69), (None, -74.0), (40.7, None),
              (0.0, 0.0), (float("nan"), -74.0)]
    assert clean_rides(points(spark, coords)).count() == 2
    flags = [r[0] for r in points(spark, coords).select(NYC.in_box("pickup_latitude", "pickup_longitude")).collect()]
    assert flags == [True, True, False, False, False, False, False, False]


def test_edges_fall_one_past_the_last_cell_unless_clamped(spark):
    df = points(spark, [(41.0, -74.05), (40.5, -73.7)])
    lat, lon = "pickup_latitude", "pickup_longitude"
    got = df.select(NYC.x(lon), NYC.y(lat), NYC.x(lon, True), NYC.y(lat, True), NYC.cell_id(lat, lon)).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0, 0), (30, 55, 29, 54, 30 * 55 + 30)]


def test_cells_truncate_toward_zero_outside_the_box(spark):
    df = points(spark, [(41.0 + 1e-5, -74.05 - 1e-5)])
    assert df.select(NYC.cell_id("pickup_latitude", "pickup_longitude")).first()[0] == 0


def test_cells_equal_plain_arithmetic(spark):
    coords = [(40.5 + i * 0.013, -74.05 + i * 0.009) for i in range(38)]
    df = points(spark, coords).select(
        "pickup_latitude", "pickup_longitude", NYC.coord("pickup_latitude", "pickup_longitude").alias("c")
    )
    for r in df.collect():
        assert r.c.x == int((r.pickup_longitude - NYC.west) / NYC.dx)
        assert r.c.y == int((NYC.north - r.pickup_latitude) / NYC.dy)


def test_centre_lies_in_its_cell(spark):
    ids = spark.range(NYC.n_cells).select(F.col("id").cast("int").alias("cell_id"))
    centres = ids.select("cell_id", NYC.center_lat("cell_id").alias("la"), NYC.center_lon("cell_id").alias("lo"))
    assert centres.filter(NYC.cell_id("la", "lo") != F.col("cell_id")).count() == 0


def test_other_grid(spark):
    grid = GridSpec(north=1.0, south=0.0, east=1.0, west=0.0, nx=2, ny=4)
    df = points(spark, [(0.9, 0.6), (0.1, 0.1)])
    assert [tuple(r) for r in df.select(grid.x("pickup_longitude"), grid.y("pickup_latitude")).collect()] == [
        (1, 0), (0, 3)]


def test_clock_parts(spark):
    # a Monday and a Sunday, and an hour that some zones skip
    times = [datetime(2014, 3, 10, 0, 51), datetime(2014, 3, 9, 2, 30, 5)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = df.select(
        clock.weekday("t"), clock.hour_floor("t"), clock.hour_key("t"), clock.month_day("t"),
        clock.period_label("t"), clock.week_floor("t"), clock.month_floor("t"),
    ).collect()
    assert tuple(got[0]) == (0, datetime(2014, 3, 10), "2014-03-10-00", "03/10", "2014-03",
                             datetime(2014, 3, 10), datetime(2014, 3, 1))
    assert tuple(got[1]) == (6, datetime(2014, 3, 9, 2), "2014-03-09-02", "03/09", "2014-03",
                             datetime(2014, 3, 3), datetime(2014, 3, 1))


def test_clock_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2014, 3, 9, 2, 30),)], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(clock.hour_floor("t"), clock.hour_key("t"), F.hour("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(got) == (datetime(2014, 3, 9, 2), "2014-03-09-02", 2)


def test_text_times_and_keys(spark):
    df = spark.createDataFrame([("2014-01-01 00:51", "2014-01-01  7:00")], "a string, b string")
    row = df.select(clock.parse_time("a", clock.WEATHER_TIME), clock.hour_key_from_text("b")).first()
    assert tuple(row) == (datetime(2014, 1, 1, 0, 51), "2014-01-01-7")
    bad = spark.createDataFrame([("nonsense",)], "a string")
    assert bad.select(clock.parse_time("a", clock.WEATHER_TIME, strict=False)).first()[0] is None
    texts = ["2014", "2014-01-01", "2014-01-01T05:06", "2014-01-01T05:06:07", "2014-13-01 05:06", "2014-01-01 05:06:07", " 2014-01-01 05:06", "", None]
    lenient = spark.createDataFrame([(x,) for x in [*texts, "2014-01-01 05:06"]], "a string")
    got = [r[0] for r in lenient.select(clock.parse_time("a", clock.WEATHER_TIME, strict=False)).collect()]
    assert got[:-1] == [None] * len(texts) and str(got[-1]) == "2014-01-01 05:06:00"
    with pytest.raises(Exception):
        bad.select(clock.parse_time("a", clock.WEATHER_TIME)).collect()


@pytest.mark.parametrize(
    "match,kept",
    [("whole", {"-5.0": -5.0, "12": 12.0, "0.30": 0.3}),
     ("prefix", {"12": 12.0, "0.30": 0.3}),
     ("search", {"-5.0": -5.0, "12": 12.0, "0.30": 0.3})],
)
def test_numeric_text(spark, match, kept):
    texts = ["-5.0", "12", "0.30", "M", "T", "", None, "5x"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.v for r in df.select("s", numeric.parse_numeric("s", match).alias("v")).collect() if r.v is not None}
    assert got == kept


def test_buckets(spark):
    temps = [39.9, 40.0, 54.99, 55.0, 70.0, 85.0, None]
    df = spark.createDataFrame([(t,) for t in temps], "f double")
    assert [r[0] for r in df.select(numeric.bucket_fahrenheit("f")).collect()] == [0, 1, 1, 2, 3, 4, None]
    rain = spark.createDataFrame([(0.0,), (0.1,), (0.29,), (0.3,)], "p double")
    assert [r[0] for r in rain.select(numeric.bucket_precip("p")).collect()] == [0, 1, 1, 2]
    with pytest.raises(Exception, match="negative precipitation"):
        spark.createDataFrame([(-0.1,)], "p double").select(numeric.bucket_precip("p")).collect()

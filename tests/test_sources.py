import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hailgrid.operators import forest
from hailgrid.sources import paths, readers, sinks


def put(folder, name, header, *lines):
    path = os.path.join(str(folder), name)
    with open(path, "w") as f:
        f.write("\n".join([header, *lines]) + "\n")
    return path


@pytest.fixture
def files(tmp_path):
    return [
        put(tmp_path, "yellow_tripdata_2009-03_tiny.csv", "vendor,Trip_Pickup_DateTime,Start_Lon,Start_Lat",
            "a,2009-03-01 01:02:03,-74.0,40.7"),
        put(tmp_path, "yellow_tripdata_2012-05_tiny.csv", "v,pickup_datetime,pickup_longitude,pickup_latitude",
            "a,2012-05-01 01:02:03,-73.9,40.8", "a,2012-05-01 01:02:04,0,0"),
        put(tmp_path, "yellow_tripdata_2014-01_tiny.csv", "v, pickup_datetime, pickup_longitude, pickup_latitude",
            "", "a,2014-01-01 01:02:03,-73.9,40.8"),
        put(tmp_path, "yellow_tripdata_2014-02_tiny.csv", "v, pickup_datetime, pickup_longitude, pickup_latitude",
            "a,2014-02-01 01:02:03,-73.9,40.8", "a,2014-02-01 05:02:03,,40.8", "a,2014-02-01 06:00:00,x,40.8"),
        put(tmp_path, "yellow_tripdata_2016-06_tiny.csv", "v,tpep_pickup_datetime,pickup_longitude,pickup_latitude",
            "a,2016-06-01 01:02:03,-73.9,40.8"),
    ]


def test_all_layouts_in_one_table(spark, rows, files):
    df = readers.read_rides(spark, files)
    assert df.columns == ["pickup_datetime", "pickup_longitude", "pickup_latitude"]
    assert [r[0].year * 100 + r[0].month for r in rows(df)] == [200903, 201205, 201401, 201402, 201606]
    assert readers.read_rides(spark, files, grid=None).count() == 8


def test_one_scan_per_layout(spark, files):
    df = readers.read_rides(spark, files)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4 and "Python" not in plan


def test_period_comes_from_the_file_name(spark, rows, files):
    df = readers.read_rides(spark, files, with_period=True)
    assert rows(df, "year", "month") == [(2009, 3), (2012, 5), (2014, 1), (2014, 2), (2016, 6)]


def test_bad_time_fails_or_becomes_null(spark, tmp_path):
    path = put(tmp_path, "yellow_tripdata_2012-05_tiny.csv", "pickup_datetime,pickup_longitude,pickup_latitude",
               "nonsense,-73.9,40.8")
    with pytest.raises(Exception):
        readers.read_rides(spark, path).collect()
    assert readers.read_rides(spark, path, strict_time=False).first()["pickup_datetime"] is None


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    a = put(tmp_path, "yellow_tripdata_2012-05_tiny.csv", "pickup_datetime,pickup_longitude,pickup_latitude",
            "2012-05-01 01:02:03,-73.9,40.8")
    b = put(tmp_path, "yellow_tripdata_2012-06_tiny.csv", "pickup_latitude,pickup_datetime,pickup_longitude",
            "40.8,2012-06-01 01:02:03,-73.9")
    with pytest.raises(Exception):
        readers.read_rides(spark, [a, b]).collect()


def test_paths_and_periods():
    assert paths.ride_path("/d", 2014, 1, "small") == "/d/yellow_tripdata_2014-01_small.csv"
    assert paths.ride_path("/d/", 2014, 1, "full") == "/d/yellow_tripdata_2014-01.csv"
    assert paths.weather_path("/d", 2014, 11) == "/d/lga_2014-11.csv"
    for call in (
        lambda: paths.ride_path("/d", 2014, 1, "huge"),
        lambda: paths.layout_of(2016, 7),
        lambda: paths.layout_of(2017, 1),
        lambda: paths.check_period(2008, 1),
        lambda: paths.check_period(2014, 13),
        lambda: paths.period_of("/d/rides.csv"),
    ):
        with pytest.raises(ValueError):
            call()
    assert [paths.layout_of(y, 6) for y in (2009, 2010, 2013, 2014, 2015, 2016)] == [
        "2009", "2010-2013", "2010-2013", "2014", "2015-2016", "2015-2016"]


def test_weather_files(spark, rows, tmp_path):
    path = put(tmp_path, "lga_2014-01.csv", "station,valid,tmpf, p01i", "LGA,2014-01-01 00:51,M,0.00",
               "LGA,2013-12-31 23:51,-5.0,T")
    df = readers.read_metar(spark, path)
    assert rows(df) == [(datetime(2013, 12, 31, 23, 51), "-5.0", "T"), (datetime(2014, 1, 1, 0, 51), "M", "0.00")]
    other = put(tmp_path, "hourly.csv", "station,valid,precip_in", "NYC,2014-05-01 03:00,0.02")
    assert rows(readers.read_hourly_precip(spark, other)) == [("2014-05-01-03", 0.02)]


def test_a_year_at_once(spark, tmp_path):
    for m in range(1, 13):
        put(tmp_path, f"lga_2014-{m:02d}.csv", "valid,tmpf, p01i", f"2014-{m:02d}-01 00:51,30,0.00")
        put(tmp_path, f"yellow_tripdata_2014-{m:02d}_tiny.csv", " pickup_datetime, pickup_longitude, pickup_latitude",
            f"2014-{m:02d}-01 00:10:00,-73.9,40.8")
    assert readers.read_metar_year(spark, str(tmp_path), 2014).count() == 12
    assert readers.read_rides_year(spark, str(tmp_path), 2014, "tiny").count() == 12


def test_header_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a b ", " c"])
    assert readers.strip_names(df).columns == ["a b", "c"]
    assert readers.strip_names(df, everywhere=True).columns == ["ab", "c"]


def test_csv_and_partitioned_sinks(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2014, 1, 5), 1), (datetime(2014, 2, 5), 2)], "pickup_datetime timestamp_ntz, n int")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert readers.read_csv(spark, f"{tmp_path}/csv").count() == 2
    sinks.write_by_period(df, f"{tmp_path}/parts")
    again = spark.read.parquet(f"{tmp_path}/parts").filter((F.col("year") == 2014) & (F.col("month") == 2))
    assert [r.n for r in again.collect()] == [2]
    assert "PartitionFilters: [isnotnull(year" in again._jdf.queryExecution().toString()


def test_splits_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "n int, split string")
    sinks.write_splits(df, f"{tmp_path}/splits")
    assert [r.n for r in sinks.read_split(spark, f"{tmp_path}/splits", "test").collect()] == [2]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_splits(df, f"{tmp_path}/splits")


def test_report_and_model_round_trip(spark, tmp_path):
    data = spark.createDataFrame(
        [(x % 5, x % 7, x % 7, x % 24, 30.0 + x % 9, 0.1 * (x % 4), (x % 10) / 10.0) for x in range(120)],
        "grid_x int, grid_y int, weekday int, hour int, fahrenheit double, precip_in double, count_scaled double",
    )
    model, scored = forest.fit_once(data, data, "2")
    sinks.save_model(model, f"{tmp_path}/model")
    again = sinks.load_model(f"{tmp_path}/model")
    want = [r.prediction for r in scored.collect()]
    assert [r.prediction for r in again.transform(data).collect()] == want
    assert any("numTrees" in p for p in forest.stage_params(again).values())
    stats = spark.createDataFrame([(5, 10, 1, 0.25)], "num_trees int, max_depth int, min_instances int, cv_rmse double")
    sinks.write_report(stats, f"{tmp_path}/report", "2014-01 tiny", 12, 0.5)
    row = sinks.read_report(spark, f"{tmp_path}/report").first()
    assert (row.description, row.num_trees, row.cv_rmse, row.test_rmse, row.seconds) == ("2014-01 tiny", 5, 0.25, 0.5, 12.0)


def test_driver_rows_are_checked(spark):
    assert len(sinks.to_driver(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        sinks.to_driver(spark.range(6), 5)


def test_rides_come_back_by_period(spark, tmp_path):
    rows = [(datetime(2013, 12, 5), -74.0, 40.7), (datetime(2014, 1, 5), -74.0, 40.7), (datetime(2014, 2, 5), -73.9, 40.8), (datetime(2014, 2, 6), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz, pickup_longitude double, pickup_latitude double")
    sinks.write_by_period(df, f"{tmp_path}/rides")
    got = readers.read_rides_parquet(spark, f"{tmp_path}/rides", (2014, 1), (2014, 2))
    assert sorted((r.year, r.month) for r in got.collect()) == [(2014, 1), (2014, 2)]
    assert readers.read_rides_parquet(spark, f"{tmp_path}/rides", (2013, 12), (2014, 1), grid=None).count() == 2
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(pickup_latitude" in plan


def test_column_types_over_several_files(spark, tmp_path):
    header = "flag,n,x,day,at,mixed,big,code,none,exact"
    one = put(tmp_path, "a.csv", header, "true,1,1.5,2014-01-02,2014-01-02 03:04:05,7,9223372036854775808,-3,,12345678901234567")
    two = put(tmp_path, "b.csv", header, "FALSE,-20,3,2014-02-03,2014-01-02,seven,1,,,0.5", ",,1e-3,,2014-01-02T03:04,,,+4,,")
    df = readers.read_typed_csv(spark, [one, two])
    assert dict(df.dtypes) == {
        "flag": "boolean", "n": "bigint", "x": "double", "day": "date", "at": "timestamp_ntz", "mixed": "string", "big": "string",
        "code": "bigint", "none": "string", "exact": "string"}
    got = sorted(df.select("n", "x", "mixed", "code").collect(), key=lambda r: r.x)
    assert [tuple(r) for r in got] == [(None, 0.001, None, 4), (1, 1.5, "7", -3), (-20, 3.0, "seven", None)]
    assert dict(readers.read_typed_csv(spark, one, ["mixed", "x"]).dtypes) == {"mixed": "bigint", "x": "double"}
    assert readers.read_typed_csv(spark, put(tmp_path, "c.csv", "a,b")).dtypes == [("a", "string"), ("b", "string")]


def test_column_types_take_one_pass(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b", "1,x", "2,y")
    plan = readers.column_types(readers.read_csv(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_rejected_rows_are_kept_beside_the_rides(spark, rows, tmp_path):
    files = [
        put(tmp_path, "yellow_tripdata_2012-05_tiny.csv", "v,pickup_datetime,pickup_longitude,pickup_latitude",
            "a,2012-05-01 01:02:03,-73.9,40.8", "a,2012-05-01 25:02:03,-73.9,40.8", "a,2012-05-01 01:02:03,west,40.8", "a,2012-05-01 01:02:03",
            '"a,b",2012-05-01 01:02:03,-73.9,4O.8', "a,2012-05-01 01:02:03,,", "a,2012-05-01 01:02:03,-73.9,40.8,extra", '"x'),
        put(tmp_path, "yellow_tripdata_2014-01_tiny.csv", "v, pickup_datetime, pickup_longitude, pickup_latitude",
            "", "a,2014-01-01 01:02:03,-73.9,40.8", "a,nonsense,-73.9,40.8,,"),
    ]
    kept, rejected = readers.read_rides_checked(spark, files, grid=None)
    assert kept.count() == 4 and rejected.count() == 6
    got = {(os.path.basename(r.file), r.reason) for r in rejected.collect()}
    early, late = (os.path.basename(f) for f in files)
    assert got == {(early, "pickup time"), (early, "longitude"), (early, "latitude"), (early, "the row ends too early"), (late, "pickup time")}
    assert {r.line for r in rejected.filter("reason = 'pickup time'").collect()} == {"a,2012-05-01 25:02:03,-73.9,40.8", "a,nonsense,-73.9,40.8,,"}
    inside, _ = readers.read_rides_checked(spark, files)
    assert rows(inside) == rows(readers.read_rides(spark, files, with_period=True, strict_time=False).filter("pickup_datetime is not null"))
    assert rows(inside, "year", "month") == [(2012, 5), (2012, 5), (2014, 1)]
    nothing = readers.read_rides_checked(spark, [put(tmp_path, "yellow_tripdata_2012-06_tiny.csv", "pickup_datetime,pickup_longitude,pickup_latitude")])
    assert [df.count() for df in nothing] == [0, 0]

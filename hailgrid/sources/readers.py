"""CSV scans of rides and weather: one scan per column layout, not one per month."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hailgrid.functions import clock
from hailgrid.functions.grid import NYC, GridSpec
from hailgrid.operators.counts import clean_rides
from hailgrid.session import written
from hailgrid.sources import paths as P

# Texts that are whole numbers, numbers, dates and times to the column types.
WHOLE_NUMBER = r"^[+-]?\d+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"


def read_csv(spark: SparkSession, paths: str | list[str], columns: Iterable[str] | None = None) -> DataFrame:
    """Header CSV as text columns, without an inference pass over the data.

    Names come from the first file's header; every other file's header is
    checked against it, so a file with another column order fails instead of
    being misread.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("header", True).csv(files[0]).schema
    df = spark.read.schema(header).option("header", True).option("enforceSchema", False).csv(files)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def column_types(text: DataFrame) -> DataFrame:
    """One row: for every text column the narrowest type that holds all its values, by one aggregate over the rows.

    The types, narrowest first: ``boolean`` (true, false), ``bigint``, ``double``, ``date`` (yyyy-MM-dd), ``timestamp_ntz``
    (a date or a date with a time) and ``string``. A whole number that a long can't hold is text, and so is a column in which one of over
    15 digits stands among fractions, as a double would change it. A column of nulls alone is text.
    """
    def fits(c: Column) -> list[tuple[str, Column]]:
        whole = c.rlike(WHOLE_NUMBER) & c.try_cast("bigint").isNotNull()
        exact = (F.length(F.regexp_replace(c, r"^[+-]?0*", "")) <= 15) | ~c.rlike(WHOLE_NUMBER)
        day = c.rlike(DAY) & c.try_cast("date").isNotNull()
        moment = c.rlike(MOMENT) & c.try_cast("timestamp_ntz").isNotNull()
        return [
            ("boolean", F.lower(c).isin("true", "false")),
            ("bigint", whole),
            ("double", c.rlike(NUMBER) & exact),
            ("date", day),
            ("timestamp_ntz", day | moment),
        ]

    narrowest = []
    for name in text.columns:
        c = F.col(f"`{name}`")
        choice = F.when(F.count(c) == 0, "string")
        for kind, holds in fits(c):
            choice = choice.when(F.every(c.isNull() | holds), kind)
        narrowest.append(choice.otherwise("string").alias(name))
    return text.agg(*narrowest)


def read_typed_csv(spark: SparkSession, paths: str | list[str], columns: Iterable[str] | None = None) -> DataFrame:
    """Header CSV with each column in the narrowest type that holds its values in all the files.

    The types are found in one pass over the needed columns when this is called, and applied to the text as it is read. A column that is a number
    in one file and text in another is text in both.
    """
    text = read_csv(spark, paths, columns)
    types = column_types(text).first()
    return text.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in text.columns])


def strip_names(df: DataFrame, everywhere: bool = False) -> DataFrame:
    """Trim column names, or remove every space in them."""
    return df.toDF(*[c.replace(" ", "") if everywhere else c.strip() for c in df.columns])


def source_period() -> tuple[Column, Column]:
    """(year, month) columns parsed from the name of the file a row came from."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return (
        F.regexp_extract(name, P.PERIOD_IN_NAME, 1).cast("int"),
        F.regexp_extract(name, P.PERIOD_IN_NAME, 2).cast("int"),
    )


def read_rides(
    spark: SparkSession,
    files: str | list[str],
    grid: GridSpec | None = NYC,
    with_period: bool = False,
    strict_time: bool = True,
) -> DataFrame:
    """Rides of any supported months as (pickup_datetime, pickup_longitude,
    pickup_latitude), kept to the grid's box (``grid=None`` keeps all)."""
    by_layout: dict[str, list[str]] = defaultdict(list)
    for path in [files] if isinstance(files, str) else files:
        by_layout[P.layout_of(*P.period_of(path))].append(path)

    scans = []
    for layout, group in sorted(by_layout.items()):
        when, lon, lat = P.LAYOUTS[layout]
        raw = read_csv(spark, group)
        year, month = source_period()
        columns = [
            clock.parse_time(F.col(f"`{when}`"), clock.RIDE_TIME, strict_time).alias("pickup_datetime"),
            F.col(f"`{lon}`").try_cast("double").alias("pickup_longitude"),
            F.col(f"`{lat}`").try_cast("double").alias("pickup_latitude"),
        ]
        if with_period:
            columns += [year.alias("year"), month.alias("month")]
        scans.append(raw.select(*columns))
    rides = reduce(DataFrame.unionByName, scans)
    return clean_rides(rides, grid) if grid is not None else rides


def read_rides_checked(
    spark: SparkSession, files: str | list[str], grid: GridSpec | None = NYC
) -> tuple[DataFrame, DataFrame]:
    """Rides as ``read_rides`` gives them with their year and month, and the rows that can't be read: (file, line, reason).

    Both are written in one pass when this is called, as two parts of one table. A row is rejected if it ends before a needed
    column, if its pickup time is not in the format or no time, or if a coordinate is neither empty nor a number; ``reason`` names
    the first of these. Empty times and coordinates are kept as nulls, and further columns at a row's end are no fault. With ``grid=None``
    kept and rejected rows together are the rows of the files; else those outside the box go from the kept ones.
    """
    by_layout: dict[str, list[str]] = defaultdict(list)
    for path in [files] if isinstance(files, str) else files:
        by_layout[P.layout_of(*P.period_of(path))].append(path)
    scans = [_checked_layout(spark, group, P.LAYOUTS[layout]) for layout, group in sorted(by_layout.items())]
    rows = reduce(DataFrame.unionByName, scans)
    both, _ = written(rows.withColumn("rejected", F.col("reason").isNotNull()), ["rejected"])
    kept = both.filter("not rejected").select("pickup_datetime", "pickup_longitude", "pickup_latitude", "year", "month")
    return clean_rides(kept, grid) if grid is not None else kept, both.filter("rejected").select("file", "line", "reason")


def _checked_layout(spark: SparkSession, files: list[str], names: tuple[str, str, str]) -> DataFrame:
    """Rows of one layout with what is wrong with each; ``line`` holds the text of a row that is rejected."""
    header = spark.read.option("header", True).csv(files[0]).columns
    # every field is parsed here, so that a row of another length shows and keeps its line
    schema = StructType([StructField(c, StringType()) for c in [*header, "_line"]])
    text = spark.read.schema(schema).options(header=True, enforceSchema=False, columnPruning=False, columnNameOfCorruptRecord="_line").csv(files)
    when, lon, lat = (F.col(f"`{n}`") for n in names)
    last = max(header.index(n) for n in names)
    time = clock.parse_time(when, clock.RIDE_TIME, strict=False)
    # commas within quotes only add to the count, so no whole row is taken for a short one
    short = F.size(F.split("_line", ",", -1)) <= last
    bad = F.when(short, "the row ends too early").when(when.isNotNull() & time.isNull(), "pickup time")
    for column, name in ((lon, "longitude"), (lat, "latitude")):
        bad = bad.when(column.isNotNull() & column.try_cast("double").isNull(), name)
    year, month = source_period()
    fields = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in header])
    return text.select(
        time.alias("pickup_datetime"),
        lon.try_cast("double").alias("pickup_longitude"),
        lat.try_cast("double").alias("pickup_latitude"),
        year.alias("year"),
        month.alias("month"),
        bad.alias("reason"),
        F.when(bad.isNotNull(), F.col("_metadata.file_path")).alias("file"),
        F.when(bad.isNotNull(), F.coalesce("_line", fields)).alias("line"),
    )


def read_rides_parquet(spark: SparkSession, path: str, first: tuple[int, int], last: tuple[int, int], grid: GridSpec | None = NYC) -> DataFrame:
    """Rides of the (year, month) periods ``first`` to ``last`` from a table that ``sinks.write_by_period`` has
    written; other periods' folders are not read, and the grid's box is pushed to the files."""
    (y0, m0), (y1, m1) = P.check_period(*first), P.check_period(*last)
    year, month = F.col("year"), F.col("month")
    from_first = (year > y0) | ((year == y0) & (month >= m0))
    to_last = (year < y1) | ((year == y1) & (month <= m1))
    rides = spark.read.parquet(path).filter(year.between(y0, y1) & from_first & to_last)
    rides = rides.select("pickup_datetime", "pickup_longitude", "pickup_latitude", "year", "month")
    return clean_rides(rides, grid) if grid is not None else rides


def read_metar(spark: SparkSession, files: str | list[str], strict_time: bool = True) -> DataFrame:
    """Raw station weather as (datetime, fahrenheit, precip_in), values still text."""
    raw = read_csv(spark, files, P.WEATHER_COLUMNS)
    renamed = raw.withColumnsRenamed(P.WEATHER_COLUMNS)
    return renamed.withColumn("datetime", clock.parse_time("datetime", clock.WEATHER_TIME, strict_time))


def read_hourly_precip(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """The alternative hourly precipitation file, keyed by hour text."""
    raw = read_csv(spark, files, ["valid", "precip_in"])
    return raw.select(
        clock.hour_key_from_text("valid").alias("date"),
        F.col("precip_in").try_cast("double").alias("precip_in"),
    )


def read_rides_year(spark: SparkSession, base: str, year: int, size: str = "full", **options) -> DataFrame:
    return read_rides(spark, [P.ride_path(base, year, m, size) for m in range(1, 13)], **options)


def read_metar_year(spark: SparkSession, base: str, year: int) -> DataFrame:
    return read_metar(spark, [P.weather_path(base, year, m) for m in range(1, 13)])

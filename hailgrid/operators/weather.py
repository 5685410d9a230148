"""Station observations to hourly weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.functions import clock, numeric

# Fixed value: the minute at which the station files its hourly precipitation.
ROUTINE_MINUTE = 51


def filter_numerical(df: DataFrame, name: str, match: str = "whole", drop_nulls: bool = True) -> DataFrame:
    """Parse a text column to double; rows that are not numbers go away."""
    parsed = df.withColumn(name, numeric.parse_numeric(name, match))
    return parsed.filter(F.col(name).isNotNull()) if drop_nulls else parsed


def clean_precip(metar: DataFrame, match: str = "whole") -> DataFrame:
    """Precipitation at the routine minute, keyed by hour; several records an hour stay several."""
    rows = metar.select("datetime", "precip_in").filter(F.minute("datetime") == ROUTINE_MINUTE)
    return filter_numerical(rows, "precip_in", match).withColumn("datetime", clock.hour_floor("datetime"))


def one_per_hour(metar: DataFrame, match: str = "whole") -> DataFrame:
    """Per hour the mean temperature and the precipitation reading nearest the
    routine minute, either null if the hour has none.

    The nearest reading is a minimum over a struct, so a crowded hour is reduced
    before the shuffle and no task sorts it.
    """
    amount = numeric.parse_numeric("precip_in", match)
    off = F.abs(F.minute("datetime") - ROUTINE_MINUTE)
    nearest = F.min(F.when(amount.isNotNull(), F.struct(off.alias("off"), F.col("datetime"), amount.alias("precip_in"))))
    return metar.groupBy(clock.hour_floor("datetime").alias("hour")).agg(
        F.avg(numeric.parse_numeric("fahrenheit", match)).alias("fahrenheit"), nearest.alias("_nearest")
    ).select(F.col("hour").alias("datetime"), "fahrenheit", F.col("_nearest.precip_in").alias("precip_in"))


def clean_temperature(metar: DataFrame, match: str = "whole") -> DataFrame:
    """Mean temperature per hour."""
    rows = filter_numerical(metar.select("datetime", "fahrenheit"), "fahrenheit", match)
    return rows.groupBy(clock.hour_floor("datetime").alias("datetime")).agg(F.avg("fahrenheit").alias("fahrenheit"))


def clean_metar(metar: DataFrame, dedupe: bool = False, how: str = "inner", match: str = "whole") -> DataFrame:
    """Hourly weather: one row per precipitation record with the hour's mean temperature.

    ``dedupe`` gives one row per hour instead. ``how`` is ``inner`` or ``full``.
    """
    if how not in ("inner", "full"):
        raise ValueError("how must be 'inner' or 'full'")
    if dedupe:
        hours = one_per_hour(metar, match)
        if how == "inner":
            return hours.filter(F.col("fahrenheit").isNotNull() & F.col("precip_in").isNotNull())
        return hours.filter(F.col("fahrenheit").isNotNull() | F.col("precip_in").isNotNull())
    return clean_temperature(metar, match).join(clean_precip(metar, match), "datetime", how)


def weather_records(metar: DataFrame, match: str = "whole") -> DataFrame:
    """``clean_metar`` with equal rows folded: (datetime, fahrenheit, precip_in, n_records).

    Sums and means over the ride-weather join weight by ``n_records``. Its size
    follows the hours and distinct readings, not the number of observations, so
    an hour with very many records stays small. Both sides of the join come out
    of one scan: readings are summed per (hour, routine reading or none), and
    the hour's temperature is then a window over those few rows.
    """
    routine = F.when(F.minute("datetime") == ROUTINE_MINUTE, numeric.parse_numeric("precip_in", match))
    degrees = numeric.parse_numeric("fahrenheit", match)
    readings = (
        metar.select(clock.hour_floor("datetime").alias("datetime"), routine.alias("precip_in"), degrees.alias("_f"))
        .groupBy("datetime", "precip_in")
        .agg(F.count("*").alias("n_records"), F.sum("_f").alias("_sum"), F.count("_f").alias("_n"))
    )
    hour = Window.partitionBy("datetime")
    mean = F.sum("_sum").over(hour) / F.nullif(F.sum("_n").over(hour), F.lit(0))
    rows = readings.withColumn("fahrenheit", mean).filter(
        F.col("precip_in").isNotNull() & F.col("fahrenheit").isNotNull() & F.col("datetime").isNotNull()
    )
    return rows.select("datetime", "fahrenheit", "precip_in", "n_records")


def fold_records(records: DataFrame, *features: str) -> DataFrame:
    """Records of an hour that agree on ``features`` become one, with their number."""
    return records.groupBy("datetime", *features).agg(F.sum("n_records").alias("n_records"))


def completeness(metar: DataFrame) -> DataFrame:
    """Records per day and how many were filed at the routine minute."""
    return metar.groupBy(clock.month_day("datetime").alias("month_day")).agg(
        F.count("*").alias("n_records"),
        F.count_if(F.minute("datetime") == ROUTINE_MINUTE).alias("n_routine"),
    )


def on_days(metar: DataFrame, days: list[int]) -> DataFrame:
    """Records of the given days of the month, for looking at gaps."""
    return metar.filter(F.dayofmonth("datetime").isin(days))


def missing_stretches(hours: DataFrame, at: str = "datetime") -> DataFrame:
    """Runs of hours without a row between the first and the last one: (first_hour, last_hour, n_hours).

    Hours are put in order within their month; a month's last hour is then joined to the first one of the next month that
    has any, so no task orders more than a month of hours or the list of months.
    """
    present = hours.select(clock.hour_floor(at).alias("hour")).filter(F.col("hour").isNotNull()).distinct()
    present = present.withColumn("month", F.date_format("hour", "yyyy-MM"))
    within = present.withColumn("next", F.lead("hour").over(Window.partitionBy("month").orderBy("hour")))
    months = present.groupBy("month").agg(F.min("hour").alias("first"), F.max("hour").alias("hour"))
    # One row for each month.
    across = months.withColumn("next", F.lead("first").over(Window.orderBy("first"))).select("hour", "month", "next")
    hour = F.expr("INTERVAL 1 HOUR")
    steps = within.filter(F.col("next").isNotNull()).unionByName(across.filter(F.col("next").isNotNull()))
    gaps = steps.filter(F.col("next") > F.col("hour") + hour)
    length = ((clock.micros("next") - clock.micros("hour")) / 3_600_000_000).cast("long") - 1
    return gaps.select((F.col("hour") + hour).alias("first_hour"), (F.col("next") - hour).alias("last_hour"), length.alias("n_hours"))

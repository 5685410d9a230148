"""Joining counts to weather, and what that join loses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.functions import clock


def join_rides_metar(counts: DataFrame, weather: DataFrame, how: str = "inner", keep_time: bool = True) -> DataFrame:
    """Counts with the weather of their hour, plus weekday and hour.

    The inner form drops hours without weather; ``how='left'`` keeps them.
    """
    joined = counts.join(weather, F.col("pickup_datetime") == F.col("datetime"), how).drop("datetime")
    out = clock.with_weekday_hour(joined)
    return out if keep_time else out.drop("pickup_datetime")


def weather_hours(weather: DataFrame) -> DataFrame:
    return weather.select(F.col("datetime").alias("weather_hour")).distinct()


def rides_without_weather(rides: DataFrame, weather: DataFrame) -> DataFrame:
    """Rides (or counts) whose hour has no weather row."""
    hours = weather_hours(weather)
    return rides.join(hours, clock.hour_floor("pickup_datetime") == F.col("weather_hour"), "left_anti")


def audit_dropped(counts: DataFrame, weather: DataFrame) -> DataFrame:
    """One row: rides and cell-hours in total, kept and dropped by the inner join."""
    per_hour = counts.groupBy("pickup_datetime").agg(
        F.sum("count").alias("rides"), F.count("*").alias("cell_hours")
    )
    flagged = per_hour.join(
        weather_hours(weather), F.col("pickup_datetime") == F.col("weather_hour"), "left"
    ).withColumn("kept", F.col("weather_hour").isNotNull())
    columns = []
    for unit in ("rides", "cell_hours"):
        total = F.coalesce(F.sum(unit), F.lit(0))
        kept = F.coalesce(F.sum(F.when(F.col("kept"), F.col(unit))), F.lit(0))
        columns += [total.alias(unit), kept.alias(f"{unit}_kept"), (total - kept).alias(f"{unit}_dropped")]
    return flagged.agg(*columns)


def join_nearest_reading(
    rides: DataFrame, readings: DataFrame, minutes: int, how: str = "left", when: str = "pickup_datetime", at: str = "datetime"
) -> DataFrame:
    """Rides with the reading nearest in time, before or after, at most ``minutes`` away; ties go to the earlier one.

    The readings' columns are added, ``at`` included; those that clash with a ride's get the prefix ``reading_``. Of several readings at one time the
    smallest in the order of their columns is taken. ``how='left'`` keeps rides without one, with nulls; ``'inner'`` drops them, as
    rides without a time. Distinct times of rides and readings are merged in order within buckets as wide as the tolerance, each with the last reading
    of the bucket before it and the first of the one after, so a crowded hour is as many rows as it has distinct times, and
    no task orders more than a bucket. The rides then meet one row for their time.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    width = minutes * 60_000_000
    others = [c for c in readings.columns if c != at]
    names = {c: f"reading_{c}" if c in rides.columns else c for c in (at, *others)}
    bucket = F.floor(F.col("_t") / width).cast("long")

    found = readings.filter(F.col(at).isNotNull()).withColumn("_t", clock.micros(at))
    found = found.groupBy("_t").agg(F.min(F.struct(at, *others)).alias("_reading")).withColumn("_b", bucket)
    ends = found.groupBy("_b").agg(F.min(F.struct("_t", "_reading")).alias("_first"), F.max_by(F.struct("_t", "_reading"), "_t").alias("_last"))
    edges = [ends.select((F.col("_b") + step).alias("_b"), f"{name}.*") for step, name in ((1, "_last"), (-1, "_first"))]
    held = found.select("_b", "_t", "_reading")
    for edge in edges:
        held = held.unionByName(edge)
    asked = rides.filter(F.col(when).isNotNull()).select(clock.micros(when).alias("_t")).distinct().withColumn("_b", bucket)

    rows = held.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    near = F.when(~F.col("_asked"), F.struct("_t", "_reading"))
    # Readings come before rides at the same time, so the earlier side takes an equal one. (_t, _asked) is unique in a bucket,
    # so the next reading is the last one of the reversed order: a growing frame, where one to the end is recomputed at each row.
    order = Window.partitionBy("_b").orderBy("_t", "_asked")
    reverse = Window.partitionBy("_b").orderBy(F.col("_t").desc(), F.col("_asked").desc())
    sides = rows.withColumns(
        {
            "_before": F.last(near, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.last(near, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("_asked")
    back, on = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    pick = F.when(back.isNotNull() & (back <= width) & (on.isNull() | (back <= on)), F.col("_before._reading"))
    pick = pick.when(on <= width, F.col("_after._reading"))
    nearest = sides.select(F.col("_t").alias("_at"), pick.alias("_nearest")).filter(F.col("_nearest").isNotNull())

    joined = rides.withColumn("_t", clock.micros(when)).join(nearest, F.col("_t") == F.col("_at"), how)
    return joined.select(*[F.col(c) for c in rides.columns], *[F.col(f"_nearest.{c}").alias(n) for c, n in names.items()])

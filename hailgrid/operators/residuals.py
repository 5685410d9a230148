"""Where a model errs: thresholds, rain, temperature, area and feature splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.functions import numeric
from hailgrid.operators import explore, metrics
from hailgrid.operators.baseline import HEAVY_RAIN, MODERATE_RAIN

# Thresholds of the residual study.
UNDER_SHARE = 1 / 2
OVER_COUNT_BELOW = 20
OVER_RESIDUAL_ABOVE = 10
WELL_WITHIN = 1
LARGE_ABOVE = 20
COLD_BELOW = 20.0
HOT_ABOVE = 82.0


def is_under(share: float = UNDER_SHARE) -> Column:
    return F.col("residual") < F.lit(-share) * F.col("count")


def is_over(residual_above: float = OVER_RESIDUAL_ABOVE, count_below: float = OVER_COUNT_BELOW) -> Column:
    return (F.col("count") < count_below) & (F.col("residual") > residual_above)


def is_well(within: float = WELL_WITHIN) -> Column:
    return F.abs("residual") <= within


def is_large(above: float = LARGE_ABOVE) -> Column:
    return F.col("residual") > above


def weekday_hour_sizes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (hour, weekday), weekdays as columns."""
    sizes = rows.groupBy(*by, "hour", "weekday").agg(F.count("*").alias("n_rows"))
    return explore.matrix(sizes, [*by, "hour"], "weekday", range(7), "n_rows", "weekday_")


def cell_sizes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per cell: the table behind a scatter of cells."""
    return rows.groupBy(*by, "grid_x", "grid_y").agg(F.count("*").alias("n_rows"))


def flag_weather(rows: DataFrame, cold_below: float = COLD_BELOW, hot_above: float = HOT_ABOVE) -> DataFrame:
    rain = F.col("precip_in")
    return rows.withColumns(
        {
            "heavy_rain": rain >= HEAVY_RAIN,
            "moderate_rain": (rain >= MODERATE_RAIN) & (rain < HEAVY_RAIN),
            "cold": F.col("fahrenheit") < cold_below,
            "hot": F.col("fahrenheit") > hot_above,
        }
    )


def compare_sides(rows: DataFrame, flags: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Residual size, mean, deviation, min and max on both sides of each flag, in one pass.

    Every flag is unfolded into (flag, side) pairs before the aggregate; the
    unfolding is by the number of flags, and the sums are partial per task.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("side")) for f in flags])
    long = rows.withColumn("_pair", F.explode(pairs)).select(
        *by, "_pair.flag", "_pair.side", "residual", *([weight] if weight else [])
    )
    if weight is None:
        return long.groupBy(*by, "flag", "side").agg(*metrics.summary("residual"))
    w, v = F.col(weight), F.col("residual")
    n, total, squares = F.sum(w), F.sum(w * v), F.sum(w * v * v)
    return long.groupBy(*by, "flag", "side").agg(
        n.alias("n"),
        (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1))).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def by_feature(rows: DataFrame, values: Sequence[str], bins: Mapping[str, int]) -> DataFrame:
    """Residual by the value of each feature in ``values`` and by the equal-width
    bin of each feature in ``bins``: (feature, at, n, mean_residual, mean_abs).

    The ends of the bins come from one aggregate and all features are summed in
    one pass over the rows.
    """
    ranges = [F.struct(F.min(f).cast("double").alias("lo"), F.max(f).cast("double").alias("hi")).alias(f) for f in bins]
    # the residual's sum rides along so that this aggregate reads the same shuffle as the rows
    ends = rows.agg(F.struct(*ranges, F.sum("residual").alias("_sum")).alias("ends")).scalar()
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("at")) for f in values]
    for f, n in bins.items():
        place = numeric.right_closed_bin(f, F.col("_ends")[f]["lo"], F.col("_ends")[f]["hi"], n)
        pairs.append(F.struct(F.lit(f).alias("feature"), place.cast("double").alias("at")))
    long = rows.withColumn("_ends", ends).withColumn("_pair", F.explode(F.array(*pairs)))
    return long.groupBy("_pair.feature", "_pair.at").agg(
        F.count("*").alias("n"), F.avg("residual").alias("mean_residual"), F.avg(F.abs("residual")).alias("mean_abs")
    )

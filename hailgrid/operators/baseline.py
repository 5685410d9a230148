"""Group-mean demand models: per (cell, weekday, hour), optionally per rain class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.functions import clock
from hailgrid.operators.joins import join_rides_metar

CELL_TIME = ("grid_x", "grid_y", "weekday", "hour")
# Precipitation classes in inches per hour.
HEAVY_RAIN = 0.30
MODERATE_RAIN = 0.10


def _with_clock(counts: DataFrame) -> DataFrame:
    return counts if {"weekday", "hour"} <= set(counts.columns) else clock.with_weekday_hour(counts)


def fit_means(counts: DataFrame, keys: Sequence[str] = CELL_TIME, weight: str | None = None) -> DataFrame:
    """The model: mean count and mean scaled count of each key."""
    rows = _with_clock(counts)

    def mean(name: str):
        if weight is None:
            return F.avg(name)
        return F.sum(F.col(name) * F.col(weight)) / F.sum(weight)

    return rows.groupBy(*keys).agg(
        mean("count").alias("mean_count"), mean("count_scaled").alias("mean_count_scaled")
    )


def predict_means(counts: DataFrame, model: DataFrame, keys: Sequence[str] = CELL_TIME) -> DataFrame:
    """Counts with ``pred`` and ``pred_scaled``; a key the model never saw predicts 0."""
    renamed = model.withColumnsRenamed({k: f"_{k}" for k in keys})
    # Null-safe equality adds no null filters to the model's side, whose counts
    # then stay the same plan as their own maximum and share its shuffle.
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = _with_clock(counts).join(renamed, same, "left")
    return joined.withColumns(
        {
            "pred": F.coalesce("mean_count", F.lit(0.0)),
            "pred_scaled": F.coalesce("mean_count_scaled", F.lit(0.0)),
        }
    ).drop("mean_count", "mean_count_scaled", *[f"_{k}" for k in keys])


def fit_predict_means(counts: DataFrame, keys: Sequence[str] = CELL_TIME) -> DataFrame:
    """``predict_means`` on the rows the model is fitted to, as one window.

    A key holds at most one row per week and cell, so the window's groups are
    short; it saves the join back to the model.
    """
    same_key = Window.partitionBy(*keys)
    return _with_clock(counts).withColumns(
        {"pred": F.avg("count").over(same_key), "pred_scaled": F.avg("count_scaled").over(same_key)}
    )


def fit_baseline(counts: DataFrame) -> DataFrame:
    return fit_means(counts)


def predict_baseline(counts: DataFrame, model: DataFrame) -> DataFrame:
    return predict_means(counts, model)


RAIN_KEYS = (*CELL_TIME, "heavy_rain")


def with_heavy_rain(counts: DataFrame, weather: DataFrame) -> DataFrame:
    joined = join_rides_metar(counts, weather)
    return joined.withColumn("heavy_rain", F.col("precip_in") >= HEAVY_RAIN)


def fit_adjusted(counts: DataFrame, weather: DataFrame) -> DataFrame:
    """Baseline split by heavy rain. ``weather`` may carry ``n_records`` weights."""
    weight = "n_records" if "n_records" in weather.columns else None
    return fit_means(with_heavy_rain(counts, weather), RAIN_KEYS, weight)


def predict_adjusted(counts: DataFrame, weather: DataFrame, model: DataFrame) -> DataFrame:
    return predict_means(with_heavy_rain(counts, weather), model, RAIN_KEYS)

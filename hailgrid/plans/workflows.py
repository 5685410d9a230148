"""Composite studies built from the operators. Each covers all periods in one
plan, with the period among the keys, where a script would loop over months."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.functions import clock, numeric
from hailgrid.functions.grid import NYC, GridSpec
from hailgrid.operators import baseline, counts, explore, residuals, similarity, weather, zipcodes
from hailgrid.operators.joins import join_rides_metar
from hailgrid.operators.metrics import with_residual
from hailgrid.session import materialize

Period = Callable[[str], Column]


def get_scaled_counts(rides: DataFrame, grid: GridSpec = NYC) -> DataFrame:
    return counts.count_rides(rides, grid)


def fit_transform(rides: DataFrame, grid: GridSpec = NYC, period: Period | None = None) -> DataFrame:
    """Fit the baseline and predict the same rows; per period when one is given."""
    counted = counts.count_rides(rides, grid, period)
    keys = (*(("period",) if period else ()), *baseline.CELL_TIME)
    return with_residual(baseline.fit_predict_means(counted, keys))


def fit_transform_adjusted(rides: DataFrame, hourly: DataFrame, grid: GridSpec = NYC) -> DataFrame:
    counted = counts.count_rides(rides, grid)
    model = baseline.fit_adjusted(counted, hourly)
    return with_residual(baseline.predict_adjusted(counted, hourly, model))


def train_and_predict(train_rides: DataFrame, test_rides: DataFrame, grid: GridSpec = NYC) -> DataFrame:
    """Fit on one span of time and predict another, each scaled by its own maximum."""
    model = baseline.fit_baseline(counts.count_rides(train_rides, grid))
    return with_residual(baseline.predict_baseline(counts.count_rides(test_rides, grid), model))


def train_and_predict_adjusted(
    train_rides: DataFrame, test_rides: DataFrame, hourly_fit: DataFrame, hourly_predict: DataFrame, grid: GridSpec = NYC
) -> DataFrame:
    model = baseline.fit_adjusted(counts.count_rides(train_rides, grid), hourly_fit)
    scored = baseline.predict_adjusted(counts.count_rides(test_rides, grid), hourly_predict, model)
    return with_residual(scored)


def _study(rows: DataFrame) -> dict[str, DataFrame]:
    by = ["period"]
    return {
        "rows": rows,
        "cells": residuals.cell_sizes(rows, by),
        "dates": rows.groupBy(*by, F.col("pickup_datetime").cast("date").alias("date")).count(),
        "hours": rows.groupBy(*by, "hour").count(),
        "weekdays": rows.groupBy(*by, "weekday").count(),
        "weekday_hour": residuals.weekday_hour_sizes(rows, by),
    }


def analyze_underestimated(
    rides: DataFrame, share: float = residuals.UNDER_SHARE, period: Period = clock.month_floor
) -> dict[str, DataFrame]:
    """The tables behind the study of rows predicted far too low, per period."""
    return _study(fit_transform(rides, period=period).filter(residuals.is_under(share)))


def analyze_overestimated(
    rides: DataFrame,
    residual_above: float = residuals.OVER_RESIDUAL_ABOVE,
    count_below: float = residuals.OVER_COUNT_BELOW,
    period: Period = clock.month_floor,
) -> dict[str, DataFrame]:
    """The tables behind the study of quiet cells predicted far too high, per period."""
    return _study(fit_transform(rides, period=period).filter(residuals.is_over(residual_above, count_below)))


def residuals_by_weather(
    rides: DataFrame, metar: DataFrame, flags: list[str], cold_below=residuals.COLD_BELOW, hot_above=residuals.HOT_ABOVE
) -> DataFrame:
    """Residual on both sides of each weather flag. Equal weather rows of an
    hour are folded and weighted, so a crowded hour does not multiply rows."""
    records = weather.weather_records(metar)
    joined = join_rides_metar(fit_transform(rides), records)
    flagged = residuals.flag_weather(joined, cold_below, hot_above)
    return residuals.compare_sides(flagged, flags, weight="n_records")


def residuals_by_area(rides: DataFrame, period: Period = clock.month_floor) -> DataFrame:
    """Baseline fitted separately inside and outside the high-demand rectangle."""
    counted = counts.cell_hour_counts(rides).withColumns(
        {"period": period("pickup_datetime"), "high_demand": explore.in_rectangle()}
    )
    scaled = counts.scale_counts(counted, ["period", "high_demand"])
    keys = ("period", "high_demand", *baseline.CELL_TIME)
    return with_residual(baseline.fit_predict_means(scaled, keys))


def demand_by_clock(counted: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Total demand by weekday, hour or both, over rides whose hour has weather.

    Both sides are summed to one row per hour before they are joined.
    """
    hourly = counted.groupBy("pickup_datetime").agg(F.sum("count").alias("count"))
    readings = weather.fold_records(records)
    return explore.demand_by(join_rides_metar(hourly, readings), keys, "n_records")


def label_rides(rides: DataFrame, centroids: DataFrame, radius_km: float) -> DataFrame:
    """Rides with a ZIP; those without one are left out."""
    return zipcodes.labelled_only(zipcodes.label_zip(rides, centroids, radius_km))


def zip_demand(rides: DataFrame, metar: DataFrame, centroids: DataFrame, radius_km: float) -> DataFrame:
    """Rides per (hour, weekday, ZIP, temperature bucket, precipitation bucket).

    Rides are summed per hour and ZIP before they meet the weather.
    """
    labelled = label_rides(rides, centroids, radius_km)
    hourly = labelled.groupBy(clock.hour_floor("pickup_datetime").alias("pickup_datetime"), "zip").count()
    records = weather.weather_records(metar).select(
        "datetime",
        numeric.bucket_fahrenheit("fahrenheit").alias("temperature"),
        numeric.bucket_precip("precip_in").alias("precipitation"),
        "n_records",
    )
    joined = join_rides_metar(hourly, weather.fold_records(records, "temperature", "precipitation"))
    keys = ["hour", "weekday", "zip", "temperature", "precipitation"]
    return joined.groupBy(*keys).agg(F.sum(F.col("count") * F.col("n_records")).alias("count"))


def demand_heatmap(rides: DataFrame, grid: GridSpec = NYC, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return explore.heatmap(counts.counts_by_grid_cell(rides, grid, by), grid, by)


def dense_periods(rides: DataFrame, period: Period = clock.month_floor, grid: GridSpec = NYC) -> DataFrame:
    """Dense cell counts of every period."""
    labelled = rides.withColumn("period", period("pickup_datetime"))
    return similarity.dense_cells(counts.counts_by_grid_cell(labelled, grid, ["period"]), ["period"], grid)


def dist_matrix(rides: DataFrame, period: Period = clock.month_floor, grid: GridSpec = NYC) -> DataFrame:
    return similarity.period_distances(dense_periods(rides, period, grid))


def cluster_periods(rides: DataFrame, period: Period = clock.month_floor, k: int = 2, grid: GridSpec = NYC) -> DataFrame:
    """Each period's cluster and its distance to the cluster's centre."""
    vectors = materialize(similarity.period_vectors(dense_periods(rides, period, grid)))
    return similarity.dist_to_center(vectors, similarity.fit_clusters(vectors, k))


def joined_features(rides: DataFrame, metar: DataFrame, period: Period | None = None) -> DataFrame:
    """Model input: scaled cell-hour counts with weather, weekday and hour; equal
    weather rows folded into ``n_records``."""
    return join_rides_metar(counts.count_rides(rides, period=period), weather.weather_records(metar))

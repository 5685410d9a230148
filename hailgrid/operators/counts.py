"""Rides to cell-hour counts, and count scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.functions import clock
from hailgrid.functions.grid import NYC, GridSpec


def clean_rides(rides: DataFrame, grid: GridSpec = NYC) -> DataFrame:
    return rides.filter(grid.contains("pickup_latitude", "pickup_longitude"))


def add_grid_cols(rides: DataFrame, grid: GridSpec = NYC, keep_coords: bool = False, clamp: bool = False) -> DataFrame:
    out = rides.withColumns(
        {"grid_x": grid.x("pickup_longitude", clamp), "grid_y": grid.y("pickup_latitude", clamp)}
    )
    return out if keep_coords else out.drop("pickup_latitude", "pickup_longitude")


def drop_minutes(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, clock.hour_floor(name))


def get_counts(gridded: DataFrame) -> DataFrame:
    """Rides per (hour, cell). A busy cell or hour is summed before the shuffle."""
    return _count_by(gridded, ["pickup_datetime", "grid_x", "grid_y"])


def _count_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key. Rows with a null key are in no group; stating it here keeps
    the plan equal wherever the counts are used, so that their shuffle is shared."""
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy(*keys).count()


def cell_hour_counts(rides: DataFrame, grid: GridSpec = NYC, clamp: bool = False) -> DataFrame:
    """Clean, grid, truncate to the hour and count."""
    gridded = rides.transform(clean_rides, grid).transform(add_grid_cols, grid, clamp=clamp)
    return gridded.transform(drop_minutes, "pickup_datetime").transform(get_counts)


def counts_by_grid_cell(rides: DataFrame, grid: GridSpec = NYC, by: Sequence[str] = ()) -> DataFrame:
    """Rides per cell (and per ``by``), over all hours."""
    gridded = rides.transform(clean_rides, grid).transform(add_grid_cols, grid)
    return _count_by(gridded, [*by, "grid_x", "grid_y"])


def scale_counts(counts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``count / max(count)``: over the whole table, or within each ``scope``.

    The whole-table maximum is a scalar subquery and the scoped one a small
    aggregate; both read the counts' shuffle output again instead of the source.
    """
    if not scope:
        peak = counts.agg(F.max("count")).scalar()
        return counts.withColumn("count_scaled", F.col("count") / peak)
    renamed = {k: f"_{k}" for k in scope}
    peaks = counts.groupBy(*scope).agg(F.max("count").alias("_peak")).withColumnsRenamed(renamed)
    same = [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    joined = counts.join(peaks, same).withColumn("count_scaled", F.col("count") / F.col("_peak"))
    return joined.drop("_peak", *renamed.values())


def count_rides(rides: DataFrame, grid: GridSpec = NYC, period=None) -> DataFrame:
    """Scaled cell-hour counts. ``period`` maps the hour column to the scope in
    which counts are scaled (for example ``clock.month_floor``)."""
    counts = cell_hour_counts(rides, grid)
    if period is None:
        return scale_counts(counts)
    return scale_counts(counts.withColumn("period", period("pickup_datetime")), ["period"])

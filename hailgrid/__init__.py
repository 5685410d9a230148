"""hailgrid: city pickup demand on Spark.

Trip records and station weather in, composable ``DataFrame`` transforms out:
grid-cell counts, weather joins, demand tables, group-mean and random-forest
demand models, period similarity and nearest-centroid ZIP labels.
"""

from hailgrid.functions.grid import NYC, GridSpec
from hailgrid.operators.counts import (
    add_grid_cols,
    clean_rides,
    count_rides,
    counts_by_grid_cell,
    get_counts,
    scale_counts,
)
from hailgrid.operators.joins import join_rides_metar
from hailgrid.operators.weather import clean_metar, clean_precip, clean_temperature

__all__ = [
    "NYC",
    "GridSpec",
    "add_grid_cols",
    "clean_metar",
    "clean_precip",
    "clean_rides",
    "clean_temperature",
    "count_rides",
    "counts_by_grid_cell",
    "get_counts",
    "join_rides_metar",
    "scale_counts",
]

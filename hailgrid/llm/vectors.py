"""What the vector operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector, dims): one vector of doubles per id.

    Leaves out null ids, and vectors that are null, zero, or hold a null or non-finite
    component. Repeated rows count once; of several vectors under one id the
    smallest in array order is taken.
    """
    values = F.col("vector")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & values.isNotNull())
        .filter(finite & F.exists(values, lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
        .withColumn("dims", F.size("vector"))
    )


def finite(vector: str = "vector") -> Column:
    """Whether a vector is there and holds neither null nor non-finite components; a zero vector does."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def floors(x: np.ndarray, scale: int, least_wide: int) -> tuple[np.ndarray, list[list[int] | None]]:
    """floor(scale * x) for rows of finite doubles, exactly; ``scale`` is a power of two.

    Rows with a component of ``least_wide`` or more in size are zeros in the array and a list of Python's integers beside it.
    """
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    wide = (np.abs(scaled) >= least_wide).any(axis=1)
    # A product that overflows is of a whole number, which floor leaves alone.
    exact = [[math.floor(c * scale) if abs(c) < 1e300 else int(c) * scale for c in row] if w else None for row, w in zip(x.tolist(), wide)]
    return np.where(wide[:, None], 0, scaled).astype(np.int64), exact

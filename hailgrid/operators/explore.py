"""Demand tables: totals by feature, binned means, pivots, top cells, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailgrid.functions import numeric
from hailgrid.functions.grid import NYC, GridSpec


def _weighted(name: str, weight: str | None) -> Column:
    return F.col(name) if weight is None else F.col(name) * F.col(weight)


def demand_by(joined: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Total count per key. ``weight`` is the multiplicity of folded weather rows."""
    return joined.groupBy(*keys).agg(F.sum(_weighted("count", weight)).alias("demand"))


def matrix(
    df: DataFrame,
    rows: str | Sequence[str],
    column: str,
    values: Sequence[int],
    value: str,
    prefix: str,
    fill: int | None = 0,
) -> DataFrame:
    """Pivot to one row per ``rows`` key and one column per listed value."""
    row_keys = [rows] if isinstance(rows, str) else list(rows)
    wide = df.groupBy(*row_keys).pivot(column, list(values)).agg(F.sum(value))
    named = wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})
    return named if fill is None else named.na.fill(fill, [f"{prefix}{v}" for v in values])


def value_ends(df: DataFrame, value: str, *also: Column, pad: Column | None = None) -> Column:
    """Scalar struct with the ends ``lo`` and ``hi`` of a column. When all values
    are equal the ends move apart by ``pad``, 0.1 % by default, as binning needs a width.

    ``also`` are further aggregates to carry along: naming the columns that the
    binned rows use keeps both plans alike, so that they share one shuffle.
    """
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    apart = F.when(low != 0, 0.001 * F.abs(low)).otherwise(0.001) if pad is None else pad
    pad = F.when(low == high, apart).otherwise(0.0)
    extra = [c.alias(f"_{i}") for i, c in enumerate(also)]
    return df.agg(F.struct((low - pad).alias("lo"), (high + pad).alias("hi"), *extra).alias("ends")).scalar()


def all_bins(spark: SparkSession, ends: Column, n: int) -> DataFrame:
    """``n`` rows: every equal-width bin with its edges."""
    step = (F.col("_ends.hi") - F.col("_ends.lo")) / F.lit(float(n))
    bins = spark.range(n).select(F.col("id").cast("int").alias("bin")).withColumn("_ends", ends)
    return bins.select(
        "bin",
        (F.col("_ends.lo") + F.col("bin") * step).alias("bin_low"),
        (F.col("_ends.lo") + (F.col("bin") + 1) * step).alias("bin_high"),
    )


def mean_by_bin(df: DataFrame, value: str, n: int, measure: str = "count", weight: str | None = None) -> DataFrame:
    """Mean of ``measure`` in ``n`` right-closed equal-width bins; empty bins stay, with a null mean.

    Rows are first summed per distinct value, so the ends and the bins come out
    of one pass over the source.
    """
    size = F.count(measure) if weight is None else F.sum(F.when(F.col(measure).isNotNull(), F.col(weight)))
    per_value = (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.sum(_weighted(measure, weight)).alias("_total"), size.alias("_size"))
    )
    ends = value_ends(per_value, value, F.sum("_total"), F.sum("_size"))
    place = numeric.right_closed_bin(value, F.col("_ends.lo"), F.col("_ends.hi"), n)
    means = per_value.withColumn("_ends", ends).groupBy(place.alias("bin")).agg(
        (F.sum("_total") / F.sum("_size")).alias("mean")
    )
    return all_bins(df.sparkSession, ends, n).join(means, "bin", "left")


def histogram(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """Row counts in ``n`` left-closed equal-width bins, empty ones as 0."""
    rows = df.filter(F.col(value).isNotNull())
    ends = value_ends(rows, value, pad=F.lit(0.5))
    place = numeric.left_closed_bin(value, F.col("_ends.lo"), F.col("_ends.hi"), n)
    sizes = rows.withColumn("_ends", ends).groupBy(place.alias("bin")).agg(F.count("*").alias("n_rows"))
    bins = all_bins(df.sparkSession, ends, n).join(sizes, "bin", "left")
    return bins.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def mean_hourly_max(counts: DataFrame, since: str) -> DataFrame:
    """Mean over hours of each hour's largest cell count, from ``since`` on."""
    recent = counts.filter(F.col("pickup_datetime") >= F.lit(since).cast("timestamp_ntz"))
    hourly = recent.groupBy("pickup_datetime").agg(F.max("count").alias("peak"))
    return hourly.agg(F.avg("peak").alias("mean_hourly_max"))


def top_quantile_cells(cell_counts: DataFrame, q: float = 0.95) -> DataFrame:
    """Cells at or above the ``q`` quantile of cell counts, busiest first."""
    cut = cell_counts.agg(F.percentile("count", q)).scalar()
    return cell_counts.filter(F.col("count") >= cut).orderBy(F.desc("count"), "grid_x", "grid_y")


def busiest(df: DataFrame, n: int, measure: str = "count", ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the largest measure."""
    return df.orderBy(F.desc(measure), *ties).limit(n)


# The two cell rectangles the demand study looks at, as
# inclusive (x_from, x_to, y_from, y_to).
HIGH_DEMAND = (3, 8, 21, 32)
HIGH_DEMAND_VIEW = (2, 9, 20, 32)


def in_rectangle(rectangle: tuple[int, int, int, int] = HIGH_DEMAND) -> Column:
    x0, x1, y0, y1 = rectangle
    return F.col("grid_x").between(x0, x1) & F.col("grid_y").between(y0, y1)


def heatmap(cell_counts: DataFrame, grid: GridSpec = NYC, by: Sequence[str] = ()) -> DataFrame:
    """Cell counts as rows of y by columns of x; a cell without rides shows 0.
    The column one past the east edge is kept."""
    return matrix(cell_counts, [*by, "grid_y"], "grid_x", range(grid.nx + 1), "count", "x")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows in total and nulls per column."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])

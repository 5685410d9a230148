"""Error measures and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.functions.quantiles import attach, exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def with_residual(pred: DataFrame, actual: str = "count", predicted: str = "pred", name: str = "residual") -> DataFrame:
    return pred.withColumn(name, F.col(predicted) - F.col(actual))


def rmse(a: Column | str, b: Column | str, weight: str | None = None) -> Column:
    left = F.col(a) if isinstance(a, str) else a
    right = F.col(b) if isinstance(b, str) else b
    squares = (left - right) * (left - right)
    return F.sqrt(F.avg(squares) if weight is None else F.sum(squares * F.col(weight)) / F.sum(weight))


def r2(actual: str, predicted: str, weight: str | None = None) -> Column:
    """``1 - sse / sst``; a row of weight n counts as n rows. Null where the actual value doesn't vary."""
    error = F.col(actual) - F.col(predicted)
    if weight is None:
        return 1 - F.try_divide(F.sum(error * error), F.var_pop(actual) * F.count(actual))
    # as doubles: the squared sums of whole counts pass 64 bits; below 2**53 a double holds them exactly
    w, y = F.col(weight), F.col(actual).cast("double")
    return 1 - F.try_divide(F.sum(error * error * w), F.sum(y * y * w) - F.sum(y * w) * F.sum(y * w) / F.sum(w))


def quantile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def summary(name: str, prefix: str = "") -> list[Column]:
    """count, mean, sample deviation, min and max of one column."""
    return [
        F.count(name).alias(f"{prefix}n"),
        F.avg(name).alias(f"{prefix}mean"),
        F.stddev_samp(name).alias(f"{prefix}std"),
        F.min(name).alias(f"{prefix}min"),
        F.max(name).alias(f"{prefix}max"),
    ]


def describe(
    df: DataFrame,
    name: str,
    by: Sequence[str] = (),
    probs: Sequence[float] = QUARTILES,
    prefix: str = "",
    repeating: bool = False,
) -> DataFrame:
    """Summary and exact quantiles of one column, per ``by`` group.

    ``repeating=True`` is for values that recur, such as counts: the quantiles
    then come from one aggregate whose buffer holds the distinct values. The
    default ranks only a bracket of values (``functions.quantiles``).
    """
    if repeating:
        array = F.percentile(name, list(probs)).alias("_q")
        stats = df.groupBy(*by).agg(*summary(name, prefix), array)
        named = {f"{prefix}{quantile_name(p)}": F.col("_q")[i] for i, p in enumerate(probs)}
        return stats.withColumns(named).drop("_q")
    stats = df.groupBy(*by).agg(*summary(name, prefix))
    ranks = exact_quantiles(df, name, probs, by).withColumnsRenamed(
        {f"q{i}": f"{prefix}{quantile_name(p)}" for i, p in enumerate(probs)}
    )
    return attach(stats, ranks, by)


def prediction_stats(pred: DataFrame) -> DataFrame:
    """One row: summary of count, scaled RMSE, RMSE, R2 and summary of the residual."""
    rows = with_residual(pred)
    stats = rows.agg(
        *summary("count", "count_"),
        F.percentile("count", list(QUARTILES)).alias("_q"),
        rmse("count_scaled", "pred_scaled").alias("rmse_scaled"),
        rmse("count", "pred").alias("rmse"),
        r2("count", "pred").alias("r2"),
        *summary("residual", "residual_"),
    )
    stats = stats.withColumns({f"count_{quantile_name(p)}": F.col("_q")[i] for i, p in enumerate(QUARTILES)})
    ranks = exact_quantiles(rows, "residual", QUARTILES).withColumnsRenamed(
        {f"q{i}": f"residual_{quantile_name(p)}" for i, p in enumerate(QUARTILES)}
    )
    return attach(stats.drop("_q"), ranks, ())


def scaling_check(pred: DataFrame) -> DataFrame:
    """One row: how far ``max(count) * pred_scaled`` is from ``pred``, and the
    scaled RMSE times the maximum beside the plain RMSE."""
    peak = pred.agg(F.max("count")).scalar()
    rows = pred.withColumn("_peak", peak)
    return rows.agg(
        F.max(F.abs(F.col("_peak") * F.col("pred_scaled") - F.col("pred"))).alias("max_abs_difference"),
        (rmse("count_scaled", "pred_scaled") * F.first("_peak")).alias("rmse_rescaled"),
        rmse("count", "pred").alias("rmse"),
    )


def error_summary(pred: DataFrame, actual: str = "count", predicted: str = "pred", weight: str | None = None) -> DataFrame:
    """One row: size, largest count, squared error and the mean and deviation of actual - predicted; a row of weight n counts as n rows."""
    error = F.col(actual) - F.col(predicted)
    if weight is not None:
        w = F.col(weight)
        n, total, squares = F.sum(w), F.sum(error * w), F.sum(error * error * w)
        return pred.agg(
            n.alias("n_rows"),
            F.max(actual).alias("max_count"),
            squares.alias("sse"),
            (total / n).alias("mean_error"),
            (F.sum(F.abs(error) * w) / n).alias("mean_abs_error"),
            F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1))).alias("std_error"),
        )
    return pred.agg(
        F.count("*").alias("n_rows"),
        F.max(actual).alias("max_count"),
        F.sum(error * error).alias("sse"),
        F.avg(error).alias("mean_error"),
        F.avg(F.abs(error)).alias("mean_abs_error"),
        F.stddev_samp(error).alias("std_error"),
    )

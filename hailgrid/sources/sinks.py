"""Writers, model persistence and run reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_by_period(df: DataFrame, path: str, time_col: str = "pickup_datetime", mode: str = "errorifexists") -> None:
    """Parquet partitioned by year and month, so later scans prune by period."""
    parts = df.withColumns({"year": F.year(time_col), "month": F.month(time_col)})
    parts.write.mode(mode).partitionBy("year", "month").parquet(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Train/dev/test rows in one folder per split; refuses to overwrite."""
    df.write.mode("errorifexists").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(split_col) == split).drop(split_col)


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_report(stats: DataFrame, path: str, description: str, seconds: float, test_rmse: float) -> None:
    """One row per parameter set, with the run's configuration, time and test score."""
    report = stats.withColumns(
        {
            "description": F.lit(description),
            "seconds": F.lit(float(seconds)),
            "test_rmse": F.lit(float(test_rmse)),
        }
    )
    report.write.mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def to_driver(df: DataFrame, max_rows: int = 100_000):
    """Small result to pandas. More rows than ``max_rows`` is an error: aggregate
    first, or take an explicit sample (``hailgrid.operators.splits.sample_n``)."""
    rows = df.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; aggregate or sample before bringing them to the driver")
    return rows

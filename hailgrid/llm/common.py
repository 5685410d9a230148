"""What the operators share: table access, row identity and small Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes that one Arrow batch hands to a Python worker. Texts can be
# long, so the default of 10,000 rows would be too much memory.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and leave every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows. The numbers are stable only once the frame is written,
    so callers materialize the result before they read it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())

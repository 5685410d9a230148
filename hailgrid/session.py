"""Session settings and durable materialisation."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the engine expects from a cluster session. Joins carry no broadcast
# hints: Spark broadcasts a side only when its size is under the threshold and
# otherwise shuffles, and the adaptive skew rules split an oversized partition.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Removes the shuffle files of a finished execution instead of waiting for the driver's garbage collector.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "hailgrid", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark, with its work folder set; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", _own_folder())
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may leave
    the setting out; it then uses one folder that goes when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _own_folder()
    return shared.rstrip("/")


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="hailgrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage for work that reads a result many times (cross-validation), so
    that losing an executor does not mean scanning the source again. Parquet
    keeps later reads columnar and lets Spark see the table's size. What the write shuffled goes as soon
    as it is done, so a job of many steps needs the disk of its largest step, not of all.
    """
    return written(df)[0]


def written(df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``materialize`` with the path of the table, for jobs of many steps that ``discard`` a step's table after the next.

    With ``by`` the table has a folder for each value of these columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hailgrid-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    # a table in folders has no file to tell its columns where it has no rows
    reader = spark.read.schema(df.schema) if by else spark.read
    return reader.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# Rows up to which a computed lookup table is handed to every task.
SMALL_ROWS = 10_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Compute a lookup table once and check its size: up to ``max_rows`` rows it
    is broadcast when joined, a larger one is joined by shuffle."""
    table = materialize(df)
    return F.broadcast(table) if table.count() <= max_rows else table

"""Views that read the given event and customer tables as rides, station
weather and ZIP centroids (``FIXTURES.md`` part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailgrid.functions import clock


# Room for the number of a ride in ``ride_id``; values reach far below 20 times as much.
RIDES_PER_EVENT = 1 << 20


class Tables:
    """Rides, weather and centroids derived from one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rides(self) -> DataFrame:
        """Each event becomes one ride, and one more for every 20 of its value. ``ride_id`` identifies a ride."""
        copies = F.greatest(F.lit(1), 1 + F.floor(F.col("value") / 20))
        position = self.table("events").select(
            "event_id",
            F.col("ts").alias("pickup_datetime"),
            (F.lit(-74.08) + (F.col("user_id") % 11) * F.lit(0.04)).alias("pickup_longitude"),
            (F.lit(40.45) + (F.floor(F.col("user_id") / 11) % 7) * F.lit(0.1)).alias("pickup_latitude"),
            copies.alias("_copies"),
        )
        return position.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(
            (F.col("event_id") * RIDES_PER_EVENT + F.col("_n")).alias("ride_id"),
            "pickup_datetime",
            "pickup_longitude",
            "pickup_latitude",
        )

    def raw_metar(self) -> DataFrame:
        """(valid, tmpf, p01i) with text values, some of them not numbers."""
        event = F.col("event_id")
        routine = clock.hour_floor("ts") + F.make_dt_interval(mins=F.lit(51))
        hundredths = F.concat(F.lit("0."), F.lpad((event % 60).cast("string"), 2, "0"))
        return self.table("events").select(
            "event_id",
            F.when(event % 14 == 0, routine).otherwise(F.col("ts")).alias("valid"),
            F.when(event % 50 == 0, "M").otherwise((F.col("user_id") % 100 - 10).cast("string")).alias("tmpf"),
            F.when(event % 40 == 0, "T").otherwise(hundredths).alias("p01i"),
        )

    def metar(self) -> DataFrame:
        return self.raw_metar().select(
            F.col("valid").alias("datetime"), F.col("tmpf").alias("fahrenheit"), F.col("p01i").alias("precip_in")
        )

    def centroids(self) -> DataFrame:
        """Every customer is a ZIP area with a centre inside the box."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            F.lpad(key.cast("string"), 9, "0").alias("zip"),
            (F.lit(40.5) + (key * 53 % 500) / F.lit(1000.0)).alias("lat"),
            (F.lit(-74.05) + (key * 37 % 350) / F.lit(1000.0)).alias("lon"),
        )

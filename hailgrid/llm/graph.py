"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Each round points every larger neighbour of a node at the node's smallest
    neighbour, then every smaller one, until only stars are left; rounds grow with the
    logarithm of a component's size. Rounds are written to the shared
    folder, so a lost executor repeats one round at most. Edges with a null end and
    loops are ignored; repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = materialize(pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    state = _state(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = materialize(small.distinct())
        before, state = state, _state(pairs)
        if before == state:
            break
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """Enough to tell that a round has changed nothing."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())

"""Sampling and train/dev/test splits that do not depend on partitioning.

Each row gets a number in [0, 1) from a hash of its key columns, so a split is
the same however the data is laid out and a recomputed task repeats it. The key
should identify a row; rows sharing a key share the number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hailgrid.functions.quantiles import attach
from hailgrid.session import materialize, small_side

# 13 hex digits of the digest: 52 bits, exact in a double.
_HEX_DIGITS = 13
_SPAN = float(16**_HEX_DIGITS)
# Exact-size sampling ranks rows inside a few of this many slices of a slice of [0, 1).
SLICES = 65_536


def uniform(keys: Sequence[str], seed: int = 0) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX_DIGITS), 16, 10).cast("double") / F.lit(_SPAN)


def weighted_split(df: DataFrame, shares: dict[str, float], keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Column ``split`` with each name's share of the rows (in expectation)."""
    total = float(sum(shares.values()))
    edge, label = 0.0, None
    u = F.col("_u")
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name] / total
        label = F.when(u < edge, name) if label is None else label.when(u < edge, name)
    label = F.lit(names[0]) if label is None else label.otherwise(names[-1])
    return df.withColumn("_u", uniform(keys, seed)).withColumn("split", label).drop("_u")


def mask_split(df: DataFrame, keys: Sequence[str], ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """Column ``split``: ``test`` with probability ``ratio``, else ``train``."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie strictly between 0 and 1")
    return df.withColumn("split", F.when(uniform(keys, seed) < 1 - ratio, "train").otherwise("test"))


def _cut_at(sizes: DataFrame, group: Sequence[str], part: str, rank: Column) -> DataFrame:
    """For each cut of a group the part (a column of ``sizes``, in order) that its rank falls in, and the rank within that part."""
    running = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    upto = sizes.withColumn("_upto", F.sum("_in").over(running)).withColumn("_cut", F.explode(rank))
    here = (F.col("_cut.rank") <= F.col("_upto")) & (F.col("_cut.rank") > F.col("_upto") - F.col("_in"))
    return upto.filter(here).select(
        *[F.col(g).alias(f"_k_{g}") for g in group],
        F.col(part).alias("_k_part"),
        F.col("_cut.no").alias("_no"),
        (F.col("_cut.rank") - F.col("_upto") + F.col("_in")).alias("_rank"),
    )


def _boundaries(rows: DataFrame, cuts: Sequence[int], group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per group, for each cut the (random number, key) of the row at that rank.

    A count per slice of [0, 1) tells which slice a cut falls in, and a count per slice of that slice
    which part of it; only the rows there, a 1/SLICES**2 share, are ranked in one task. A cut past the
    group's last row has no boundary.
    """

    def same(names: Sequence[str], part: str) -> list[Column]:
        return [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in names] + [F.col(part) == F.col("_k_part")]

    sizes = rows.groupBy(*group, "_slice").agg(F.count("*").alias("_in"))
    wanted = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(int(c)).cast("long").alias("rank")) for i, c in enumerate(cuts)])
    at = small_side(_cut_at(sizes, group, "_slice", wanted))
    inside = rows.join(at, same(group, "_slice")).withColumn("_part", F.floor((F.col("_u") * SLICES - F.col("_slice")) * SLICES).cast("int"))
    inside = materialize(inside.select(*dict.fromkeys([*group, *keys, "_u"]), "_no", "_rank", "_part"))

    by = [*group, "_cut_no"]
    inside = inside.withColumnRenamed("_no", "_cut_no").withColumnRenamed("_rank", "_cut_rank")
    sizes = inside.groupBy(*by, "_cut_rank", "_part").agg(F.count("*").alias("_in"))
    one = F.array(F.struct(F.col("_cut_no").alias("no"), F.col("_cut_rank").alias("rank")))
    at = small_side(_cut_at(sizes, by, "_part", one))
    ranked = inside.join(at, same(by, "_part")).withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_u", *keys)))
    found = ranked.filter(F.col("_at") == F.col("_rank"))
    edge = F.struct("_u", *keys)
    return found.groupBy(*group).agg(
        *[F.max(F.when(F.col("_no") == i, edge)).alias(f"_edge{i}") for i in range(len(cuts))]
    )


def split_exact(
    df: DataFrame, sizes: dict[str, int], keys: Sequence[str], rest: str = "train", by: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """Column ``split`` with exactly the given number of random rows per name
    (per ``by`` group) and ``rest`` for the others. ``keys`` must identify a row.

    Two narrow passes over the keys find where each part ends; the rows are then
    labelled in place by comparing with those ends, so no task orders a whole
    group and the full rows are not shuffled. The passes run when this is called:
    materialise rows that are costly to compute first.
    """
    group = list(by)
    rows = df.withColumn("_u", uniform(keys, seed)).withColumn("_slice", F.floor(F.col("_u") * SLICES).cast("int"))
    names, cuts = list(sizes), []
    for name in names:
        cuts.append((cuts[-1] if cuts else 0) + int(sizes[name]))

    narrow = rows.select(*dict.fromkeys([*group, *keys, "_u", "_slice"]))
    edges = small_side(_boundaries(narrow, cuts, group, keys))
    me = F.struct("_u", *keys)
    label = None
    for i, (name, size) in enumerate(sizes.items()):
        if size <= 0:
            continue
        # no boundary: the group ends before the cut, so every row is inside
        inside = F.coalesce(me <= F.col(f"_edge{i}"), F.lit(True))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    split = F.lit(rest) if label is None else label.otherwise(rest)
    extra = ["_u", "_slice", *[f"_edge{i}" for i in range(len(names))]]
    return attach(rows, edges, group, "left").withColumn("split", split).drop(*extra)


def sample_n(df: DataFrame, n: int, keys: Sequence[str], by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Exactly ``n`` uniformly chosen rows, or ``n`` per ``by`` group; all of a smaller group."""
    return split_exact(df, {"in": n}, keys, "out", by, seed).filter(F.col("split") == "in").drop("split")

"""K-d tree partitioning of documents into shards of near equal bytes, in DataFrame functions only.

A node that stands for several shards is split along its widest metadata dimension
at the weighted quantile that gives each side the bytes of its shards (the weighted
median, when both get as many), until every leaf is one shard of the target bytes.

Rows are never collected or sorted as a whole. A dimension's value is a number of at most
``VALUE_BITS`` bits, followed by ``TIE_BITS`` of a row hash, so that a value of many rows can still be cut between two
shards. A quantile is found by histograms of ``BUCKETS`` buckets over a range that narrows to one
number, for all nodes of a level at once; one row per node comes to the driver.
The tree then is a nested conditional expression over the rows.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hailgrid.llm.common import text_or_empty, with_row_id
from hailgrid.session import materialize

VALUE_BITS, TIE_BITS = 48, 14
BUCKETS = 4096
OVERHEAD_BYTES = 8
# Rows of a shard that are numbered in one task.
SLOT_ROWS = 20_000


@dataclass
class Node:
    """A part of the tree: shards ``first`` to ``first + count - 1``; split once it has a dimension and a cut."""

    first: int
    count: int
    dimension: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def split(self, dimension: str, cut: int) -> None:
        """Rows with a code below ``cut`` go left."""
        self.dimension, self.cut = dimension, cut
        half = self.count // 2
        self.left, self.right = Node(self.first, half), Node(self.first + half, self.count - half)

    def expression(self) -> Column:
        """The first shard of the lowest part that a row falls in."""
        if self.dimension is None:
            return F.lit(self.first)
        return F.when(F.col(self.dimension) < self.cut, self.left.expression()).otherwise(self.right.expression())

    def open(self) -> list[Node]:
        """Parts that stand for several shards and are not split yet."""
        if self.dimension is None:
            return [self] if self.count > 1 else []
        return self.left.open() + self.right.open()


def text_value(value: Column, skip: int = 0) -> Column:
    """A number that orders texts as the six bytes after the first ``skip`` do; null comes first."""
    head = F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), skip + 1, VALUE_BITS // 8)), VALUE_BITS // 4, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(0).cast("long"))


def common_bytes(docs: DataFrame, names: list[str]) -> dict[str, int]:
    """How many bytes all values of a text column begin with alike, by column: those that its least and its greatest value share."""
    if not names:
        return {}
    ends = docs.agg(*[F.struct(*[f(F.encode(F.col(c).cast("string"), "utf-8")) for f in (F.min, F.max)]).alias(c) for c in names]).first()
    return {c: len(os.path.commonprefix([bytes(x or b"") for x in ends[c]])) for c in names}


def count_value(value: Column) -> Column:
    """A number that grows with the logarithm of a count; null comes first."""
    scaled = F.log2(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)
    return F.least(F.floor(scaled * (1 << 20)), F.lit((1 << 26) - 1))


def _by_node(nodes: list[Node], values: dict[int, int]) -> Column:
    """The value that belongs to a row's node; null in other nodes."""
    out = None
    for n in nodes:
        here = F.col("node") == n.first
        value = F.lit(values[n.first]).cast("long")
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def grow(rows: DataFrame, names: list[str], shards: int) -> Node:
    """The tree over ``rows`` (weight, and a code per name), by a few jobs a level."""
    tree = Node(0, shards)
    whole: dict[str, int] = {}
    while nodes := tree.open():
        level = rows.withColumn("node", tree.expression()).filter(F.col("node").isin([n.first for n in nodes]))
        ends = [f(F.col(n)).alias(f"{n} {s}") for n in names for f, s in ((F.min, "low"), (F.max, "high"))]
        stats = {r["node"]: r for r in level.groupBy("node").agg(F.sum("weight").alias("weight"), *ends).collect()}

        width = lambda r, name: (r[f"{name} high"] >> TIE_BITS) - (r[f"{name} low"] >> TIE_BITS)
        if not whole and stats:
            whole = {n: width(stats[0], n) for n in names}
        chosen, low, high, before, target = {}, {}, {}, {}, {}
        for n in nodes:
            r = stats.get(n.first)
            if r is None:  # no rows, so any cut will do
                n.split(names[0], 0)
                continue
            name = max(names, key=lambda x: width(r, x) / max(1, whole[x]))
            chosen[n.first], low[n.first], high[n.first] = name, r[f"{name} low"], r[f"{name} high"]
            before[n.first], target[n.first] = 0, r["weight"] * (n.count // 2) / n.count

        live = [n for n in nodes if n.first in chosen]
        cut: dict[int, int] = {}
        while left := [n for n in live if n.first not in cut]:
            step = {n.first: -(-(high[n.first] - low[n.first] + 1) // BUCKETS) for n in left}
            code = None
            for n in left:
                here, value = F.col("node") == n.first, F.col(chosen[n.first])
                code = F.when(here, value) if code is None else code.when(here, value)
            inside = level.select("node", code.alias("code"), "weight")
            inside = inside.filter((F.col("code") >= _by_node(left, low)) & (F.col("code") <= _by_node(left, high)))
            offset = F.col("code") - _by_node(left, low)
            offset = offset - offset % _by_node(left, step)
            sums = inside.groupBy("node", offset.alias("offset")).agg(F.sum("weight").alias("weight"))
            upto = F.sum("weight").over(Window.partitionBy("node").orderBy("offset"))
            crossing = sums.withColumn("upto", upto).filter(F.col("upto") >= _by_node(left, {n.first: int(target[n.first]) - before[n.first] for n in left}))
            found = crossing.groupBy("node").agg(F.min_by(F.struct("offset", "weight", "upto"), "offset").alias("x")).select("node", "x.*").collect()
            for r in found:
                k = r["node"]
                start, own = low[k] + r["offset"], r["weight"]
                base = before[k] + r["upto"] - own
                if step[k] == 1:
                    cut[k] = start if target[k] - base <= base + own - target[k] else start + 1
                else:
                    low[k], high[k], before[k] = start, min(high[k], start + step[k] - 1), base
        for n in live:
            n.split(chosen[n.first], cut[n.first])
    return tree


def shard(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None,
    overhead: int = OVERHEAD_BYTES,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``shards`` or ``target_bytes`` sets the number of leaves. Sizes are UTF-8 bytes plus ``overhead``; a null text has
    no bytes and the crc32 of nothing. ``dimensions`` name the metadata, by default source, lang and size where
    the columns exist; nulls come first. Of a text the six bytes after what all values begin with count: values that differ later only
    are one value to the tree, which ties cut. Shards differ by about one document in a cut; repeated rows are placed
    each; equal texts need not share a shard; a null doc_id stays null; no rows give no rows. ``slot`` counts a shard's rows from 0 without gaps.
    The law is ``bytes``, so ``grown_shard`` is null.
    """
    if dimensions is None:
        skip = common_bytes(docs, [c for c in ("source", "lang") if c in docs.columns])
        dimensions = {c: text_value(F.col(c).cast("string"), n) for c, n in skip.items()}
        dimensions["size"] = count_value(F.octet_length(text_or_empty()))
    names = [f"d{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + overhead).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        *[value.alias(n) for n, value in zip(names, dimensions.values())],
    )
    rows = materialize(with_row_id(rows))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, -(-totals["bytes"] // target_bytes))
    tie = F.pmod(F.xxhash64("_row"), F.lit(1 << TIE_BITS))
    coded = rows.select("_row", "doc_id", "size", "text_crc32", *[(F.col(n) * (1 << TIE_BITS) + tie).alias(n) for n in names])
    tree = grow(coded.withColumnRenamed("size", "weight"), names, shards)

    parts = max(1, -(-totals["n"] // (shards * slot_rows)))
    placed = coded.select("_row", "doc_id", "size", "text_crc32", tree.expression().cast("int").alias("shard"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("_row"))
    return (
        placed.withColumn("number", number)
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )

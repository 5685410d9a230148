"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by the order of its ``PREFIX`` nearest reference points. Inverted
lists hold, for each pivot, the vectors that name it; two vectors that share at
least ``SHARED`` pivots are candidates, and their exact cosine decides.

Lists are cut into blocks and blocks are compared in pairs, so a task holds at most
two blocks however long a list is. A task gives one row per vector with
its links counted and joined to a root, never the pairs. A pair that meets in
several lists counts in that of its smallest shared pivot. Equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm.graph import connected_components
from hailgrid.llm.vectors import usable
from hailgrid.session import materialize

THRESHOLD = 0.9
PREFIX = 8
SHARED = 2
# One pivot for so many vectors, within these bounds; the pivots are held by every task.
ROWS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 100, 32, 2048
# Rows drawn for each pivot wanted: groups that hold three quarters of the rows still leave enough.
DRAWN = 4
BLOCK_ROWS = 1024
# Candidate pairs that are verified in one go.
PAIRS = 1 << 17

DESCRIBED = "node long, dims int, weight long, unit array<double>, prefix array<int>"
LINKED = "node long, links long, root long"


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    # Scaled first, so that neither huge nor tiny components lose the direction.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(drawn: np.ndarray, count: int, threshold: float = THRESHOLD) -> np.ndarray:
    """The first ``count`` of the drawn unit vectors that lie more than twice the link angle from all before them.

    A dense group so owns a pivot or two, not a share by its size. Were there many in it, which of them
    are a member's nearest would be chance, and linked members would share none.
    """
    cut = 2 * threshold**2 - 1 if threshold > 0 else -1.0
    chosen = np.empty((0, drawn.shape[1]))
    for at in range(0, len(drawn), 256):
        part = drawn[at : at + 256]
        part = part[(part @ chosen.T < cut).all(axis=1)]
        close, kept = part @ part.T >= cut, []
        for i in range(len(part)):
            if not close[i, kept].any():
                kept.append(i)
        chosen = np.concatenate([chosen, part[kept]])
        if len(chosen) >= count:
            break
    return chosen[:count]


def choose_pivots(nodes: DataFrame, rows_per_pivot: int = ROWS_PER_PIVOT, threshold: float = THRESHOLD) -> dict[int, np.ndarray]:
    """Reference points by vector length, spread apart, from the rows with the smallest hashes; at most ``DRAWN`` times ``MOST_PIVOTS`` are collected."""
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, nodes.count() // rows_per_pivot))
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(DRAWN * count).select("dims", "vector").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.dims, []).append(r.vector)
    return {k: spread(_units(v), count, threshold) for k, v in out.items()}


def describe(nodes: DataFrame, pivots: dict[int, np.ndarray], prefix: int = PREFIX) -> DataFrame:
    """Unit vectors with the numbers of their nearest pivots, nearest first.

    A length with no more than ``prefix`` pivots gets pivot 0 for all, as every list would hold every vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, rows in batch.groupby("dims"):
                x = _units(rows["vector"].tolist())
                near = np.zeros((len(x), 1), dtype=np.int32)
                if dims in pivots and len(pivots[dims]) > prefix:
                    near = np.argsort(-(x @ pivots[dims].T), axis=1, kind="stable")[:, :prefix].astype(np.int32)
                yield pd.DataFrame({"node": rows["node"], "dims": dims, "weight": rows["weight"], "unit": list(x), "prefix": list(near)})

    return nodes.mapInPandas(run, DESCRIBED)


def _shared(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of rows have pivot lists that share at least ``least`` numbers."""
    names = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    hot = np.zeros((2, max(len(a), len(b)), len(names)), dtype=np.float32)
    for side, x in enumerate((a, b)):
        hot[side, np.arange(len(x))[:, None], np.searchsorted(names, x)] = 1
    return hot[0, : len(a)] @ hot[1, : len(b)].T >= min(least, a.shape[1]) - 0.5


def _links(left: pd.DataFrame, right: pd.DataFrame | None, pivot: int, threshold: float, least: int) -> pd.DataFrame:
    """Links of two blocks of a list, or within one: (node, links, root)."""
    both = left if right is None else pd.concat([left, right], ignore_index=True)
    unit, prefix = np.array(both["unit"].tolist()), np.array(both["prefix"].tolist())
    weight, node, n = both["weight"].to_numpy(), both["node"].to_numpy(), len(left)
    # The product tells nearly which are near; those pairs are then verified as below, whatever the blocks.
    x, y = (slice(None), slice(None)) if right is None else (slice(n), slice(n, None))
    i, j = np.nonzero(_shared(prefix[x], prefix[y], least) & (unit[x] @ unit[y].T >= threshold - 1e-9))
    if right is None:
        i, j = i[i < j], j[i < j]
    else:
        j = j + n
    links, root = np.zeros(len(both), dtype=np.int64), np.arange(len(both))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        a, b = a[near], b[near]
        common = (prefix[a][:, :, None] == prefix[b][:, None, :]).any(axis=2)
        first = np.where(common, prefix[a], np.iinfo(np.int32).max).min(axis=1) == pivot
        a, b = a[first], b[first]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        for _ in range(len(both)):  # smallest label spreads until nothing changes
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (before == root).all():
                break
    hit = links > 0
    return pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[root[hit]]})


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    prefix: int = PREFIX,
    shared: int = SHARED,
    rows_per_pivot: int = ROWS_PER_PIVOT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that ``vectors.usable`` leaves out link with nothing and stay; repeated rows and rows under one id get the id's result;
    equal vectors always link; a null id is a component of its own (null, kept); vectors of different length never
    meet; extra columns are ignored; no rows give no rows.
    """
    rows = usable(vectors)
    nodes = materialize(rows.groupBy("vector", "dims").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    described = materialize(describe(nodes, choose_pivots(nodes, rows_per_pivot, threshold), prefix))

    lists = described.withColumn("pivot", F.explode("prefix"))
    sizes = lists.groupBy("pivot", "dims").count().select("pivot", "dims", F.ceil(F.col("count") / block_rows).alias("blocks"))
    # One row a pivot, so at most MOST_PIVOTS for each vector length.
    blocked = lists.join(F.broadcast(sizes), ["pivot", "dims"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = blocked.withColumn("other", other).select(
        "pivot", "dims", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "weight", "unit", "prefix"
    )

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        pivot, _, low, high = key
        group = group.sort_values("node")
        left, right = group[group["block"] == low].reset_index(drop=True), group[group["block"] == high].reset_index(drop=True)
        if low != high and (left.empty or right.empty):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        return _links(left, None if low == high else right, int(pivot), threshold, shared)

    linked = materialize(met.groupBy("pivot", "dims", "low", "high").applyInPandas(compare, LINKED))
    components = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    found = (
        nodes.join(counts, "node", "left")
        .join(components, "node", "left")
        .select("node", "vector", F.coalesce("links", F.lit(0)).alias("links"), F.col("weight"), F.coalesce("component", "node").alias("component"))
    )
    by_row = rows.join(found, "vector").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    return every.join(by_row, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"),
    )

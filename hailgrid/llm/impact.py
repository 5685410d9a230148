"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are whole numbers. In a shard every dimension has a postings list of the vectors, cut into segments of
equal quantised impact and ordered by its size, largest first. A query opens the segments of all dimensions by
falling product of its own component and the impact, in steps of halving that product. What a
vector can still gain is bounded from both sides: by the products left, and by the norms of the components of query and
vector that have not met. The vectors whose upper bound reaches the k-th best of some exact products are the possible members; a query
stops once these are proven few, or when all segments are done, and they are rescored exactly.

Rows with equal vectors are one node that carries its smallest ids, as many as a result can show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hailgrid.llm.vectors import finite, floors
from hailgrid.session import materialize

SCALE = 256
K = 5
SHARD_ROWS = 8192
# Quantised sizes of impact in a shard, and possible members (a share of the nodes) at which a query stops: rescoring one costs less than its postings.
LEVELS = 128
FEW = 1 / 4
STEP = 0.5
# From this size on a component is handled as a Python integer: below it, products of up to MOST_DIMS components fit 64 bits.
WIDE = 1 << 25
MOST_DIMS = 1 << 10

INDEX = "shard long, dims int, part int, ids array<long>, vector array<double>, dimension int, impact int, sign int, members array<int>"
FOUND = "query_id long, vec_id long, score long, size string"


class Postings:
    """The lists of a shard, one dimension after the other, each by falling size of impact.

    A segment is (dimension, impact, sign, members): the nodes whose component has that sign and, in units of ``width``, that size.
    """

    def __init__(self, points: np.ndarray, segments: list[tuple[int, int, int, np.ndarray]], width: int):
        dims = points.shape[1]
        segments = sorted(segments, key=lambda s: (s[0], -s[1], s[2]))
        sizes = np.array([len(s[3]) for s in segments], dtype=np.int64)
        impact, sign = (np.array([s[i] for s in segments], dtype=np.float64) for i in (1, 2))
        # A segment's vectors count with its middle; half its width is the error.
        self.half, self.points = (width - 1) / 2, points
        self.members = np.concatenate([s[3] for s in segments]).astype(np.int64) if segments else np.empty(0, dtype=np.int64)
        self.value = np.repeat(sign * (impact * width + self.half), sizes)
        self.inner = np.repeat((impact * width) ** 2 / 2, sizes)
        # By dimension: the largest component of each segment, and where its members end.
        lists = [[i for i, s in enumerate(segments) if s[0] == d] for d in range(dims)] if segments else [[]] * dims
        longest = max(1, max(map(len, lists), default=1))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.most, self.ends = np.zeros((dims, longest)), np.zeros((dims, longest + 1), dtype=np.int64)
        for d, own in enumerate(lists):
            if own:
                self.most[d, : len(own)] = impact[own] * width + width - 1
                self.ends[d] = ends[np.minimum(own[0] + np.arange(longest + 1), own[-1] + 1)]
        self.norms = np.einsum("ij,ij->i", points, points).astype(np.float64)

    def possible(self, query: np.ndarray, k: int, own: int, few: int) -> tuple[np.ndarray, int]:
        """The nodes that can be among the ``k`` of largest product besides node ``own`` (-1: none), and how many postings were read."""
        n, dims = len(self.norms), len(query)
        if n <= k + 1:
            return np.arange(n), 0
        size = np.abs(query).astype(np.float64)
        product = self.most * size[:, None]
        total = float((size**2).sum())
        # Twice the product of two norms is at most c times the square of one and 1 / c that of the other, so one sum tells what has not met.
        c = np.sqrt(max(float(self.norms.mean()), 1.0) / max(total, 1.0))
        score, open_mass = np.zeros(n), (c * total + self.norms / c) / 2
        opened, every = np.zeros(dims, dtype=np.int64), np.arange(dims)
        padded = np.append(product, np.zeros((dims, 1)), axis=1)
        read, limit = 0, float(product.max())
        few_best, kth = min(n, 8 * (k + 1)), -np.inf
        while True:
            limit *= STEP
            # Segments that gain nothing, by a zero in the query, are never opened.
            want = (product > limit).sum(axis=1)
            start, stop = self.ends[every, opened], self.ends[every, want]
            opened, length = want, stop - start
            if length.any():
                # A list's next segments lie side by side.
                parts = [slice(a, b) for a, b in zip(start.tolist(), stop.tolist()) if b > a]
                node, value, inner = (np.concatenate([x[p] for p in parts]) for x in (self.members, self.value, self.inner))
                value *= np.repeat(query, length)
                inner /= c
                inner += np.repeat(c / 2 * size**2, length)
                read += len(node)
                score += np.bincount(node, value, n)
                open_mass -= np.bincount(node, inner, n)
            left = padded[every, opened].sum()
            # What a node may still gain or lose: no more than all lists still hold, nor than the norms of what has not met.
            rest = np.minimum(left, np.maximum(open_mass, 0))
            error = self.half * size.sum() + 1e-9 * (np.abs(score) + total + self.norms + c * total + self.norms / c)
            # The k-th of a few exact products, those that look best so far, is a bound that every member reaches.
            best = np.argpartition(score, n - few_best)[n - few_best :]
            exact = self.points[best] @ query
            exact = np.sort(exact[best != own])
            kth = max(kth, float(exact[-k]))
            stay = score + rest + error >= kth
            if left == 0 or stay.sum() <= few:
                return np.flatnonzero(stay), read


def _nodes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite() & (F.size("vector") > 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = materialize(rows.withColumn("dims", F.size("vector")))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    ids = F.sort_array(F.collect_list("vec_id")).alias("ids")
    return rows, materialize(rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("vector", "dims").agg(ids))


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS, levels: int = LEVELS, scale: int = SCALE) -> DataFrame:
    """Shards of ``nodes`` (vector, dims, ids) as a written table: a row for each node and one for each segment."""
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        if rows["dims"].iloc[0] > MOST_DIMS:
            raise ValueError(f"at most {MOST_DIMS} components")
        rows = rows.assign(first=[x[0] for x in rows["ids"]]).sort_values("first").reset_index(drop=True)
        points, wide = floors(np.array(rows["vector"].tolist()), scale, WIDE)
        narrow = np.array([w is None for w in wide])
        width = max(1, -(-(int(np.abs(points).max()) + 1) // levels))
        segments = []
        for d in range(points.shape[1]):
            # Zeros gain nothing and are in no list; wide nodes are always possible members.
            for sign in (-1, 1):
                at = np.flatnonzero(narrow & (np.sign(points[:, d]) == sign))
                level = np.abs(points[at, d]) // width
                order = np.argsort(level, kind="stable")
                cuts = np.flatnonzero(np.diff(level[order])) + 1
                segments += [(d, int(level[s[0]]), sign, at[s].astype(np.int32)) for s in np.split(order, cuts) if len(s)]
        lists = pd.DataFrame(segments, columns=["dimension", "impact", "sign", "members"])
        held = pd.DataFrame({"part": range(len(rows)), "ids": rows["ids"], "vector": rows["vector"]})
        lists = lists.assign(part=-width)
        both = pd.concat([held, lists], ignore_index=True).assign(shard=key[0], dims=key[1])
        for name in ("ids", "vector", "members"):
            both[name] = [x if isinstance(x, np.ndarray) else None for x in both.get(name, [None] * len(both))]
        return both.astype({"dimension": "Int32", "impact": "Int32", "sign": "Int32"})[[c.split()[0] for c in INDEX.split(", ")]]

    return materialize(dealt.groupBy("shard", "dims").applyInPandas(build, INDEX))


class Shard:
    """A shard as a task holds it."""

    def __init__(self, rows: list[pd.DataFrame], scale: int):
        rows = pd.concat(rows, ignore_index=True)
        held = rows[rows["part"] >= 0].sort_values("part")
        self.ids = held["ids"].tolist()
        self.scale = scale
        self.points, self.wide = floors(np.array(held["vector"].tolist()), scale, WIDE)
        self.large = np.array([i for i, w in enumerate(self.wide) if w is not None], dtype=np.int64)
        self.node = {i: at for at, ids in enumerate(self.ids) for i in ids}
        lists = rows[rows["part"] < 0]
        width = -int(lists["part"].iloc[0]) if len(lists) else 1
        self.postings = Postings(self.points, list(zip(lists["dimension"].astype(int), lists["impact"].astype(int), lists["sign"].astype(int), lists["members"])), width)

    def search(self, query_id: int, vector: np.ndarray, k: int, few: float = FEW) -> list[tuple[int, int, int]]:
        """The shard's ``k`` best for a query besides itself: (query_id, vec_id, score), exactly."""
        (query,), (wide,) = floors(vector[None, :], self.scale, WIDE)
        own = self.node.get(query_id, -1)
        if wide is None:
            at, _ = self.postings.possible(query, k, own if own >= 0 and len(self.ids[own]) == 1 else -1, max(4 * k, int(few * len(self.ids))))
            at = np.union1d(at, self.large)
        else:
            at = np.arange(len(self.ids))
        score = (self.points[at] @ query).tolist()
        for i, node in enumerate(at):
            if wide is not None or self.wide[node] is not None:
                score[i] = sum(a * b for a, b in zip(wide or query.tolist(), self.wide[node] or self.points[node].tolist()))
        pairs = [(-s, i) for s, node in zip(score, at) for i in self.ids[node] if i != query_id]
        return [(query_id, i, -s) for s, i in sorted(pairs)[:k]]


def search_index(index: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """The ``k`` rows of largest product for each query (vec_id, vector, dims): (query_id, rank, vec_id, score).

    Every shard is sent to a task once and the queries stream past it, so a task holds one shard and one batch.
    """
    shards = index.select("shard", "dims").distinct()
    # One row for each shard: a query of a length goes to the shards of that length.
    lengths = materialize(shards.groupBy("dims").agg(F.collect_list("shard").alias("shards")))
    asked = queries.join(lengths, "dims").select(F.explode("shards").alias("shard"), "dims", F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    held = index.withColumn("kind", F.lit(0))
    # More partitions than shards, so few tasks get two.
    count = 4 * max(1, lengths.agg(F.sum(F.size("shards"))).first()[0] or 0)
    both = held.unionByName(asked, allowMissingColumns=True).repartition(count, "shard", "dims").sortWithinPartitions("shard", "dims", "kind")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, shard = None, [], None
        for batch in batches:
            out = []
            for part_key, part in batch.groupby(["shard", "dims"], sort=False):
                if part_key != key:
                    key, rows, shard = part_key, [], None
                kept, wanted = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(kept):
                    rows.append(kept)
                if len(wanted):
                    if shard is None:
                        shard, rows = Shard(rows, scale), []
                    for query_id, query in zip(wanted["query_id"], wanted["query"]):
                        out += shard.search(int(query_id), np.asarray(query, dtype=np.float64), k)
            yield pd.DataFrame(
                {
                    "query_id": [q for q, _, _ in out], "vec_id": [i for _, i, _ in out], "size": pd.Series([_sortable(s) for _, _, s in out], dtype=object),
                    "score": pd.array([s if -(1 << 63) <= s < 1 << 63 else None for _, _, s in out], dtype="Int64"),
                }
            )[["query_id", "vec_id", "score", "size"]]

    order = Window.partitionBy("query_id").orderBy(F.desc("size"), "vec_id")
    met = both.mapInPandas(search, FOUND)
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sortable(number: int) -> str:
    """A text that sorts as the number does, of whatever size."""
    digits = str(abs(number))
    if number >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


def nearest(vectors: DataFrame, query_every: int, k: int = K, shard_rows: int = SHARD_ROWS, scale: int = SCALE) -> DataFrame:
    """Search every row of ``vectors`` (vec_id, embedding) whose id is divisible by ``query_every`` among all others, by the product of whole components.

    Gives (query_id, rank, vec_id, score): the ``k`` highest scores, all if there are fewer, ties to the smaller id. Rows without an
    id, or whose vector is null, empty or holds a null or non-finite component neither ask nor answer; zero vectors do. Repeated rows count
    once; of several vectors under one id the smallest in array order is taken; vectors of different length never meet;
    components of any size are exact, and a score that doesn't fit a long is ranked and null; other columns are ignored; no rows give no rows.
    """
    rows, nodes = _nodes(vectors, k)
    index = build_index(nodes, shard_rows, scale=scale)
    return search_index(index, rows.filter(F.col("vec_id") % query_every == 0), k, scale)

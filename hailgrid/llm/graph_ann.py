"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. In a shard, points
enter the graph in batches: a greedy search from the medoid proposes neighbours, and
relaxed distance pruning keeps an edge only if no kept one is ``ALPHA`` times nearer to its end, so
edges stay diverse. Every query then goes through every shard by beam search, and the shards' nearest are merged.

Distances in a graph are 32-bit. So that neither large nor small components lose them, a shard holds vectors of about the same
magnitude, scaled by a power of two; a query of another magnitude is compared with every row of the shard, exactly.

Rows with equal vectors are one node that carries its smallest ids, as many as a
result can show, so groups of copies neither fill a shard nor hide each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hailgrid.llm.vectors import usable
from hailgrid.session import materialize

SHARD_ROWS = 4096
QUERY_BLOCK = 1024
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
# Points that search and enter together, and nodes that one step of a search opens.
BATCH = 256
STRIDE = 4

# Vectors whose largest components lie within so many powers of two are of one magnitude; 0 is that of components about 1.
MAGNITUDE_BITS = 48

INDEX = "shard long, dims int, magnitude int, node int, entry boolean, ids array<long>, vector array<double>, edges array<int>"
FOUND = "query_id long, vec_id long, score double"


def magnitude(vectors: np.ndarray) -> np.ndarray:
    """The magnitude of each row."""
    exponent = np.frexp(np.abs(vectors).max(axis=1))[1]
    return (exponent + MAGNITUDE_BITS // 2) // MAGNITUDE_BITS


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, scaled where squares would overflow."""
    with np.errstate(over="ignore"):
        d = np.sqrt(((rows - query) ** 2).sum(axis=1))
    if not np.isfinite(d).all():
        large = ~np.isfinite(d)
        d[large] = np.ldexp(np.sqrt(((np.ldexp(rows[large], -600) - np.ldexp(query, -600)) ** 2).sum(axis=1)), 600)
    return d


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met by each query, nearest first: (nodes, squared distances); -1 and inf pad.

    ``edges`` is nodes x degree, padded with -1.
    """
    count, n = len(queries), len(points)
    seen = np.zeros((count, n + 1), dtype=bool)
    seen[:, n] = True
    rows = np.arange(count)[:, None]
    nodes = np.full((count, beam), -1, dtype=np.int64)
    far = np.full((count, beam), np.inf, dtype=np.float32)
    opened = np.ones((count, beam), dtype=bool)
    nodes[:, 0], opened[:, 0], seen[:, entry] = entry, False, True
    far[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    while True:
        # The nearest nodes that are not open yet, at most STRIDE a query.
        rank = np.where(opened, beam, np.arange(beam)[None, :])
        pick = np.sort(rank, axis=1)[:, :STRIDE]
        live = pick < beam
        active = live.any(axis=1)
        if not active.any():
            return nodes, far
        chosen = np.where(live, np.take_along_axis(nodes, np.minimum(pick, beam - 1), axis=1), -1)
        r, c = np.nonzero(live)
        opened[r, pick[r, c]] = True
        near = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(count, -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[rows, near]] = n
        seen[rows, near] = True
        ends = near < n
        r, c = np.nonzero(ends)
        there = near[r, c]
        d = np.full(near.shape, np.inf, dtype=np.float32)
        gap = points[there] - queries[r]
        d[r, c] = np.einsum("ij,ij->i", gap, gap)
        nodes = np.concatenate([nodes, np.where(ends, near, -1)], axis=1)
        far = np.concatenate([far, d], axis=1)
        opened = np.concatenate([opened, ~ends], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        nodes, far, opened = (np.take_along_axis(x, order, axis=1) for x in (nodes, far, opened))


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Choose edges for the nodes ``own`` from ``candidates`` (nodes x many, padded with -1)."""
    ends = np.where(candidates == own[:, None], -1, candidates)
    ends = np.sort(ends, axis=1)
    ends[:, 1:][ends[:, 1:] == ends[:, :-1]] = -1
    at = points[np.maximum(ends, 0)]
    gap = at - points[own][:, None, :]
    d = np.where(ends < 0, np.inf, np.einsum("ijk,ijk->ij", gap, gap))
    norm = np.einsum("ijk,ijk->ij", at, at)
    between = norm[:, :, None] + norm[:, None, :] - 2 * (at @ at.transpose(0, 2, 1))
    chosen = np.full((len(own), degree), -1, dtype=np.int64)
    rows = np.arange(len(own))
    left = d.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        chosen[ok, k] = ends[rows[ok], best[ok]]
        # Squared distances, so the factor is squared too.
        covered = alpha * alpha * between[rows, best] <= d
        left[covered & ok[:, None]] = np.inf
        left[rows[ok], best[ok]] = np.inf
    return chosen


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (nodes x degree, padded with -1) and the entry node, the point nearest to the mean."""
    n = len(points)
    middle = points - points.mean(axis=0)
    entry = int(np.einsum("ij,ij->i", middle, middle).argmin())
    draw = np.random.default_rng(n)
    edges = np.full((n, degree), -1, dtype=np.int64)
    start = min(degree // 2, n - 1)
    if start > 0:
        edges[:, :start] = draw.integers(0, n, (n, start))
        edges[:, 0] = (np.arange(n) + 1) % n
        edges[edges == np.arange(n)[:, None]] = -1
    order = draw.permutation(n)
    for at in range(0, n, BATCH):
        batch = order[at : at + BATCH]
        nodes, _ = beam_search(points, edges, entry, points[batch], beam)
        edges[batch] = robust_prune(points, batch, np.concatenate([nodes, edges[batch]], axis=1), degree, alpha)
        # Every new edge is offered to its end as an edge back.
        r, c = np.nonzero(edges[batch] >= 0)
        ends, back = edges[batch][r, c], batch[r]
        sort = np.argsort(ends, kind="stable")
        ends, back = ends[sort], back[sort]
        which, first, count = np.unique(ends, return_index=True, return_counts=True)
        offered = np.full((len(which), int(count.max()) if len(count) else 0), -1, dtype=np.int64)
        group = np.repeat(np.arange(len(which)), count)
        offered[group, np.arange(len(ends)) - first[group]] = back
        for a in range(0, len(which), BATCH):
            some = which[a : a + BATCH]
            both = np.concatenate([edges[some], offered[a : a + BATCH]], axis=1)
            if both.shape[1] > beam + degree:
                gap = points[np.maximum(both, 0)] - points[some][:, None, :]
                d = np.where(both < 0, np.inf, np.einsum("ijk,ijk->ij", gap, gap))
                both = np.take_along_axis(both, np.argsort(d, axis=1)[:, : beam + degree], axis=1)
            edges[some] = robust_prune(points, some, both, degree, alpha)
    return edges, entry


def build_index(
    vectors: DataFrame,
    k: int,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = BUILD_BEAM,
    alpha: float = ALPHA,
) -> DataFrame:
    """Index every row of ``vectors`` (vec_id, vector, dims), written to the shared folder.

    A node keeps the ``k + 1`` smallest ids of its vector: a query shows ``k`` of them at most, and one may be its own.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = vectors.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("vector", "dims").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes)
    shards = max(1, -(-nodes.count() // shard_rows))
    largest = F.array_max(F.transform("vector", F.abs))
    # The same as ``magnitude`` but for rounding at its bounds, so a shard's own is kept with it.
    level = F.floor((F.floor(F.log2(largest)) + 1 + MAGNITUDE_BITS // 2) / MAGNITUDE_BITS).cast("int")
    dealt = nodes.withColumns({"shard": F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)), "magnitude": level})

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[x[0] for x in rows["ids"]]).sort_values("first").reset_index(drop=True)
        exact = np.array(rows["vector"].tolist(), dtype=np.float64)
        edges, entry = build_graph(_scaled(exact, key[2]), degree, beam, alpha)
        return pd.DataFrame(
            {
                "shard": key[0], "dims": key[1], "magnitude": key[2], "node": range(len(rows)), "entry": np.arange(len(rows)) == entry,
                "ids": rows["ids"], "vector": rows["vector"], "edges": [x[x >= 0] for x in edges.astype(np.int32)],
            }
        )

    return materialize(dealt.groupBy("shard", "dims", "magnitude").applyInPandas(build, INDEX))


def _scaled(vectors: np.ndarray, level: int) -> np.ndarray:
    return np.ldexp(vectors, -MAGNITUDE_BITS * int(level)).astype(np.float32)


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of the index for each query (vec_id, vector, dims): (query_id, rank, vec_id, score).

    Queries meet shards in blocks, so a task holds one shard and at most about one block. The shards of one number, as many as
    there are magnitudes, are searched one after the other.
    """
    blocks = max(1, -(-queries.count() // query_block))
    last = index.agg(F.max("shard")).first()[0] or 0
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(key, nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        wanted = np.array(asked["vector"].tolist(), dtype=np.float64)
        levels = magnitude(wanted)
        out = []
        for level, part in nodes.groupby("magnitude"):
            part = part.sort_values("node")
            exact = np.array(part["vector"].tolist(), dtype=np.float64)
            ids = part["ids"].tolist()
            for at, near in _candidates(part, exact, int(level), wanted, levels, k, beam):
                query, d = asked["vec_id"].iloc[at], distances(exact[near], wanted[at])
                order = np.argsort(d, kind="stable")
                pairs = [(x, i) for x, node in zip(d[order], near[order]) for i in ids[node] if i != query]
                out += [(query, i, x) for x, i in sorted(pairs)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    met = held.groupBy("shard", "dims", "block").cogroup(asked.groupBy("shard", "dims", "block")).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates(part: pd.DataFrame, exact: np.ndarray, level: int, wanted: np.ndarray, levels: np.ndarray, k: int, beam: int):
    """(query, nodes) of a shard: those the beam met for a query of the shard's magnitude, all for others."""
    edges = np.full((len(part), max(1, max(map(len, part["edges"])))), -1, dtype=np.int64)
    for i, x in enumerate(part["edges"]):
        edges[i, : len(x)] = x
    entry = int(part["entry"].to_numpy().argmax())
    points, same = _scaled(exact, level), np.flatnonzero(levels == level)
    for start in range(0, len(same), BATCH):
        some = same[start : start + BATCH]
        found, _ = beam_search(points, edges, entry, _scaled(wanted[some], level), min(max(beam, k + 1), len(part)))
        for at, near in zip(some, found):
            yield at, near[near >= 0]
    for at in np.flatnonzero(levels != level):
        yield at, np.arange(len(part))


def nearest(vectors: DataFrame, query_every: int, k: int = 10, **settings) -> DataFrame:
    """Search every row whose id is divisible by ``query_every`` among all others.

    Unusable vectors (``vectors.usable``) neither ask nor answer; with fewer than ``k`` other rows all are
    returned; ties go to the smaller id; vectors of different length never meet; extra columns are ignored; no rows give no rows.
    """
    rows = usable(vectors)
    index = build_index(rows, k, **settings)
    return search_index(index, rows.filter(F.col("vec_id") % query_every == 0), k)

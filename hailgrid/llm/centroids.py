"""Centroid clustering of integer vectors with ns-bounds.

Every vector keeps, for each centroid, the distance at which it was last evaluated and the round of that. The
history of all centroids is kept as well, so a stored distance is loosened by the norm of the centroid's total
displacement since that round, which is never more than the sum of its moves round by round. Only centroids whose bound
no longer proves them farther than the vector's own are evaluated again, in exact integers; so the
assignment is that of a full scan, ties included.

A round is one pass over a written table. Cluster sums are kept up to date by the vectors that have moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailgrid.llm.vectors import finite, floors
from hailgrid.session import discard, materialize, written

SCALE = 256
CENTROIDS = 40
ROUNDS = 5
DIMS = 64
# From this size on a component is handled as a Python integer: below it, squared distances of up to MOST_DIMS components fit 64 bits.
WIDE = 1 << 25
MOST_DIMS = 1 << 10
# Bounds are kept in 32 bits; so much of a value covers their rounding and that of the displacements.
SLACK = 1e-6

STATE = "vec_id long, vector array<int>, wide array<string>, cluster int, before int, low array<float>, at array<smallint>"
PARTIAL = "cluster int, n long, sums array<string>"
SCORED = "vec_id long, cluster int, square decimal(38,0)"


class Centroids:
    """The centroids of one round, as 64-bit integers where they fit."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.wide = [any(abs(c) >= WIDE for c in r) for r in rows]
        self.narrow = [None if w else np.array(r, dtype=np.int64) for r, w in zip(rows, self.wide)]

    def squares(self, j: int, points: np.ndarray, wide: list) -> np.ndarray:
        """Squared distances of points to centroid ``j``; Python's integers if any of them or the centroid is wide."""
        if not self.wide[j] and not any(w is not None for w in wide):
            gap = points - self.narrow[j]
            return np.einsum("ij,ij->i", gap, gap)
        rows = [p if w is None else w for p, w in zip(points.tolist(), wide)]
        out = np.empty(len(rows), dtype=object)
        out[:] = [sum((a - b) ** 2 for a, b in zip(r, self.rows[j])) for r in rows]
        return out


def norm(square: int) -> float:
    try:
        return math.sqrt(square)
    except OverflowError:
        return math.inf


def displacements(history: list[Centroids]) -> np.ndarray:
    """(round, centroid): how far each centroid lies from where it was in that round."""
    return np.array([[norm(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(then.rows, history[-1].rows)] for then in history])


def reassign(points: np.ndarray, wide: list, cluster: np.ndarray, low: np.ndarray, at: np.ndarray, now: Centroids, moved: np.ndarray) -> int:
    """Assign points to their nearest centroids, in place; the number of distances evaluated is returned.

    ``low`` and ``at`` (points x centroids) hold distances and the rounds they are of, ``moved`` what ``displacements`` gives.
    A distance that is not a number stands for one never evaluated, or too large to be kept.
    """
    count, k = low.shape
    rows, t = np.arange(count), len(moved) - 1
    way = moved[at, np.arange(k)] * (1 + SLACK)
    least = low * (1 - SLACK) - way
    own = (low[rows, cluster] * (1 + SLACK) + way[rows, cluster])[:, None]
    # Also true where a bound is not a number.
    fails = ~(least > own)
    fails[rows, cluster] = False
    best = np.zeros(count, dtype=object if any(now.wide) or any(w is not None for w in wide) else np.int64)
    evaluated = 0

    def evaluate(j: int, who: np.ndarray) -> np.ndarray:
        square = now.squares(j, points[who], [wide[i] for i in who] if best.dtype == object else [])
        low[who, j], at[who, j] = [norm(s) for s in square] if square.dtype == object else np.sqrt(square), t
        return square

    # The own centroid first: its exact distance may save the others.
    loose = fails.any(axis=1)
    for j in np.unique(cluster[loose]):
        who = np.flatnonzero(loose & (cluster == j))
        best[who] = evaluate(j, who)
        evaluated += len(who)
    fails &= ~(least > (low[rows, cluster] * (1 + SLACK))[:, None])
    for j in range(k):
        who = np.flatnonzero(fails[:, j])
        if len(who):
            square = evaluate(j, who)
            better = (square < best[who]) | ((square == best[who]) & (j < cluster[who]))
            best[who[better]], cluster[who[better]] = square[better], j
            evaluated += len(who)
    return evaluated


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=dtype).reshape(len(column), -1)


def _wide(column: pa.Array) -> list:
    if column.null_count == len(column):
        return [None] * len(column)
    return [None if row is None else [int(c) for c in row] for row in column.to_pylist()]


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), type=kind))


def starting_state(vectors: DataFrame, k: int, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Integer vectors of the rows that take part, none of them assigned."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    kept = kept.filter((F.size("vector") == dims) & finite())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            points, wide = floors(_matrix(batch.column("vector"), np.float64), scale, WIDE)
            none = np.full(n, -1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), _lists(points.astype(np.int32), pa.int32()),
                    pa.array([None if w is None else [str(c) for c in w] for w in wide], type=pa.list_(pa.string())),
                    pa.array(none), pa.array(none), _lists(np.full((n, k), np.nan, dtype=np.float32), pa.float32()), _lists(np.zeros((n, k), dtype=np.int16), pa.int16()),
                ],
                names=["vec_id", "vector", "wide", "cluster", "before", "low", "at"],
            )

    return kept.mapInArrow(run, STATE)


def assigned(state: DataFrame, history: list[Centroids]) -> DataFrame:
    """The state after one more assignment, to the last centroids of the history."""
    now, moved = history[-1], displacements(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            points, wide = _matrix(batch.column("vector"), np.int64), _wide(batch.column("wide"))
            before = np.array(batch.column("cluster"))
            cluster, low, at = np.maximum(before, 0), _matrix(batch.column("low"), np.float64), _matrix(batch.column("at"), np.int16)
            reassign(points, wide, cluster, low, at, now, moved)
            with np.errstate(over="ignore"):
                low = low.astype(np.float32)
            low[~np.isfinite(low)] = np.nan
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), batch.column("wide"), pa.array(cluster), pa.array(before), _lists(low, pa.float32()), _lists(at, pa.int16())],
                names=["vec_id", "vector", "wide", "cluster", "before", "low", "at"],
            )

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, dims: int = DIMS) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how many vectors it has won, net, and what they add to its sums. A task gives a row for each cluster at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        wides: dict[int, list[int]] = {}
        for batch in batches:
            points, wide = _matrix(batch.column("vector"), np.int64), _wide(batch.column("wide"))
            for name, sign in (("cluster", 1), ("before", -1)):
                at = np.array(batch.column(name))
                inside = at >= 0
                np.add.at(count, at[inside], sign)
                np.add.at(sums, at[inside], sign * points[inside])
                for i, w in enumerate(wide):
                    if w is not None and at[i] >= 0:
                        wides[at[i]] = [a + sign * b for a, b in zip(wides.get(at[i], [0] * dims), w)]
        rows = [(j, int(count[j]), [str(a + b) for a, b in zip(sums[j].tolist(), wides.get(j, [0] * dims))]) for j in range(k)]
        table = pd.DataFrame([r for r in rows if r[1] or any(c != "0" for c in r[2])], columns=["cluster", "n", "sums"])
        yield pa.RecordBatch.from_pandas(table, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]), preserve_index=False)

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [str(sum(map(int, c))) for c in zip(*rows["sums"])]
        return pd.DataFrame({"cluster": rows["cluster"][:1], "n": [int(rows["n"].sum())], "sums": [sums]})

    partial = state.filter("cluster <> before").select("vector", "wide", "cluster", "before").mapInArrow(add, PARTIAL)
    return {r.cluster: (r.n, [int(c) for c in r.sums]) for r in partial.groupBy("cluster").applyInPandas(total, PARTIAL).collect()}


def first_centroids(state: DataFrame, k: int, seed: int = 2) -> list[list[int]]:
    """The ``k`` vectors whose seeded ids have the smallest hashes, in their order; ties by vector, rows without an id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = state.orderBy(key.asc_nulls_last(), "vector", "wide").limit(k).select("vector", "wide").collect()
    return [[int(c) for c in (r.wide or r.vector)] for r in rows]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row of ``vectors`` (vec_id, embedding) that takes part.

    Rows whose vector is null, of another length, or holds a null or non-finite component take no part; a zero vector does. Every
    row counts, repeated ones too; one without an id is assigned but is no first centroid unless fewer than ``k`` others
    are there; with fewer than ``k`` rows each starts a cluster; no rows give no rows; other columns are ignored. Components
    of any size are exact; a distance or sum that doesn't fit a long is null.
    """
    if dims > MOST_DIMS:
        raise ValueError(f"at most {MOST_DIMS} components")
    spark = vectors.sparkSession
    state, path = written(starting_state(vectors, k, dims, scale))
    first = first_centroids(state, k, seed)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if len(first) < k:  # a vector keeps as many bounds as there are centroids
        discard(spark, path)
        k = len(first)
        state, path = written(starting_state(vectors, k, dims, scale))
    history = [Centroids(first)]
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    for t in range(rounds + 1):
        last = path
        state, path = written(assigned(state, history))
        discard(spark, last)
        if t == rounds:
            break
        for j, (n, add) in changes(state, k, dims).items():
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], add)]
        rows = [[c // n for c in s] if n else old for n, s, old in zip(counts, sums, history[-1].rows)]
        history.append(Centroids(rows))
    return _scored(state, history[-1])


def _scored(state: DataFrame, now: Centroids) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, wide, cluster = _matrix(batch.column("vector"), np.int64), _wide(batch.column("wide")), np.array(batch.column("cluster"))
            square = np.zeros(len(cluster), dtype=object)
            for j in np.unique(cluster):
                who = np.flatnonzero(cluster == j)
                square[who] = now.squares(j, points[who], [wide[i] for i in who])
            exact = [Decimal(int(s)) if s < 10**38 else None for s in square]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(exact, type=pa.decimal128(38, 0))], names=["vec_id", "cluster", "square"])

    spark = state.sparkSession
    scored = materialize(state.select("vec_id", "vector", "wide", "cluster").mapInArrow(run, SCORED))
    # One row for each cluster; a sum is left out if a distance of it is.
    sums = {r.cluster: r.of_cluster for r in scored.groupBy("cluster").agg(F.when(F.count("square") == F.count("*"), F.sum("square")).alias("of_cluster")).collect()}
    whole = None if None in sums.values() else int(sum(sums.values()))
    told = [
        (j, _long(of_cluster), _long(whole), hashlib.sha256(",".join(map(str, now.rows[j])).encode()).hexdigest()) for j, of_cluster in sums.items()
    ]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    distance = F.expr("try_cast(square AS long)").alias("distance")
    return scored.join(F.broadcast(told), "cluster").select("vec_id", "cluster", distance, "cluster_inertia", "inertia", "centroid_sha256")


def _long(value) -> int | None:
    return int(value) if value is not None and value < 1 << 63 else None

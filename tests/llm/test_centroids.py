"""Centroid clustering against a plain re-computation with Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from hailgrid.llm import centroids
from hailgrid.llm.vectors import floors

FOLDER = "/root/testdata/sf0.01"


def whole(x):
    return [math.floor(c * 256) if abs(c) < 1e300 else int(c) * 256 for c in x]


def plain(rows, k, rounds, seed=2):
    """[(id, cluster, square)] and the final centroids."""
    kept = [(i, whole(v)) for i, v in rows]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in first[:k]]
    for t in range(rounds + 1):
        at = [min((square(v, c), j) for j, c in enumerate(middle)) for _, v in kept]
        if t == rounds:
            return [(i, j, s) for (i, _), (s, j) in zip(kept, at)], middle
        for j in range(len(middle)):
            own = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if own:
                middle[j] = [sum(c) // len(own) for c in zip(*own)]


def check(got, want, middle):
    total = {}
    for _, j, s in want:
        total[j] = total.get(j, 0) + s
    long = lambda v: v if v < 1 << 63 else None
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    expected = [(i, j, long(s), long(total[j]), long(sum(total.values())), hashes[j]) for i, j, s in want]
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(expected, key=order)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double, j int")


@pytest.mark.parametrize("k, rounds", [(40, 5), (7, 3)])
def test_given_vectors(spark, k, rounds):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    check(centroids.cluster(vectors, k, rounds), *plain(rows, k, rounds))


def test_ties_copies_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) / 256 for c in rng.integers(-2, 3, 3)]) for i in range(200)] + [(300 + i, [0.0, 0.0, 0.0]) for i in range(100)]
    rows += [(7, rows[7][1]), (None, [1.0, 0.0, -0.001])]
    out = [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 2.0]), (503, [1.0, float("nan"), 2.0]), (504, [1.0, float("inf"), 2.0]), (505, [])]
    check(centroids.cluster(frame(spark, rows + out).repartition(5), 6, 4, dims=3), *plain(rows, 6, 4))


@pytest.mark.parametrize("large", [3e5, 1e25, 1e300])
def test_large_components(spark, large):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100, [large, 0.0, 0.5, -large]), (101, [-large, 1.0, 0.0, 0.1])]
    check(centroids.cluster(frame(spark, rows), 8, 4, dims=4), *plain(rows, 8, 4))


def test_few_rows_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.1, 0.2]), (3, [0.1, 0.2])]
    check(centroids.cluster(frame(spark, rows), 40, 5, dims=2), *plain(rows, 40, 5))
    assert centroids.cluster(frame(spark, []), dims=2).collect() == []


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] * 100 + rng.normal(size=(3000, 16)) * 20).astype(np.int64)
    k, wide = 20, [None] * len(points)
    middle = points[:k].tolist()
    history = []
    cluster, low, at = np.zeros(len(points), dtype=np.int32), np.full((len(points), k), np.nan), np.zeros((len(points), k), dtype=np.int16)
    evaluated = []
    for t in range(10):
        history.append(centroids.Centroids(middle))
        evaluated.append(centroids.reassign(points, wide, cluster, low, at, history[-1], centroids.displacements(history)))
        low = low.astype(np.float32).astype(np.float64)
        square = ((points[:, None, :] - np.array(middle)[None]) ** 2).sum(axis=2)
        assert (cluster == square.argmin(axis=1)).all()
        middle = [(points[cluster == j].sum(axis=0) // max(1, (cluster == j).sum())).tolist() if (cluster == j).any() else middle[j] for j in range(k)]
    assert evaluated[0] == points.shape[0] * k and sum(evaluated[5:]) < 0.2 * 5 * evaluated[0]


def test_displacement_is_total_not_summed():
    there, back = centroids.Centroids([[0, 0]]), centroids.Centroids([[30, 40]])
    assert centroids.displacements([there, back, there])[:, 0].tolist() == [0.0, 50.0, 0.0]


def test_floors_are_exact():
    x = np.array([[0.1, -0.1, 1e-320, -1e-320], [2.0**20, 1e308, -1e308, 0.5]])
    small, exact = floors(x, 256, 1 << 25)
    assert small[0].tolist() == [25, -26, 0, -1] and exact[0] is None
    assert exact[1] == [2**28, int(1e308) * 256, -int(1e308) * 256, 128] and not small[1].any()

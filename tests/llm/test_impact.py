"""Impact-ordered top-k search against all products, with Python's integers."""

import math

import numpy as np
import pytest

from hailgrid.llm import impact

FOLDER = "/root/testdata/sf0.01"


def plain(rows, every, k):
    whole = {i: [math.floor(c * 256) if abs(c) < 1e300 else int(c) * 256 for c in v] for i, v in rows}
    out = []
    for q, a in whole.items():
        if q % every == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q and len(a) == len(b))[:k]
            out += [(q, rank, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for rank, (s, i) in enumerate(near, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in rows], "vec_id long, embedding array<double>, shard int, members string, score double")


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_given_vectors(spark, shard_rows):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert found(impact.nearest(vectors, 50, 5, shard_rows)) == plain(rows, 50, 5)


def test_ties_copies_and_zero_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) / 256 for c in rng.integers(-2, 3, 4)]) for i in range(300)] + [(1000 + i, [0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(2000 + i, [0.01, 0.01, 0.0, -0.01]) for i in range(200)]
    for shard_rows in (8192, 50):
        assert found(impact.nearest(frame(spark, rows + rows[:20]).repartition(3), 10, 5, shard_rows)) == plain(rows, 10, 5)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [0.0, 0.0]), (2, [1.0, 2.0, 3.0]), (100, [1.0, -2.0, 0.5])]
    out = [(150, None), (200, []), (250, [None, 1.0]), (300, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    assert found(impact.nearest(frame(spark, rows + out), 50, 5)) == plain(rows, 50, 5)
    assert found(impact.nearest(frame(spark, rows[:1]), 50, 5)) == []
    assert found(impact.nearest(frame(spark, []), 50, 5)) == []


@pytest.mark.parametrize("large", [3e5, 1e25, 1e300])
def test_large_components(spark, large):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(100)] + [(100, [large, 0.0, 0.5]), (101, [-large, 1.0, 0.1]), (150, [0.0, large, -large])]
    assert found(impact.nearest(frame(spark, rows), 50, 5)) == plain(rows, 50, 5)


def test_queries_stop_early_on_proof():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 32))
    points = np.floor((centres[rng.integers(0, 50, 4000)] + 0.2 * rng.normal(size=(4000, 32))) * 64).astype(np.int64)
    width = 2
    level = np.abs(points) // width
    segments = [(d, i, s, np.flatnonzero((np.sign(points[:, d]) == s) & (level[:, d] == i))) for d in range(32) for s in (-1, 1) for i in range(level.max() + 1)]
    postings = impact.Postings(points, [x for x in segments if len(x[3])], width)
    reads = []
    for q in range(0, 4000, 100):
        at, read = postings.possible(points[q], 5, q, 500)
        product = points @ points[q]
        product[q] = np.iinfo(np.int64).min
        assert set(np.flatnonzero(product >= np.sort(product)[-5])) <= set(at.tolist())
        reads.append(read / points.size)
    assert np.mean(reads) < 0.7 and max(reads) < 1


def test_sortable():
    numbers = [-(10**40), -1000, -999, -2, -1, 0, 1, 2, 10, 99, 100, 10**40]
    texts = [impact._sortable(n) for n in numbers]
    assert texts == sorted(texts)

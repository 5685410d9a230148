"""Vector operators against brute force, and rows that take no part."""

import numpy as np
import pytest

from hailgrid.llm import graph_ann, pivots

FOLDER = "/root/testdata/sf0.01"


def brute(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = sorted((d[j], int(ids[j])) for j in range(len(ids)) if j != i)[:k]
    return out


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 100}])
def test_ann_recall(spark, settings):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, 100, 10)
    found = {}
    for r in graph_ann.nearest(vectors, 100, 10, **settings).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == want.keys()
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 11))
        exact = {i: d for d, i in brute([x for x in rows], 100, len(rows))[q]} if q < 200 else None
        if exact:
            assert all(abs(exact[i] - s) < 1e-12 for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def odd(spark):
    rows = [(100, [1.0, 0.0]), (101, [1.0, 0.0]), (102, [1.0, 0.0]), (200, [0.0, 1.0]), (103, None), (104, [0.0, 0.0]), (105, [float("nan"), 1.0]),
            (106, [float("inf"), 1.0]), (107, [None, 1.0]), (None, [1.0, 0.0]), (108, [0.9, 0.1]), (108, [0.9, 0.1]), (109, [1.0, 0.0, 0.0])]
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, label int")


def test_ann_odd_rows(spark):
    got = sorted((r.query_id, r.rank, r.vec_id) for r in graph_ann.nearest(odd(spark), 100, 3).collect())
    assert got == [(100, 1, 101), (100, 2, 102), (100, 3, 108), (200, 1, 108), (200, 2, 100), (200, 3, 101)]
    assert graph_ann.nearest(odd(spark).filter("vec_id < 101"), 100, 3).count() == 0
    assert graph_ann.nearest(odd(spark).filter("false"), 100, 3).count() == 0


def test_ann_large_group_of_copies(spark):
    copies = spark.range(3000).selectExpr("id vec_id", "array(1.0D, 2.0D) embedding")
    got = [r for r in graph_ann.nearest(copies, 1000, 10).orderBy("query_id", "rank").collect()]
    assert [r.vec_id for r in got[:10]] == list(range(1, 11)) and [r.vec_id for r in got[10:20]] == list(range(10))
    assert {r.score for r in got} == {0.0}


@pytest.mark.parametrize("large", [1e25, 1e39, 1e300])
def test_ann_large_components(spark, large):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 8))
    x[100, 3], x[101, 0], x[200, 5], x[7] = large, -large, 1e-30, rng.normal(size=8) * 1e-20
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in graph_ann.nearest(vectors, 100, 10, shard_rows=500).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 100):
        d = graph_ann.distances(x, x[q])
        want = sorted((d[j], j) for j in range(1500) if j != q)[:10]
        got = sorted(found[q])
        assert len(got) == 10 and all(s == d[i] for _, i, s in got)
        if q == 100:
            assert [i for _, i, _ in got] == [i for _, i in want]
        hits += len({i for _, i, _ in got} & {i for _, i in want})
    assert hits >= 0.9 * 150


def components(pairs, ids):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


@pytest.mark.parametrize("settings", [{}, {"block_rows": 16}])
def test_near_duplicates(spark, settings):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    pairs = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.triu(cosine >= 0.9, 1)))]
    want = components(pairs, [i for i, _ in rows])
    degree = {}
    for p in pairs:
        for i in p:
            degree[i] = degree.get(i, 0) + 1
    found = pivots.near_duplicates(vectors, **settings).collect()
    assert len(found) == len(rows)
    assert sum(r.n_links for r in found) >= 0.9 * sum(degree.values())
    assert all(r.n_links <= degree.get(r.vec_id, 0) for r in found)
    assert sum(r.component_id == want[r.vec_id] for r in found) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_near_duplicates_odd_rows(spark):
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(odd(spark)).collect())
    by = {k[1]: rest for k, *rest in got if not k[0]}
    assert len(got) == 13
    assert by[100] == [3, 100, True] and by[102] == [3, 100, False] and by[108] == [3, 100, False]
    for alone in (103, 104, 105, 106, 107, 109, 200):
        assert by[alone] == [0, alone, True]
    assert got[-1] == ((True, 0), 0, None, True)
    assert pivots.near_duplicates(odd(spark).filter("false")).count() == 0
    copies = spark.range(5000).selectExpr("id vec_id", "array(1.0D, 2.0D) embedding")
    assert {(r.n_links, r.component_id) for r in pivots.near_duplicates(copies).collect()} == {(4999, 0)}


def test_near_duplicates_in_a_dense_group(spark):
    rng = np.random.default_rng(7)
    centre, x = np.eye(64)[0], rng.normal(size=(8000, 64))
    x[:4000, 0] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:4000] = 0.98 * centre + np.sqrt(1 - 0.98**2) * x[:4000]
    degree = (x @ x.T >= 0.9).sum(axis=1) - 1
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = pivots.near_duplicates(vectors).collect()
    assert all(r.n_links <= degree[r.vec_id] for r in found)
    assert sum(r.n_links for r in found) >= 0.9 * degree.sum()
    assert {r.component_id for r in found if r.vec_id < 4000} == {0}


def test_pivots_are_spread():
    x = np.random.default_rng(3).normal(size=(300, 16))
    x[:200] = x[0] + 0.1 * x[:200]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = pivots.spread(x, 90, 0.9)
    assert (chosen @ chosen.T - np.eye(len(chosen))).max() < 0.62 and (chosen @ x[0] > 0.62).sum() == 1
    assert len(pivots.spread(x, 20, 0.9)) == 20

"""Jaccard join: signatures by brute force, components against all pairs, odd rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hailgrid.llm import partenum

from test_vectors import components


def plain_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, words, percent):
    sets = [plain_set(t, words) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    met = {}
    for own in where.values():
        for a in range(len(own)):
            for b in range(a):
                met[own[b], own[a]] = met.get((own[b], own[a]), 0) + 1
    pairs = [p for p, n in met.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = components(pairs, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root[i], []).append(d)
    return sorted((d, len(sets[i]), min(least[root[i]])) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_documents(spark, words, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(partenum.link(docs, words, percent)) == brute(rows, words, percent)


def near_texts():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, number = [], 0
    for size in (4, 5, 7, 9, 12, 20, 40, 90, 300, 900):
        for _ in range(12):
            base = [draw.choice(vocabulary) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, size // 40, size // 25):
                text = list(base)
                for _ in range(edits):
                    at = draw.randrange(len(text))
                    text[at : at + draw.choice([0, 1])] = [draw.choice(vocabulary)] * draw.choice([0, 1])
                rows.append((number, " ".join(text)))
                number += 1
    return rows


@pytest.mark.parametrize("block_sets", [512, 3])
def test_near_texts(spark, block_sets):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(partenum.link(docs, 4, 85, block_sets)) == brute(rows, 4, 85)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (3, "one TWO"), (9, "one two three"), (10, long), (11, long + " y"), (12, "a b c d e"), (12, "a b c d e"),
            (13, "É b c d"), (14, "é b c d"), (15, "a\x0bb\x0cc\x1cd e"), (16, "a b c\x1cd e")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, k1 int, id int")
    assert found(partenum.link(docs, 4, 85)) == brute(rows, 4, 85)
    assert partenum.link(docs.filter("false"), 4, 85).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (None, "z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in partenum.link(nulls, 4, 85).collect()) == [("4", "4"), ("None", "4"), ("None", "4"), ("None", "None")]


def test_keep_one(spark):
    rows = near_texts()[:300] + [(900, None), (901, ""), (1, near_texts()[1][1])]
    docs = spark.createDataFrame([(d, t, "en", d) for d, t in rows], "doc_id long, text string, copies string, n long").repartition(3)
    kept = partenum.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    groups = brute(rows, 4, 85)
    want = sorted({c for d, n, c in groups if n} | {900, 901})
    assert sorted(r.doc_id for r in kept.collect()) == want
    same = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "q r s"), (1, "q r s"), (1, "t u v")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in partenum.keep_one(same).collect()) == [("1", "q r s"), ("1", "t u v"), ("None", "a b c d e")]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([80, 85, 90]))
def test_signatures_meet(size, seed, percent):
    """Sets at the very edge of the threshold share a signature."""
    draw = np.random.default_rng(seed)
    base = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
    common = base[: max(1, len(base))]
    extra = (len(common) * (100 - percent)) // percent
    more = np.unique(draw.integers(0, 2**63, extra).astype(np.uint64))
    for cut in (0, len(more) // 2):
        a, b = np.union1d(common, more[:cut]), np.union1d(common, more[cut:])
        if len(a) == len(b) and (a == b).all():
            continue
        all_bands = partenum.bands(percent)
        assert set(partenum.signatures(a, percent, all_bands).tolist()) & set(partenum.signatures(b, percent, all_bands).tolist())

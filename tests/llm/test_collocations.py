"""Phrase collocations against a plain count, the tries against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hailgrid.llm import collocations as co


def plain(rows, least, top=2000, words=4, covered=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            split = re.findall("[^ \t]+", piece)
            for i in range(len(split)):
                n[lang] += 1
                for m in range(1, words + 1):
                    if i + m <= len(split):
                        f[lang, tuple(split[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and 100 * a >= covered * candidates[lang, p[i:j]]:
                    gone.add((lang, p[i:j]))
    by = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, own in by.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string, number int")


def corpus(seed, size=300):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "ça", "Dé", "e-f", "g\x00", "日本", "'", "w x"] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(size):
        text = "".join(rng.choice(vocabulary[: rng.choice([4, 9, 39])]) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "?!", " \r", "\x0b"]) for _ in range(rng.choice([0, 1, 3, 40])))
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), text))
    return rows + [("en", None), ("fr", ""), ("en", "a a a a a a"), (None, "." * 50), ("de", " \t ")]


@pytest.mark.parametrize("settings", [{}, {"trie_phrases": 40, "dictionary_words": 7}])
def test_random_texts(spark, settings):
    rows = corpus(1)
    assert found(co.mine(frame(spark, rows).repartition(3), least=5, **settings)) == plain(rows, 5)


def test_top_and_ties(spark):
    rows = corpus(2)
    want = plain(rows, 4, top=7)
    assert found(co.mine(frame(spark, rows), least=4, top=7)) == want and max(r[1] for r in want) == 7


def test_very_long_text_and_copies(spark):
    rows = [("en", "one two three four five six " * 20_000)] + [("en", "one two, three")] * 40
    got = found(co.mine(frame(spark, rows)))
    assert got == plain(rows, 30) and len(got) > 0


def test_nothing_frequent(spark):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for rows in ([], [("en", None)], [("en", "a b c")], [("en", "a. b. " * 40)]):
        out = co.mine(frame(spark, rows))
        assert out.columns == names and out.collect() == []


@pytest.mark.parametrize("words, length", [(5, 2), (900, 3), (3000, 4)])
def test_trie_finds_its_phrases(words, length):
    rng = np.random.default_rng(words)
    phrases = np.unique(rng.zipf(1.3, (20_000, length)).clip(1, words), axis=0)[: 8000]
    digits = max(1, -(-words.bit_length() // co.DIGIT_BITS))
    trie = co.Trie(phrases, digits)
    ids = rng.zipf(1.3, 50_000).clip(0, words + 1)
    ids[rng.random(50_000) < 0.05] = 0
    ids[ids > words] = 0
    at, number = trie.advance(ids.astype(np.int32))
    own = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    split = ids.tolist()
    want = [(i, own[tuple(split[i : i + length])]) for i in range(len(split) - length + 1) if tuple(split[i : i + length]) in own]
    assert list(zip(at.tolist(), number.tolist())) == want and len(want) > 100
    # A state is the child of one parent only.
    used = trie.check >= 0
    assert used.sum() >= len(phrases) and (trie.number >= 0).sum() == len(phrases)


def test_a_state_with_many_children_and_full_windows():
    pairs = np.array([(1, i) for i in range(1, 60_000)] + [(i, 1) for i in range(2, 60_000)])
    trie = co.Trie(pairs, 2)
    ids = np.array([1, 59_999, 1, 2, 2, 59_999, 0, 1], dtype=np.int32)
    at, number = trie.advance(ids)
    assert at.tolist() == [0, 1, 2] and [pairs[n].tolist() for n in number] == [[1, 59_999], [59_999, 1], [1, 2]]

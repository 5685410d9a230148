"""BPE against the tiktoken library and an exact round trip."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from hailgrid.llm import bpe

RANKS = bpe.load_ranks()
LIBRARY = tiktoken.Encoding("test", pat_str=bpe.split_pattern(), mergeable_ranks=RANKS, special_tokens={})


def brute(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def texts():
    draw = random.Random(5)
    alphabet = "ab e\n\t.,'éß中\U0001f600\x1c\x85 　  12s"
    out = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(200)]
    return [*out, None, "", "x" * 5000, " " * 3000, "=" * 700 + "\n" * 900, "it's we'll <|endoftext|>", "\x00", "abc" * 40, "long wörds, 12 é\n" * 40_000]


@pytest.mark.parametrize("frequent", [200_000, 0, 50])
def test_texts(spark, frequent):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (None, "none")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, ids int").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, frequent=frequent).collect())
    assert got == sorted((str(d), *brute(t)) for d, t in rows)
    assert bpe.round_trip(docs.filter("false"), frequent=frequent).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect())
    assert got == sorted((r.doc_id, *brute(r.text)) for r in docs.collect())


def test_fold_and_merge(spark):
    draw = random.Random(9)
    words = ["a", " the", "é", " naïve", "\U0001f600", "zzzz", "x" * 40] + ["".join(draw.choice("abcdeéñtionsh ") for _ in range(draw.randrange(1, 20))) for _ in range(300)]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for r in table.select("word", bpe.fold(table["word"], RANKS).alias("ids")).collect():
        want = LIBRARY.encode_single_token(r.word) if r.word.encode() in RANKS else None
        want = [want] if want is not None else LIBRARY._core_bpe.encode_single_piece(r.word.encode())
        assert r.ids == want and bpe.merge_bytes(r.word.encode(), RANKS) == want
        assert bpe._merge_short(r.word.encode(), RANKS) == bpe._merge_long(r.word.encode(), RANKS)


def test_decode(spark):
    docs = spark.createDataFrame(list(enumerate(["héllo wörld", "", "a\nb"])), "doc_id long, text string")
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t.encode() for i, t in enumerate(["héllo wörld", "", "a\nb"])}


def test_the_dictionary_fills_up_and_never_empties(spark):
    even = spark.createDataFrame([(" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)),)] * 3, "text string")
    words = bpe.frequent_words(even, RANKS, bpe.split_pattern(), 100)
    assert 60 <= len(words) <= 140
    mixed = even.union(spark.createDataFrame([("often " * 50_000,)], "text string"))
    words = bpe.frequent_words(mixed, RANKS, bpe.split_pattern(), 100)
    assert " often" in words and 60 <= len(words) <= 140
    assert len(bpe.frequent_words(even, RANKS, bpe.split_pattern(), 10_000)) == 600
    assert bpe.frequent_words(even.filter("false"), RANKS, bpe.split_pattern()) == {}


def test_decoding_runs_no_python(spark):
    ids = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "doc_id long, ids array<int>")
    back = bpe.decode(ids)
    assert "Python" not in back._jdf.queryExecution().toString()
    pieces = bpe.pieces_of(RANKS)
    assert {r.doc_id: r.decoded if r.decoded is None else bytes(r.decoded) for r in back.collect()} == {1: pieces[5] + pieces[6], 2: b"", 3: None}

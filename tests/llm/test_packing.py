"""Packing: every id once, gapless offsets, little padding, ids equal to the tokenizer's."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hailgrid.llm import packing

SMALL = "/root/testdata/sf0.001"


def check(pieces, texts, capacity=1024):
    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {d: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length and zlib.crc32(own.tobytes()) == p.ids_crc32
        assert p.doc_tokens == len(ids[p.doc_id])
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = packing.pack(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sequences = check(pieces, texts)
    total = sum(p.length for p in pieces)
    tasks = docs.rdd.getNumPartitions()
    assert sequences * 1024 - total < 1024 * tasks


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (4, "<|endoftext|> a"), (5, "\x00é\U0001f600"), (6, "a"), (7, "a")]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, length int").repartition(1)
    check(packing.pack(docs).collect(), rows)
    assert packing.pack(docs.filter("false")).count() == 0
    twice = packing.pack(docs.filter("doc_id = 6").union(docs.filter("doc_id = 6"))).collect()
    assert len(twice) == 2
    assert packing.pack(docs.selectExpr("cast(null as long) doc_id", "text")).filter("doc_id is null").count() >= 7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_assign(lengths):
    placed = packing.assign(np.array(lengths, dtype=np.int64), 64)
    used, seen = {}, {}
    for piece, start, n, sequence, offset in placed:
        assert seen.get(piece, 0) == start and used.get(sequence, 0) == offset
        seen[piece], used[sequence] = start + n, offset + n
    assert [seen[i] for i in range(len(lengths))] == lengths
    assert sum(64 - n for n in used.values()) < 64 and all(n <= 64 for n in used.values())


def test_costs_are_balanced():
    lengths = np.array([60] * 5 + [30] * 10 + [10] * 60)
    cost = {}
    for _, _, n, sequence, _ in packing.assign(lengths, 128):
        cost[sequence] = cost.get(sequence, 0) + packing.attention_cost(n)
    first_fit = sum(cost.values()) / len(cost)
    assert max(cost.values()) <= 1.25 * first_fit


def test_ids_of_the_bytes():
    encode = packing.byte_bpe_encoder()
    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for text in ["", " ", "it's  12 ok\n\n x", "ééé ñ", "\U0001f600‍", "a" * 3000, "<|endoftext|>"]:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("with_ids", [True])
def test_pieces_carry_ids(spark, with_ids):
    docs = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    (piece,) = packing.pack(docs, with_ids=with_ids).collect()
    assert len(piece.ids) == piece.length and piece.ids[-1] == 0

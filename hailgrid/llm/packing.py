"""Cost-balanced packing of tokenized documents into fixed-length sequences.

A document's ids are cut into pieces of at most one sequence; whole sequences
stand alone. The remaining pieces of a block are assigned in descending length
to the sequence with the lowest attention cost that still has room, and a piece
that fits nowhere is cut to fill the rooms that are left, lowest cost first.
So a block wastes less than one sequence of padding.

Blocks are runs of rows inside a task: packing needs no shuffle, memory is bounded
by the block and the longest document, and a hot key has no influence. A lost task packs the same
rows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_ID = 0
# Pieces that are packed together; the memory and time of a block follow it.
BLOCK_PIECES = 4096
# Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. The first term
# stands for the feed-forward layers and the second for attention, which looks
# only within a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 512

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

OUTPUT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, cost double"
)


def attention_cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Estimated cost of a piece of ``n`` tokens."""
    return linear * n + quadratic * n * n


def assign(
    lengths: np.ndarray,
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of at most ``capacity`` tokens: (piece, start in it, length, sequence, offset).

    Pieces go in descending length, ties in their order; among sequences of equal
    cost the first is taken. Sequences are as few as the tokens need.
    """
    total = int(lengths.sum())
    count = -(-total // capacity)
    room = np.full(count, capacity, dtype=np.int64)
    cost = np.zeros(count)
    placed = []

    def put(piece: int, start: int, n: int, sequence: int) -> None:
        placed.append((piece, start, n, sequence, capacity - int(room[sequence])))
        room[sequence] -= n
        cost[sequence] += attention_cost(n, linear, quadratic)

    for piece in np.argsort(-lengths, kind="stable"):
        left, start = int(lengths[piece]), 0
        while left:
            fits = room >= left
            if fits.any():
                put(int(piece), start, left, int(np.where(fits, cost, np.inf).argmin()))
                break
            sequence = int(np.where(room > 0, cost, np.inf).argmin())
            n = int(room[sequence])
            put(int(piece), start, n, sequence)
            start, left = start + n, left - n
    return placed


def byte_bpe_encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Callable[[str], np.ndarray]:
    """Ids of ``tokenizers`` for the vocabulary file, without special tokens added.

    The rank file holds the same vocabulary, and its merges run about four times as
    fast; a text that holds the string of a special token goes through ``tokenizers``
    itself. The tests compare both over the test documents.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text).astype("<u4", copy=False)

    return encode


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe_encoder,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_pieces: int = BLOCK_PIECES,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text): one row per piece.

    A null text is empty, so the document is its end id alone; a null doc_id stays
    null; repeated rows are packed each; other columns are ignored; no rows give no rows.
    ``sequence_id`` is unique but not gapless. ``with_ids`` adds the ids of each piece.
    """
    schema = OUTPUT + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        sequence = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []
        rows: list[tuple] = []

        def row(doc, start, ids, total, sequence_id, offset):
            cells = (
                doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence_id, offset,
                attention_cost(float(len(ids)), linear, quadratic),
            )
            rows.append((*cells, ids.tolist()) if with_ids else cells)

        def frame() -> pd.DataFrame:
            names = [c.split()[0] for c in schema.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        def flush() -> None:
            nonlocal sequence
            lengths = np.array([len(p[2]) for p in pieces], dtype=np.int64)
            for piece, start, n, number, offset in assign(lengths, capacity, linear, quadratic):
                doc, at, ids, total = pieces[piece]
                row(doc, at + start, ids[start : start + n], total, sequence + number, offset)
            sequence += -(-int(lengths.sum()) // capacity)
            pieces.clear()

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                doc = None if pd.isna(doc) else int(doc)
                whole = len(ids) - len(ids) % capacity
                for at in range(0, whole, capacity):
                    row(doc, at, ids[at : at + capacity], len(ids), sequence, 0)
                    sequence += 1
                if whole < len(ids):
                    pieces.append((doc, whole, ids[whole:], len(ids)))
                if len(pieces) >= block_pieces:
                    flush()
                if len(rows) >= 20_000 or with_ids and len(rows) >= 500:
                    yield frame()
        if pieces:
            flush()
        if rows:
            yield frame()

    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInPandas(run, schema)

"""Byte-level BPE encoding and decoding by a file of ranks.

Words are the matches of the split pattern, and each is encoded separately. The distinct words of the corpus
are counted, and Spark's higher-order functions fold the ranked merges over the byte arrays of
the ``FREQUENT`` most frequent, looking pairs up in a literal rank map. Their ids go to every task, which replaces words by
ids and never sees most words' bytes. Words beyond that, rare or long, are merged where they stand, by the same
rule, so nothing depends on the dictionary but time. Decoding concatenates the pieces of the ids, by a literal array of pieces.

Bytes are written in hexadecimal within the fold and the decoding: a text of two digits a byte, so joining two pieces is joining texts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.llm.common import text_or_empty
from hailgrid.session import materialize

RANKS = "byte_bpe_multi_50k.tiktoken"
# Words whose ids every task holds, about 20 MB in all; longer words are left to the tasks.
FREQUENT = 200_000
FOLD_BYTES = 48
# The rank map is dealt to so many small maps, since looking up a key goes through the entries of a map.
MAPS = 1 << 15
REMEMBERED = 100_000
# Steps of the count to a doubling, and the shares in which the words of one step are dealt.
STEPS, SHARES = 16, 1 << 20

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, ids array<int>"


def load_ranks(name: str = RANKS) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def rank_of(piece: Column, ranks: dict[bytes, int], maps: int = MAPS) -> Column:
    """The rank of a piece in hexadecimal, from a literal array of maps; null if it has none."""
    dealt: list[dict[str, int]] = [{} for _ in range(maps)]
    for own, rank in ranks.items():
        key = own.hex()
        dealt[_slot(key, maps)][key] = rank
    table = F.from_json(F.lit(json.dumps(dealt, separators=(",", ":"))), "array<map<string,int>>")
    return F.element_at(F.get(table, F.pmod(F.xxhash64(piece), F.lit(maps)).cast("int")), piece)


def _slot(key: str, maps: int) -> int:
    """Spark's ``pmod(xxhash64(key), maps)``: the signed hash with seed 42, and maps is a power of two."""
    return xxhash.xxh64_intdigest(key.encode(), seed=42) % maps


def fold(word: Column, ranks: dict[bytes, int], maps: int = MAPS) -> Column:
    """Ids of a word (text), by merging the adjacent pair of lowest rank, the leftmost first, until no pair has a rank."""
    digits = F.hex(F.encode(word, "utf-8"))
    single = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.lower(F.substring(digits, i, F.lit(2))))
    # One column for the literal, used in all places.
    rank = lambda piece: rank_of(piece, ranks, maps)

    def step(pieces: Column, _: Column) -> Column:
        n = F.size(pieces)

        def merge(found: Column) -> Column:
            def at(i: Column) -> Column:
                joined = F.array(F.concat(F.get(pieces, i - 1), F.get(pieces, i)))
                return F.concat(F.slice(pieces, 1, i - 1), joined, F.slice(pieces, i + 2, F.greatest(n - i - 1, F.lit(0))))

            least = F.array_min(found)
            return F.when(least.isNull(), pieces).otherwise(_let(F.array_position(found, least).cast("int"), at))

        pairs = F.zip_with(F.slice(pieces, 1, n - 1), F.slice(pieces, 2, n - 1), lambda a, b: rank(F.concat(a, b)))
        return F.when(n < 2, pieces).otherwise(_let(pairs, merge))

    turns = F.sequence(F.lit(1), F.greatest(F.length(digits) / 2 - 1, F.lit(1)).cast("int"))
    return F.transform(F.aggregate(turns, single, step), rank)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for one word. Short ones look through their pairs at each merge, which a heap would only slow down."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _merge_short(word, ranks) if len(word) <= FOLD_BYTES else _merge_long(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    none, rank = 1 << 62, ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank(pieces[i - 1] + pieces[i], none)
        if i < len(pairs):
            pairs[i] = rank(pieces[i] + pieces[i + 1], none)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """In n log n steps: pairs wait in a heap by rank and place."""
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    waiting: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(word):
            pair = pieces[i] + pieces[after[i]]
            rank = ranks.get(pair)
            if rank is not None:
                heapq.heappush(waiting, (rank, i, pair))

    for i in range(len(word)):
        offer(i)
    while waiting:
        _, i, pair = heapq.heappop(waiting)
        # A pair that has changed since is no longer there.
        if pieces[i] is None or after[i] >= len(word) or pieces[i] + pieces[after[i]] != pair:
            continue
        gone = after[i]
        pieces[i], pieces[gone] = pair, None
        after[i] = after[gone]
        if after[i] < len(word):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in pieces if p is not None]


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT) -> dict[str, bytes]:
    """Ids, as bytes, of the most frequent distinct words of ``docs`` (text), about ``frequent`` of them at most.

    Counts cover every text and are cut into steps, ``STEPS`` to a doubling. Of the step that doesn't fit as a whole so large a share
    of its words is taken, by their hashes, as there is room for. The words come to the driver with their ids; their number is bounded.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0))).alias("word"))
    counts = materialize(words.groupBy("word").count().filter(F.octet_length("word") <= FOLD_BYTES))
    # At most 64 * STEPS rows, however often words occur.
    step = F.floor(F.log2("count") * STEPS)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    room, whole, share = frequent, steps[0]["step"] + 1 if steps else 0, 0
    for r in steps:
        if r["words"] > room:
            share = SHARES * room // r["words"]
            break
        room, whole = room - r["words"], r["step"]
    part = (step == max((r["step"] for r in steps if r["step"] < whole), default=whole - 1)) & (F.pmod(F.xxhash64("word"), F.lit(SHARES)) < share)
    folded = counts.filter((step >= whole) | part).select("word", fold(F.col("word"), ranks).alias("ids"))
    return {r.word: np.array(r.ids, dtype="<u4").tobytes() for r in folded.collect()}


class Encoder(dict):
    """Ids of words, as bytes: known ones by look-up, others by merging."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__(known)
        self._ranks, self._kept = ranks, len(known)
        self._known = known

    def __missing__(self, word: str) -> bytes:
        ids = np.array(merge_bytes(word.encode("utf-8"), self._ranks), dtype="<u4").tobytes()
        if len(word) <= FOLD_BYTES:
            if len(self) >= self._kept + REMEMBERED:
                self.clear()
                self.update(self._known)
            self[word] = ids
        return ids


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces by id."""
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids: their pieces, one after the other. Null for null, empty for none."""
    pieces = F.from_json(F.lit(json.dumps([p.hex() for p in pieces_of(ranks)], separators=(",", ":"))), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), ""))


def encode(docs: DataFrame, ranks_name: str = RANKS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, ids) of every row of ``docs`` (doc_id, text).

    Special tokens are ordinary text. A null text is empty and has no ids; a null doc_id stays null; repeated rows are encoded
    each; other columns are ignored; no rows give no rows. The digest is of the ids as little-endian unsigned
    32-bit integers.
    """
    import regex

    ranks, pattern = load_ranks(ranks_name), split_pattern()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((frequent_words(own.select("text"), ranks, pattern, frequent), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        ids_of, split = Encoder(known, table).__getitem__, regex.compile(pattern).findall
        for batch in batches:
            data = [b"".join(map(ids_of, split(text.as_py()))) for text in batch.column("text")]
            lengths = np.array([len(x) // 4 for x in data], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(starts, np.frombuffer(b"".join(data), dtype="<i4"))
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), digests, ids], ["doc_id", "n_tokens", "ids_sha256", "ids"])

    return own.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks_name: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ``ids`` (array), piece after piece. Null ids decode to null."""
    return encoded.withColumn("decoded", decoded(F.col("ids"), load_ranks(ranks_name)))


def round_trip(docs: DataFrame, ranks_name: str = RANKS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``: ``encode``, and the digest of what the ids decode to."""
    both = decode(encode(docs, ranks_name, frequent), ranks_name)
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

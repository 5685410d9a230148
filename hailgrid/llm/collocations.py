"""Phrase collocations, counted by broadcast double-array tries.

Texts become arrays of word numbers once. Candidates of n words are Apriori-safe: an
occurrence is gathered only where its first and its last n - 1 words are both frequent, and a phrase gathered fewer than
``least`` times can't be frequent. The candidates are laid out as double-array tries over the digits of their word
numbers, each of bounded size and broadcast in its turn. A task advances the states of all positions of its texts
at once, word by word, and counts the accepting states; the counts of all tasks are summed.

Word numbers differ by language, so one trie serves all languages and phrases of two never meet.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hailgrid.llm.common import bounded_batches
from hailgrid.session import discard, materialize, written

WORDS = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
COVERED = 80
UNKNOWN = "und"
# A trie takes so many phrases, a dictionary so many words; further ones follow in their turn.
TRIE_PHRASES = 1 << 19
DICTIONARY_WORDS = 1 << 19
# Word numbers are spelled in digits of this many bits, which is the alphabet of the tries.
DIGIT_BITS = 10
# Slots in which a state's children are placed together; a state has at most 2 ** DIGIT_BITS.
WINDOW = 1 << 16
# Gathered pairs or counted words that a task holds before it passes them on, and rows it passes on at once.
HELD = 1 << 21
PASSED = 1 << 16

WORD_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
# A row is a text that goes on (``ids``, ``held``: the phrase found at each position), the count of phrase ``first``, or
# that of an occurrence of phrase ``first`` with ``second`` one word later.
WALKED = pa.schema([("ids", pa.list_(pa.int32())), ("held", pa.list_(pa.int32())), ("first", pa.int32()), ("second", pa.int32()), ("n", pa.int64())])
WALKED_DDL = "ids array<int>, held array<int>, first int, second int, n long"

# What separates pieces, and what separates words within them.
PIECE_ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(PIECE_ENDS + GAPS + bytes(range(65, 91)), b"." * len(PIECE_ENDS) + b"  " + bytes(range(97, 123)))


def words_and_ends(text: str | None) -> list[bytes]:
    """The words of a text, A to Z lower-cased, with ``b"."`` where a piece ends."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    return plain.replace(b".", b" . ").split()


class Trie:
    """A double-array trie: the child of state s by digit c is t = base[s] + c if check[t] is s.

    ``number`` gives for an accepting state the position of its phrase among those given, and -1 for others.
    """

    def __init__(self, phrases: np.ndarray, digits: int):
        """``phrases``: distinct rows of word numbers from 1."""
        self.digits, self.length = digits, phrases.shape[1]
        shifts = DIGIT_BITS * np.arange(digits - 1, -1, -1)
        spelled = (phrases[:, :, None] >> shifts & (1 << DIGIT_BITS) - 1).reshape(len(phrases), -1)
        node, levels = np.zeros(len(phrases), dtype=np.int64), []
        nodes = 1
        for column in spelled.T:
            keys, node = np.unique(node << DIGIT_BITS | column, return_inverse=True)
            levels.append((keys >> DIGIT_BITS, keys & (1 << DIGIT_BITS) - 1))
            node += nodes
            levels[-1] = (*levels[-1], nodes)
            nodes += len(keys)
            node = node.astype(np.int64)
        # Nodes are numbered level by level; a level's keys hold the parent's number.
        parents = np.concatenate([p for p, _, _ in levels]) if len(phrases) else np.empty(0, dtype=np.int64)
        digit = np.concatenate([c for _, c, _ in levels]) if len(phrases) else np.empty(0, dtype=np.int64)
        slot, base = _place(parents, digit, nodes)
        size = int(slot.max()) + (1 << DIGIT_BITS) + 1
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.number = np.full(size, -1, dtype=np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parents]
        self.number[slot[node]] = np.arange(len(phrases))

    def advance(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions whose next words are a phrase: (positions, numbers of the phrases). 0 in ``ids`` is no word."""
        at = np.flatnonzero(ids[: len(ids) - self.length + 1] > 0)
        state = np.zeros(len(at), dtype=np.int32)
        for word in range(self.length):
            for d in range(self.digits - 1, -1, -1):
                to = self.base[state] + (ids[at + word] >> DIGIT_BITS * d & (1 << DIGIT_BITS) - 1).astype(np.int32)
                lives = self.check[to] == state
                at, state = at[lives], to[lives]
        return at, self.number[state]


def _place(parents: np.ndarray, digit: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """A slot for each node, and a base for each, such that children lie at their parent's base plus their digit.

    States with many children go first. A window's taken slots are the bits of a whole number, and the shifts at which all
    children of a state fall on free ones are the intersection of the free slots moved by each digit. Only children fill what is left.
    """
    slot, base = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    if not len(parents):
        return slot, base
    order = np.argsort(parents, kind="stable")
    owners, first, count = np.unique(parents[order], return_index=True, return_counts=True)
    radix = 1 << DIGIT_BITS
    full = (1 << WINDOW) - 1
    # Slot 0 is the root, and those before the first window stay empty, so that no base is below 0.
    start, free, used = radix, full, [np.ones(radix, dtype=bool)]
    for i in np.argsort(-count, kind="stable"):
        if count[i] == 1:
            break
        children = order[first[i] : first[i] + count[i]]
        codes = digit[children].tolist()
        while True:
            fits = free
            for c in codes:
                fits &= free >> c
                if not fits:
                    break
            if fits:
                break
            used.append(_bits(full ^ free))
            start, free = start + WINDOW, full
        shift = (fits & -fits).bit_length() - 1
        for c in codes:
            free ^= 1 << (shift + c)
        base[owners[i]] = start + shift
        slot[children + 1] = start + shift + np.array(codes)
    used.append(_bits(full ^ free))
    single = np.flatnonzero(count == 1)
    holes = np.flatnonzero(~np.concatenate(used))
    if len(holes) < len(single):
        end = sum(map(len, used))
        holes = np.concatenate([holes, np.arange(end, end + len(single) - len(holes))])
    children = order[first[single]]
    base[owners[single]] = holes[: len(single)] - digit[children]
    slot[children + 1] = holes[: len(single)]
    return slot, base


def _bits(number: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes(WINDOW // 8, "little"), dtype=np.uint8), bitorder="little").astype(bool)


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of ``texts`` (lang, text), as counted by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(words_and_ends(text))
            if sum(map(len, counts.values())) >= HELD // 4:
                yield from passed(counts)
                counts = {}
        yield from passed(counts)

    def passed(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(b".", None)
            words, n = list(own), list(own.values())
            for at in range(0, len(words), PASSED):
                part = pa.array(words[at : at + PASSED], type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), type=pa.string()), part, pa.array(n[at : at + PASSED], type=pa.int64())], schema=WORD_COUNTS)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> tuple[DataFrame, int]:
    """A written copy of ``df`` with dense numbers from 1 in the given order, and its size; no task holds all rows."""
    rows = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, within = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1)
    # One row for each partition of the sort.
    sizes = sorted(tuple(r) for r in rows.groupBy(part).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    placed = rows.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, (F.col("_before") + within + 1).cast("int")).drop("_id", "_part", "_before"), total


def encode(texts: DataFrame, words: DataFrame, count: int, most: int = DICTIONARY_WORDS) -> DataFrame:
    """A written table of the texts as word numbers (``ids``), with 0 for other words, ends of pieces and the end of the text.

    ``words`` (lang, word, number) has ``count`` rows; ``most`` of them are handed to the tasks at a time.
    """

    def filling(dictionary, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = dictionary.value
            for batch in batches:
                held = batch.column("ids")
                ids = []
                for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())):
                    found, split = own.get(lang, {}), words_and_ends(text)
                    row = np.zeros(len(split) + 1, dtype=np.int32)
                    row[:-1] = np.fromiter((found.get(w, 0) for w in split), dtype=np.int32, count=len(split))
                    if held[i].is_valid:
                        row = np.maximum(row, held[i].values.to_numpy())
                    ids.append(row)
                values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), type=pa.int32()), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *ids])))
                if last:
                    yield pa.RecordBatch.from_arrays([values], names=["ids"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text"), values], names=["lang", "text", "ids"])

        return run

    spark, path = texts.sparkSession, None
    texts = texts.withColumn("ids", F.lit(None).cast("array<int>"))
    for start in range(0, count, most):
        some: dict[str, dict[bytes, int]] = {}
        part = words.filter(F.col("number").between(start + 1, start + most)).select("lang", "word", "number").toArrow()
        for lang, word, number in zip(*(part.column(c).to_pylist() for c in ("lang", "word", "number"))):
            some.setdefault(lang, {})[word.encode("utf-8", "surrogatepass")] = number
        dictionary, last, before = spark.sparkContext.broadcast(some), start + most >= count, path
        texts, path = written(texts.mapInArrow(filling(dictionary, last), "ids array<int>" if last else "lang string, text string, ids array<int>"))
        dictionary.destroy()
        if before:
            discard(spark, before)
    return texts


def walk(texts: DataFrame, trie, first_number: int, last: bool, gather: bool) -> DataFrame:
    """One pass over the texts with a broadcast trie (None: the word numbers themselves are the phrases), as ``WALKED`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.value if trie else None
        counts = np.zeros(0, dtype=np.int64)
        pairs, size = [], 0
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy()
            held = batch.column("held").flatten().to_numpy().copy() if batch.column("held").null_count == 0 else np.zeros(len(ids), dtype=np.int32)
            if own is None:
                held = ids
            elif len(ids) >= own.length:
                at, number = own.advance(ids)
                seen = np.bincount(number, minlength=len(counts))
                seen[: len(counts)] += counts
                counts = seen
                held[at] = number + first_number
            if not last:
                ends = np.asarray(batch.column("ids").offsets)
                yield _rows(ids=batch.column("ids"), held=pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(held)))
            elif gather and len(held) > 1:
                both = np.flatnonzero((held[:-1] > 0) & (held[1:] > 0))
                pairs.append(held[both].astype(np.int64) << 32 | held[both + 1])
                size += len(both)
                if size >= HELD:
                    yield from gathered(pairs)
                    pairs, size = [], 0
        yield from gathered(pairs)
        for at in range(0, len(counts), PASSED):
            part = counts[at : at + PASSED]
            some = np.flatnonzero(part)
            yield _rows(first=(some + at + first_number).astype(np.int32), n=part[some])

    def gathered(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if pairs:
            keys, n = np.unique(np.concatenate(pairs), return_counts=True)
            for at in range(0, len(keys), PASSED):
                part = keys[at : at + PASSED]
                yield _rows(first=(part >> 32).astype(np.int32), second=(part & (1 << 32) - 1).astype(np.int32), n=n[at : at + PASSED])

    if "held" not in texts.columns:
        texts = texts.withColumn("held", F.lit(None).cast("array<int>"))
    return texts.select("ids", "held").mapInArrow(run, WALKED_DDL)


def _rows(**columns) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(count, f.type) for f in WALKED], schema=WALKED)


def count_phrases(ids: DataFrame, digits: int, words: int = WORDS, least: int = LEAST, most: int = TRIE_PHRASES) -> list[DataFrame]:
    """The phrases of 2 words, of 3, ... that occur ``least`` times, as (words, n) with word numbers; a trie takes ``most`` candidates."""
    spark, out = ids.sparkSession, []
    pairs = walk(ids, None, 0, last=True, gather=True)
    for length in range(2, words + 1):
        pairs = pairs.groupBy("first", "second").agg(F.sum("n").alias("gathered")).filter(F.col("gathered") >= least)
        if length == 2:
            longer = pairs.select(F.array("first", "second").alias("words"))
        else:
            a, b = (known.select(F.col("number").alias(k), F.col("words").alias(f"{k}_words")) for k in ("first", "second"))
            longer = pairs.join(a, "first").join(b, "second").select(F.concat("first_words", F.slice("second_words", -1, 1)).alias("words"))
        candidates, count = numbered(longer, [F.col("words")])
        if length > 2:
            _discard_all(spark, paths)
        if count == 0:
            break
        texts, counts, paths = ids, [], []
        for start in range(0, count, most):
            part = candidates.filter(F.col("number").between(start + 1, start + most)).orderBy("number").select("words").toArrow().column("words").combine_chunks()
            trie = spark.sparkContext.broadcast(Trie(part.flatten().to_numpy().reshape(-1, length).astype(np.int64), digits))
            found, path = written(walk(texts, trie, start + 1, start + most >= count, gather=length < words))
            trie.destroy()
            texts = found.filter("ids IS NOT NULL")
            counts.append(found.filter("first IS NOT NULL AND second IS NULL"))
            paths.append(path)
        pairs = found.filter("second IS NOT NULL")
        # A trie's counts lie beside the texts that go on, or, for the last, the pairs.
        counted = functools.reduce(DataFrame.unionByName, counts).groupBy(F.col("first").alias("number")).agg(F.sum("n").alias("n"))
        known = materialize(candidates.join(counted, "number").filter(F.col("n") >= least).select("number", "words", "n"))
        out.append(known.select("words", "n"))
    else:
        _discard_all(spark, paths)
    return out


def _discard_all(spark, paths: list[str]) -> None:
    for path in paths:
        discard(spark, path)


def mine(
    docs: DataFrame,
    words: int = WORDS,
    least: int = LEAST,
    top: int = TOP,
    covered: int = COVERED,
    trie_phrases: int = TRIE_PHRASES,
    dictionary_words: int = DICTIONARY_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``words`` words of each language of ``docs`` (text, lang).

    A phrase counts within a piece, overlaps included, if it occurs ``least`` times (a). Cut in two, of l and r occurrences, it scores
    floor(2000000 a / (l + r)), by its lowest cut, ties to the shorter first part. Phrases within a longer candidate that occurs at
    least ``covered`` % as often are left out, whether or not that one is. The first ``top`` by score, then a, both falling, then phrase,
    are ranked. Null texts are empty, a null lang is ``und``; repeated rows count each; other columns are ignored; no phrases give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    every = materialize(count_words(texts))
    totals = every.groupBy("lang").agg(F.sum("n").alias("n_words"))
    frequent, count = numbered(every.filter(F.col("n") >= least), [F.desc("n"), F.col("lang"), F.col("word")])
    if count == 0:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    frequent = materialize(frequent)
    digits = max(1, -(-count.bit_length() // DIGIT_BITS))
    phrases = count_phrases(encode(texts, frequent, count, dictionary_words), digits, words, least, trie_phrases)
    if not phrases:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    phrases = materialize(functools.reduce(DataFrame.unionByName, phrases))
    counts = phrases.unionByName(frequent.select(F.array("number").alias("words"), "n"))
    best = _uncovered(_scored(phrases, counts, words), phrases, words, covered)

    spelled = best.select("*", F.posexplode("words").alias("_at", "number")).join(frequent.select("number", "lang", "word"), "number")
    own = F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda w: w["word"])
    spelled = spelled.groupBy("words", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.concat_ws(" ", own).alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")


def _scored(phrases: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """(words, a, l, r, score) by the lowest cut; in whole numbers that can't overflow."""
    size = F.size("words")
    cuts = F.filter(F.array(*[F.lit(k) for k in range(1, words)]), lambda k: k < size)
    cut = phrases.select("words", F.col("n").alias("a"), F.explode(cuts).alias("k"))
    left, right = (counts.select(F.col("words").alias(f"{x}_words"), F.col("n").alias(x)) for x in "lr")
    cut = cut.withColumns({"l_words": F.slice("words", 1, F.col("k")), "r_words": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cut = cut.join(left, "l_words").join(right, "r_words")
    score = F.expr(f"({SCALE} * CAST(a AS decimal(20,0))) DIV (CAST(l AS decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cut.groupBy("words", "a").agg(lowest).select("words", "a", "cut.l", "cut.r", "cut.score")


def _uncovered(scored: DataFrame, phrases: DataFrame, words: int, covered: int) -> DataFrame:
    size = F.size("words")
    parts = F.array(*[F.when(size >= at + n - 1, F.slice("words", at, n)) for n in range(2, words) for at in range(1, words - n + 2)])
    inside = F.filter(parts, lambda p: p.isNotNull() & (F.size(p) < size))
    # A part's most frequent longer phrase tells.
    longer = phrases.select(F.explode(inside).alias("words"), "n").groupBy("words").agg(F.max("n").alias("longer"))
    covers = F.expr(f"100 * CAST(longer AS decimal(20,0)) >= {covered} * CAST(a AS decimal(20,0))")
    return scored.join(longer, "words", "left").filter(F.col("longer").isNull() | ~covers).drop("longer")

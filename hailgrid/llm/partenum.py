"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Sets are dealt to size bands so wide that a set links only within its band and
the next. In a band, linked sets differ in at most k elements. The
feature domain is partitioned by hash into k + 1 parts, so linked sets agree on one part at
least, and the hash of each part's elements is a signature that they share. (This is the enumeration
with all parts but one left out of each subset; larger subsets mean more signatures
for the same guarantee.) Sets that share a signature are verified exactly.

Agreement on an empty part says little, and would make one large group of all sets without elements there. In
bands where it could matter, an empty part is partitioned again with
another hash; where k is at least ``SAFE_K``, linked sets that agree on empty parts
alone have a chance under 1e-14, less than that of colliding hashes, and such parts are left out.

Equal sets are one node from the start. A signature's group gives star edges to its first set, so any two sets that share a signature
are in one star. Within stars, parity sketches rule pairs out: a bit per few elements, and as each
differing element turns one bit, two sets differ in at least as many elements as bits. The
components of what is left are compared exactly within themselves, in blocks by matrix
products. Both steps give each set's root, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hailgrid.llm.graph import connected_components
from hailgrid.llm.shingles import Shingler, mix, set_key
from hailgrid.session import materialize

WORDS = 5
PERCENT = 80
SAFE_K = 32
DEPTH = 3
BLOCK_SETS = 512
# Sets that a task remembers to have signed.
SIGNED_KEYS = 200_000
# A sketch has at most two to this power bits; rows of small stars that one task compares.
MOST_BITS = 16
STAR_ROWS = 5_000
# Bits of the map that chooses the texts to be verified: 4 MiB.
MAP_BITS = 1 << 25
# Columns of a block's presence matrix that are multiplied at a time.
COLUMNS = 4096


def bands(percent: int, largest: int = 1 << 40) -> list[tuple[int, int]]:
    """Size bands (smallest, largest): sets of Jaccard similarity ``percent`` or more lie in one band or in two adjacent ones."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


def most_different(percent: int, band: tuple[int, int]) -> int:
    """The largest symmetric difference of linked sets that are no larger than the band's largest."""
    return (100 - percent) * 2 * band[1] // (100 + percent)


def _part_signatures(shingles: np.ndarray, parts: int, prefix: np.uint64, refine: bool, depth: int = 0) -> list[np.ndarray]:
    where = ((mix(shingles, 101 + depth) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(parts, dtype=np.uint64)
    np.add.at(sums, where, mix(shingles, 7))
    filled = np.bincount(where, minlength=parts) > 0
    names = mix(np.arange(parts, dtype=np.uint64) + prefix, 17)
    out = [mix(sums[filled] ^ names[filled], 19)]
    if refine:
        for name in names[~filled]:
            out += [np.array([name])] if depth + 1 == DEPTH else _part_signatures(shingles, parts, name, refine, depth + 1)
    return out


def signatures(shingles: np.ndarray, percent: int, all_bands: list[tuple[int, int]]) -> np.ndarray:
    """PartEnum signatures of a set, for its own band and the next."""
    own = next(i for i, (_, high) in enumerate(all_bands) if len(shingles) <= high)
    out = [np.empty(0, dtype=np.uint64)]
    for band in (own, own + 1):
        k = most_different(percent, all_bands[band])
        if k:  # with k = 0 only equal sets link, and they are one node
            prefix = mix(np.array([band], dtype=np.uint64), 23)[0]
            out += _part_signatures(shingles, k + 1, prefix, k < SAFE_K)
    return np.concatenate(out)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of elements fell on them, about four for each element."""
    bits = 1 << min(MOST_BITS, max(8, (4 * len(shingles)).bit_length()))
    where = (mix(shingles, 29) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(where, minlength=bits) & 1).tobytes()


def _roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of ``count`` nodes that each reaches by the links (i, j)."""
    root = np.arange(count)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (before == root).all():
            return root


def _possible(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Roots over the pairs whose sketches differ in no more bits than linked sets of their sizes can in elements."""
    width = min(map(len, sketches))
    rows = []
    for s in sketches:
        bits = np.frombuffer(s, dtype=np.uint64)
        while len(bits) * 8 > width:  # half as many bits: the parities of two add up
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        rows.append(bits)
    table, left, right = np.stack(rows), [], []
    for i in range(len(rows) - 1):
        differ = np.bitwise_count(table[i + 1 :] ^ table[i]).sum(axis=1, dtype=np.int64)
        found = np.flatnonzero(differ <= (100 - percent) * (sizes[i] + sizes[i + 1 :]) // (100 + percent)) + i + 1
        left.append(np.full(len(found), i))
        right.append(found)
    return _roots(len(rows), np.concatenate(left), np.concatenate(right))


def _thinned(edges: DataFrame, sketches: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Edges (a, b) between sets of a star (``edges``: a, and its centre b) that the sketches (k1, n, sketch) don't rule out, as roots.

    Small stars share tasks; a large one is compared in pairs of blocks.
    """
    centres = edges.groupBy(F.col("b").alias("centre")).agg((F.count("*") + 1).alias("size"))
    members = edges.select(F.col("a").alias("k1"), F.col("b").alias("centre")).union(centres.select(F.col("centre").alias("k1"), "centre"))
    blocks = centres.select("centre", F.ceil(F.col("size") / block_sets).alias("blocks"))
    groups = max(1, edges.count() // STAR_ROWS)
    dealt = members.join(blocks, "centre").withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alone = F.when(F.col("blocks") > 1, F.col("centre"))
    dealt = dealt.select(
        "k1", "centre", alone.alias("alone"), F.when(alone.isNull(), F.pmod(F.xxhash64("centre"), F.lit(groups))).alias("part"),
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["centre", "k1"])
        ids, n, sketches_of = group["k1"].to_numpy(), group["n"].to_numpy(), group["sketch"].tolist()
        ends = [*np.flatnonzero(np.diff(group["centre"].to_numpy())) + 1, len(group)]
        out, start = [], 0
        for end in ends:
            if end - start > 1:
                out.append((ids[start:end], ids[start:end][_possible(n[start:end], sketches_of[start:end], percent)]))
            start = end
        a, b = (np.concatenate([x[i] for x in out]) if out else np.empty(0, dtype=np.int64) for i in (0, 1))
        return pd.DataFrame({"a": a, "b": b})[a != b]

    return dealt.join(sketches, "k1").groupBy("alone", "part", "low", "high").applyInPandas(compare, "a long, b long")


def _described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, k1, k2, n, sketch)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch["text"]]
            keys = [set_key(s) for s in sets]
            out = pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys],
                    "n": [len(s) for s in sets], "sketch": [parity_sketch(s) if len(s) else None for s in sets],
                }
            )
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), "text").mapInPandas(run, "doc_id long, text_hash long, k1 long, k2 long, n long, sketch binary")


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(k1, signatures) of the sets; of equal sets that lie within ``SIGNED_KEYS`` others in a task, one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, all_bands, done = Shingler(words), bands(percent), set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingler(text)
                key = set_key(own)
                if len(own) and key not in done:
                    if len(done) >= SIGNED_KEYS:
                        done.clear()
                    done.add(key)
                    rows.append((key[0], signatures(own, percent, all_bands).view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["k1", "signatures"])

    return docs.select("text").mapInPandas(run, "k1 long, signatures array<long>")


def _text_hash() -> Column:
    return F.xxhash64("text", F.length("text"))


def _compare(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The root of each set: the first one that it reaches by links."""
    count, sizes = len(sets), np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(count), sizes)
    shared = times[column] > 1  # an element of one set only adds to no intersection
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((count, count), dtype=np.float32)
    _, column = np.unique(column, return_inverse=True)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        present = np.zeros((count, COLUMNS), dtype=np.float32)
        present[row[a:b], column[a:b] - at] = 1
        both += present @ present.T
    inter = both.astype(np.int64)
    return _roots(count, *np.nonzero(100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)))


def _sets_of(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(k1, k2, shingles) of the rows whose doc_id is the ``least`` of a member, and of some others.

    A bit map of ``MAP_BITS`` bits goes to every task, so that texts need not be shuffled to be chosen. It holds a bit
    for each member's id and grows no further; when it fills up, more rows than needed pass and the join on the keys drops them.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bits = members.select(slot("least").alias("slot")).groupBy(F.floor(F.col("slot") / 63).alias("word"))
    filled = bits.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 63 AS int)))").alias("bits")).collect()
    table = np.zeros(MAP_BITS // 63 + 1, dtype=np.int64)
    for r in filled:
        table[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            at = batch["slot"].to_numpy()
            texts = batch["text"][(shared.value[at // 63] >> (at % 63)) & 1 == 1]
            sets = [shingler(t) for t in texts]
            keys = [set_key(s) for s in sets]
            if not sets:
                continue
            yield pd.DataFrame({"k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "shingles": [s.view(np.int64) for s in sets]})

    return docs.select("text", slot(F.col("doc_id").cast("long")).alias("slot")).mapInPandas(shingle, "k1 long, k2 long, shingles array<long>")


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, set_group) for every row of ``docs`` (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their shingle sets. Null, empty and
    wordless texts have no shingles, link with nothing and keep their own id; repeated
    rows and equal texts link; a null doc_id takes part and counts as no id, so it is a component_id only where the group has no other; extra columns are ignored;
    no rows give no rows. ``set_group`` names a row's component also where it has no id; null without shingles.
    """
    slim = materialize(_described(docs, words))
    full = slim.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))

    # A task signs equal sets once, so a group of copies brings as many rows as it has tasks at most.
    signed = _signed(docs, words, percent).select("k1", F.explode("signatures").alias("signature"))
    star = signed.withColumn("centre", F.min("k1").over(Window.partitionBy("signature")))
    edges = materialize(star.filter("k1 <> centre").select(F.col("k1").alias("a"), F.col("centre").alias("b")).distinct())
    sketches = slim.filter("n > 0").groupBy("k1").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    possible = materialize(_thinned(edges, sketches, percent, block_sets).distinct())
    clusters = materialize(connected_components(possible).select(F.col("node").alias("k1"), F.col("component").alias("cluster")))

    # The sets that have a possible partner, from the text of one row each.
    members = materialize(full.join(clusters, "k1").select("k1", "k2", "cluster", "least").withColumn("id", F.monotonically_increasing_id()))
    blocks = members.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / block_sets).alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("k1", "k2", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id")
    sets = _sets_of(docs, members, words).join(dealt, ["k1", "k2"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        # Rows that share the id of a member may hold its set again.
        group = group.drop_duplicates("id").sort_values("id")
        ids = group["id"].to_numpy()
        root = _compare([np.asarray(s).view(np.uint64) for s in group["shingles"]], percent)
        return pd.DataFrame({"a": ids, "b": ids[root]})[ids != ids[root]]

    links = materialize(sets.groupBy("cluster", "low", "high").applyInPandas(compare, "a long, b long"))
    labels = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))
    labelled = members.join(labels, "id")
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    found = full.join(labelled.join(least, "label").select("k1", "k2", "label", "component"), ["k1", "k2"], "left")
    group = F.coalesce(F.col("label").cast("string"), F.concat_ws(":", "k1", "k2"))
    found = found.select("k1", "k2", F.coalesce("component", "least").alias("component_id"), group.alias("set_group"))
    linked = slim.filter("n > 0").join(found, ["k1", "k2"]).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "set_group")
    alone = slim.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("set_group"))
    return linked.union(alone)


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near-duplicates: of each group of linked rows the one with the smallest doc_id stays.

    Rows without shingles are in no group and all stay. Of rows with one id in a group, that with the smallest text hash stays,
    and of repeated rows one. All columns are kept as they are.
    """
    grouped = materialize(link(docs, words, percent))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = grouped.filter("n_shingles > 0").groupBy("set_group").agg(first).select("first.doc_id", "first.text_hash")
    copies = grouped.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    same = kept["doc_id"].eqNullSafe(copies["doc_id"]) & kept["text_hash"].eqNullSafe(copies["text_hash"])
    single = copies.join(kept, same, "left_semi").union(copies.filter("n = 0")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "copies", "n")

    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_doc_id"), _text_hash().alias("_text_hash"))
    rows = rows.join(single, F.col("_doc_id").eqNullSafe(F.col("_id")) & F.col("_text_hash").eqNullSafe(F.col("_hash")))
    once = rows.filter("copies = 1 OR n = 0")
    repeated = rows.filter("copies > 1 AND n > 0").withColumn("_rank", F.row_number().over(Window.partitionBy("_doc_id", "_text_hash").orderBy(F.lit(0)))).filter("_rank = 1")
    return once.select("_doc.*").union(repeated.select("_doc.*"))

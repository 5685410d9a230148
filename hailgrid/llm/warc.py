"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading cuts the files at the magic line, in parallel and at any split, so a magic
line inside a payload makes a false candidate. Each candidate gives its offset and, from its
Content-Length, its successor's. Pointer jumping from offset 0 of each file keeps the candidates that a
chain of records reaches: with pointers doubled each round, a file of n records takes log2(n) rounds.
What is not reached is payload, and goes back to the record that it was cut from.

Both directions use Spark's text files with their own line separator; the offsets come from byte lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hailgrid.llm.common import text_or_empty
from hailgrid.session import materialize

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
# The field is required; a fixed value keeps archives of the same pages equal.
DATE = "1970-01-01T00:00:00Z"
# The digits of a number in base 32, and the alphabet of RFC 4648.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """The bare upper-case base32 SHA-1; 160 bits are eight times twenty."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record) per row of ``pages`` (page_id, url, html): a WARC record without the blank lines that end it.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the largest page_id are responses and the others revisits of it, without
    a payload of their own. A null html is an empty payload. A null page_id counts as the smallest;
    where a group has no other, all its pages are responses. So repeated rows are alike.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("payload"))
    own = own.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    groups = own.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1")
    # Written first, so that its size is known: a small table reaches the pages without moving their payloads.
    own = own.join(materialize(groups.select("digest", "newest")), "digest", "left")
    revisit = (F.col("size") >= min_bytes) & F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))

    uri = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC),
        F.when(revisit, field("WARC-Type", F.lit("revisit"))).otherwise(field("WARC-Type", F.lit("response"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        F.when(uri.isNotNull(), field("WARC-Target-URI", uri)).otherwise(""),
        F.when(revisit, field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("newest").cast("string"), F.lit(">")))).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("X-Payload-Length", F.col("size")),
        field("Content-Type", F.lit("text/html")),
        field("Content-Length", F.when(revisit, 0).otherwise(F.col("size"))),
        F.lit("\r\n"),
    )
    return own.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the records of ``pages`` as WARC files under ``path``, one file a task."""
    records(pages, min_bytes).write.option("lineSep", GAP).option("compression", "none").text(path)


def _cut(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, bytes, value): the files cut at the magic line, in order of block and id within a file."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.octet_length("value").cast("long").alias("bytes"),
        "value",
    )


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``start``, the offset of the magic line before a piece; -len(MAGIC) for what stands before the first.

    Lengths are summed within blocks, and blocks within files, so no task sums a whole large file.
    """
    step = F.col("bytes") + len(MAGIC)
    by_block = pieces.groupBy("file", "block").agg(F.sum(step).alias("all"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = by_block.select("file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    own = pieces.withColumn("before", F.coalesce(F.sum(step).over(within), F.lit(0)))
    return own.join(by_block, ["file", "block"]).withColumn("start", F.col("base") + F.col("before") - len(MAGIC)).drop("base", "before")


def _field(head: Column, name: str, value: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}: *{value}", 1)
    return F.when(found != "", found)


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, start) of the candidates (file, start, next) that a chain from offset 0 of their file reaches."""
    starts = candidates.select("file", F.col("start").alias("next"))
    # A pointer that leaves the candidates ends its chain.
    jumps = materialize(candidates.select("file", "start", "next").join(starts, ["file", "next"], "left_semi"))
    known = materialize(candidates.filter("start = 0").select("file", "start"))
    while not jumps.isEmpty():
        met = jumps.join(known, ["file", "start"]).select("file", F.col("next").alias("start"))
        known = materialize(known.union(met).distinct())
        ends = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("after"))
        jumps = materialize(jumps.join(ends, ["file", "next"]).select("file", "start", F.col("after").alias("next")))
    return known


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, page_id, payload_bytes, payload_digest, record_type, refers_to) per record under ``path``.

    A response's bytes and digest are those of the payload that was read; a revisit's are those of its
    header, which describe the full payload. No records give no rows; an unreadable tail is left out.
    """
    raw, head = F.col("value").cast("binary"), F.substring_index("value", GAP, 1)
    length = F.when(F.instr("value", GAP) > 0, _field(head, "Content-Length", r"(\d{1,18})\s*$").cast("long"))
    size = F.octet_length(head) + 2 * len(GAP) + length
    # The sha1 of a piece that is one whole record; others are put together first.
    whole = F.col("bytes") == size
    body = F.substring(raw, F.octet_length(head) + len(GAP) + 1, length.cast("int"))
    pieces = _cut(spark, path).select(
        "file", "block", "id", "bytes", head.alias("head"), length.alias("length"), size.alias("size"),
        whole.alias("whole"), F.when(whole, sha1_base32(body)).alias("digest"),
    )
    parsed = pieces.select(
        "file", "block", "id", "bytes", "length", "size", "whole", "digest",
        _field(F.col("head"), "WARC-Type", r"(\w+)").alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest", r"sha1:(\w+)").alias("stated"),
        _field(F.col("head"), "X-Payload-Length", r"(\d{1,18})").cast("long").alias("full"),
    )
    placed = materialize(_with_offsets(materialize(parsed)))
    candidates = placed.filter("start >= 0 AND length IS NOT NULL").withColumn("next", F.col("start") + len(MAGIC) + F.col("size"))
    real = candidates.join(reachable(candidates), ["file", "start"])

    split = materialize(real.filter("NOT whole").select("file", F.col("start").alias("record"), "next", "length", "size"))
    if not split.isEmpty():
        real = real.drop("digest").join(_joined(spark, path, split, real).union(real.filter("whole").select("file", "start", "digest")), ["file", "start"])
    revisit = F.col("record_type") == "revisit"
    return real.select(
        "file",
        "start",
        "page_id",
        F.when(revisit, F.col("full")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


def _joined(spark: SparkSession, path: str, split: DataFrame, real: DataFrame) -> DataFrame:
    """(file, start, digest) of the records whose payload holds magic lines: their pieces, put together again.

    Reads once more the files that have such records.
    """
    files = split.select("file").distinct()
    again = _with_offsets(_cut(spark, path).join(files, "file", "left_semi"))
    starts = real.select("file", F.col("start").alias("record"), F.lit(True).alias("opens"))
    marked = again.join(starts, (again["file"] == starts["file"]) & (again["start"] == starts["record"]), "left").drop(starts["file"])
    owner = F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    owned = marked.select("file", "start", "value", owner.alias("record"))
    owned = owned.join(split, ["file", "record"])
    # One record's pieces, so no more than one payload together.
    pieces = owned.groupBy("file", "record", "length").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["value"]), MAGIC)
    head = F.octet_length(F.substring_index(text, GAP, 1)) + len(GAP)
    body = F.substring(text.cast("binary"), head + 1, F.col("length").cast("int"))
    return pieces.select("file", F.col("record").alias("start"), sha1_base32(body).alias("digest"))


def round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` under ``path`` and read the archives back."""
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path)

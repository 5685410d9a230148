"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access keys, long hex) count by themselves. Weak parts (names of
accounts, bare random-looking strings, service addresses) count only together: a
weak secret needs an identifier within its scope, a weak identifier a secret, and
an endpoint both. Parts are intervals of code points; scopes are met by an interval join on
(row, stretch of text), so neither a long text nor one with many parts ends up in one task.

Positions come from the lengths of what lies between matches and of the matches,
summed along the text. The texts are scanned once; what is written and joined holds lengths, no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hailgrid.llm.common import text_or_empty, with_row_id
from hailgrid.session import materialize

# The patterns, with the group and its least length that a match must have.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
WEAK_ID = r"""([Cc]lient_?[Ii]d|[Aa]ccount_?[Ii]d|[Aa]ccess_?[Kk]ey_?[Ii]d|[Uu]ser(?:name)?|[Ll]ogin)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
WEAK_SECRET = r"[A-Za-z0-9+_=-]+"
ENDPOINT = r"(https?|s?ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?|s3|wss?)://[A-Za-z0-9.-]+"
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", ACCESS, 0, 16),
    ("hex", HEX, 0, 32),
    ("linked_id", WEAK_ID, 2, 3),
    ("linked_secret", WEAK_SECRET, 0, 24),
    ("linked_endpoint", ENDPOINT, 0, 8),
)
BASE = ("assign", "access", "hex")
# Weak secrets that hold a slash, besides those above. An address is taken as one match, so its path is no secret.
SLASHED = ("linked_slashed", r"""://[^\s"'<>?#,;|]*|[A-Za-z0-9+/_=-]{24,}""", 0, 24)
RANK = {kind: i for i, (kind, *_) in enumerate((*KINDS, SLASHED))}
# Random text changes between small, capital and digit at two of three letters, the words of a path seldom:
# so many letters, slashes left out, to a run of one class at most.
RUN_LENGTH = 2.5
# Maximal runs of one class of characters: asking for the least length in the pattern finds the same runs faster.
RUNS = {HEX: r"[0-9a-f]{32,}", WEAK_SECRET: r"[A-Za-z0-9+_=-]{24,}"}

# Code points between parts that still belong together.
SCOPE = 200
MASK = "[SECRET]"
# Code points in a chunk of a text that is being rewritten.
CHUNK = 1024


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, gap before the match, its length, whether it counts)."""
    fast = RUNS.get(pattern, pattern)

    found = F.regexp_extract_all(text, F.lit(fast), F.lit(0))
    gaps = F.transform(F.split(text, fast, -1), lambda x: F.char_length(x))

    def part(pair: Column, i: Column) -> Column:
        match = pair["match"]
        ok = F.char_length(F.regexp_extract(match, pattern, group)) >= least
        if kind == "linked_secret":
            ok = ok & match.rlike("[0-9]") & match.rlike("[A-Za-z]")
        if kind == SLASHED[0]:
            mixed = match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
            runs = F.regexp_count(match, F.lit("[a-z]+|[A-Z]+|[0-9]+|[+_=-]+"))
            letters = F.char_length(F.translate(match, "/", ""))
            ok = ok & match.contains("/") & ~match.startswith("://") & mixed & (letters <= RUN_LENGTH * runs)
        return F.struct(F.lit(RANK[kind]).alias("rank"), i.alias("i"), pair["gap"].alias("gap"), F.char_length(match).alias("length"), ok.alias("ok"))

    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    matched = F.filter(F.transform(pairs, part), lambda x: x["length"].isNotNull())
    return F.when(text.rlike(fast), matched)


def _near(left: DataFrame, right: DataFrame, reach: int, how: str) -> DataFrame:
    """``left`` rows with (``left_semi``) or without (``left_anti``) an interval of ``right`` in the same text, at most ``reach`` code points away.

    Both sides are cut along the text into stretches of ``SCOPE``, so the join is on equal (row, stretch).
    """
    a = left.withColumn("at", F.explode(F.sequence(F.floor((F.col("start") - reach) / SCOPE), F.floor((F.col("end") + reach) / SCOPE))))
    b = right.select("_row", F.col("start").alias("s"), F.col("end").alias("e"))
    b = b.withColumn("at", F.explode(F.sequence(F.floor(F.col("s") / SCOPE), F.floor(F.col("e") / SCOPE))))
    near = a.join(b, ["_row", "at"], "inner").filter((F.col("s") - F.col("end") <= reach) & (F.col("start") - F.col("e") <= reach))
    if not reach:  # overlap, not mere touch
        near = near.filter((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    keys = ["_row", "rank", "start", "end"]
    return left.join(near.select(*keys).distinct(), keys, how)


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every row of ``docs`` (doc_id, text) as (_row, doc_id, text_hash), and the reported spans as (_row, kind, rank, start, end).

    Starts and ends count code points, ends exclusive. A null text is empty; a null doc_id stays null;
    repeated rows are scanned each; other columns are ignored; no rows give no rows.
    """
    text = F.col("text")
    found = F.flatten(F.filter(F.array(*[_matches(text, *k) for k in (*KINDS, SLASHED)]), lambda x: x.isNotNull()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = materialize(with_row_id(rows.select("doc_id", F.xxhash64("text", F.length("text")).alias("text_hash"), found.alias("found"))))

    along = Window.partitionBy("_row", "rank").orderBy("i")
    parts = rows.select("_row", F.explode("found").alias("x")).select("_row", "x.*")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(along)).filter("ok")
    parts = materialize(parts.select("_row", "rank", (F.col("end") - F.col("length")).alias("start"), "end"))

    base = parts.filter(F.col("rank") < len(BASE))
    weak = {k: parts.filter(F.col("rank") == RANK[k]) for k in ("linked_id", "linked_secret", "linked_endpoint")}
    secrets = _near(weak["linked_secret"], base, 0, "left_anti")
    # An assignment covers all of a slashed run; long hex or an access key only a part, which leaves the rest to be found.
    slashed = _near(parts.filter(F.col("rank") == RANK[SLASHED[0]]), base.filter(F.col("rank") == RANK["assign"]), 0, "left_anti")
    secrets = secrets.union(slashed)
    strong_secrets = base.filter(F.col("rank") != RANK["access"])
    identifiers = base.filter(F.col("rank") == RANK["access"]).union(weak["linked_id"])
    linked_secret = _near(secrets, identifiers, SCOPE, "left_semi")
    linked_id = _near(weak["linked_id"], strong_secrets.union(secrets), SCOPE, "left_semi")
    held = _near(weak["linked_endpoint"], identifiers, SCOPE, "left_semi")
    linked_endpoint = _near(held, strong_secrets.union(secrets), SCOPE, "left_semi")

    names = F.create_map(*[x for k, i in RANK.items() for x in (F.lit(i), F.lit(k))])
    spans = base.union(linked_id).union(linked_secret).union(linked_endpoint)
    return rows.select("_row", "doc_id", "text_hash"), spans.select("_row", names[F.col("rank")].alias("kind"), "rank", "start", "end")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans); see ``scan``."""
    rows, spans = scan(docs)
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind")))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    by_row = spans.groupBy("_row").agg(*[count(k) for k in BASE], ordered.alias("all"))
    base = F.filter("all", lambda x: x["rank"] < len(BASE))
    return rows.join(by_row, "_row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(F.array_join(F.transform(base, text), ","), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(F.array_join(F.transform("all", text), ","), F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span, or run of overlapping ones, replaced by ``mask``.

    No row goes. A column n_chars gets the new length; a text without spans, null included, and all
    other columns stay as they are.
    """
    rows, spans = scan(docs)
    along = Window.partitionBy("_row").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("first", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    runs = runs.withColumn("run", F.sum("first").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("_row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    # Rows with the same id and text have the same spans, so one of them is enough.
    marked = rows.join(cut, "_row").groupBy("doc_id", "text_hash").agg(F.max("_cut").alias("_cut"))
    marked = marked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_cut")

    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").alias("_text"))
    hashed = F.xxhash64(text_or_empty("_text"), F.length(text_or_empty("_text")))
    both = own.withColumn("_text_hash", hashed).join(marked, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    both = both.withColumn("_chunks", F.when(F.col("_cut").isNotNull(), F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        """The text from code point ``a`` to before ``b``, from whole chunks and the ends of two."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        chunk = lambda k: F.get("_chunks", k)
        head, tail = F.substr(chunk(i), (a % CHUNK + 1).cast("int")), F.substr(chunk(j), F.lit(1), (b - j * CHUNK).cast("int"))
        middle = F.array_join(F.slice("_chunks", i + 2, j - i - 1), "")
        return F.when(b <= a, "").when(i == j, F.substr(chunk(i), (a % CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.concat(head, middle, tail))

    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cut", lambda x: x["end"]))
    ends = F.concat(F.transform("_cut", lambda x: x["start"]), F.array(F.length("_text").cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: between(x["a"], x["b"]))
    both = both.withColumn("_new", F.when(F.col("_cut").isNotNull(), F.array_join(kept, mask)))

    def column(name: str) -> Column:
        old = F.col("_doc")[name]
        if name == "text":
            return F.coalesce("_new", old).alias(name)
        if name == "n_chars":
            return F.coalesce(F.length("_new"), old).cast(dict(docs.dtypes)[name]).alias(name)
        return old.alias(name)

    return both.select(*[column(c) for c in docs.columns])

"""WARC round trip: payloads with magic inside, revisits, small splits, chains, the SQL."""

import base64
import hashlib

import duckdb

from hailgrid.llm import oracles, warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(rows, min_bytes=0):
    newest = {}
    for i, h in rows:
        newest.setdefault(h or "", []).append(i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        top = max((x for x in newest[h or ""] if x is not None), default=None)
        again = len(data) >= min_bytes and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (1, None), (2, ""), (3, "<p>x</p>"), (4, "<p>x</p>"), (4, "<p>x</p>"), (5, FAKE), (6, "a" + FAKE * 3 + "b"), (7, "WARC/1.0\r\n"), (8, "WARC/1.0\r\n" * 5), (9, "\r\n\r\n"), (10, "é\U0001f600" * 1000 + "WWARC/1.0\r\n"),
    (11, "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (None, "alone"), (None, "<p>x</p>"), (12, "x" * 300_000 + FAKE), (13, "Content-Length: 3\r\n\r\n"), (14, "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/\r\nContent-Length: 1" if i == 3 else None, h, 1, "z") for i, h in ROWS], "page_id long, url string, html string, start int, file string")
    for n, (parts, size) in enumerate([(1, None), (4, None), (2, "2000")]):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size or "134217728")
        try:
            assert found(warc.round_trip(pages.repartition(parts), f"{tmp_path}/{n}")) == brute(ROWS)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found(warc.round_trip(pages, f"{tmp_path}/least", min_bytes=9)) == brute(ROWS, 9)
    assert warc.round_trip(pages.filter("false"), f"{tmp_path}/none").count() == 0
    files = spark.read.format("binaryFile").load(f"{tmp_path}/0").collect()
    (data,) = [bytes(f.content) for f in files]
    assert data.startswith(b"WARC/1.0\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_pages_and_sql(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert found(warc.round_trip(pages, f"{tmp_path}/w")) == brute(rows)
    own = [(i, h) for i, h in ROWS if i is not None] + rows
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [list(x) for x in own])
    assert sorted(con.sql(oracles.oracle_sql()["op6_warc_chain"]).fetchall(), key=str) == brute(own)


def test_only_chains_from_the_start_count(spark):
    links = [(0, 10), (10, 30), (30, 60), (60, 99), (20, 30), (40, 60), (45, 46), (46, 45), (70, 70)]
    rows = [("a", s, n) for s, n in links] + [("b", 5, 9), ("b", 9, 12)] + [("c", i, i + 1) for i in range(100)]
    got = {(r.file, r.start) for r in warc.reachable(spark.createDataFrame(rows[:6] + rows[9:], "file string, start long, next long")).collect()}
    assert got == {("a", 0), ("a", 10), ("a", 30), ("a", 60)} | {("c", i) for i in range(100)}

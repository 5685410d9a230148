"""K-d sharding: balanced bytes, gapless slots, tree cuts, hot values, odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from hailgrid.llm import kdtree


def check(rows, texts, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    held = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        held.setdefault(r.shard, []).append(r)
    for own in held.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in held.get(i, [])) for i in range(shards)]


@pytest.mark.parametrize("folder, slot_rows", [("sf0.001", 20_000), ("sf0.01", 7)])
def test_documents(spark, folder, slot_rows):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = kdtree.shard(docs, 24, slot_rows=slot_rows).collect()
    sizes = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 24)
    longest = max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= 3 * longest


def test_hot_value_and_equal_sizes(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('x', 92) text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) source", "'en' lang", "1 _row", "2 d0")
    rows = kdtree.shard(docs, 24).collect()
    sizes = check(rows, [(i, "x" * 92) for i in range(6000)], 24)
    assert max(sizes) - min(sizes) <= 6 * 100


def test_a_common_prefix_does_not_hide_a_dimension(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = docs.withColumn("source", F.concat(F.lit("common_crawl_\u00e9/"), "source"))
    plain, prefixed = (sorted((r.doc_id, r.shard, r.slot) for r in kdtree.shard(d, 3).collect()) for d in (docs, long))
    assert plain == prefixed
    assert kdtree.common_bytes(long.filter("source like '%0'"), ["source"])["source"] > 15
    odd = spark.createDataFrame([("ab", None), (None, None), ("abc", None)], "source string, lang string")
    assert kdtree.common_bytes(odd, ["source", "lang"]) == {"source": 2, "lang": 0}
    assert kdtree.common_bytes(odd.filter("false"), ["source"]) == {"source": 0}


def test_splits_follow_the_widest_dimension(spark):
    rows = spark.createDataFrame([(10, a << kdtree.TIE_BITS, b << kdtree.TIE_BITS) for a in range(100) for b in (0, 1)], "weight int, a long, b long")
    tree = kdtree.grow(rows, ["a", "b"], 4)
    assert tree.dimension == "a" and tree.cut >> kdtree.TIE_BITS in (49, 50)
    assert tree.left.dimension == "b" and tree.right.dimension == "b"
    thirds = kdtree.grow(rows, ["a"], 3)
    got = [r[0] for r in rows.groupBy(thirds.expression().alias("s")).agg(F.sum("weight")).orderBy("s").select("sum(weight)").collect()]
    assert sum(got) == 2000 and all(abs(x - 2000 / 3) <= 20 for x in got)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "é\U0001f600"), (3, "é\U0001f600"), (None, "x"), (4, "y" * 2_000_000)]
    docs = spark.createDataFrame([(d, t, None, "en") for d, t in texts], "doc_id long, text string, source string, lang string")
    check(kdtree.shard(docs, 24).collect(), texts, 24)
    assert kdtree.shard(docs.filter("false"), 24).count() == 0
    assert len({r.shard for r in kdtree.shard(docs.filter("doc_id < 4"), target_bytes=20).collect()}) == 3
    check(kdtree.shard(docs.select("doc_id", "text"), 5).collect(), texts, 5)


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = kdtree.shard(docs, 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""The pipeline, stage by stage, against brute force on a small fixture."""

import random
import string

import corpus_pipeline
from test_credentials import masked
from test_packing import check
from pyspark.sql import functions as F
from test_partenum import brute as groups

from hailgrid.llm import langid

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "123 456 !!", None, "s", 10), (10_002, "", None, "s", 0)], docs.schema)
    docs = docs.union(odd)
    names = docs.columns

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "secret_scan", "packing"]
    one = stages["language_id"](spark, docs, FOLDER)
    assert one.columns == names
    model = langid.fit(docs.filter(~langid.held_out()))
    told = langid.predict(docs.select("doc_id", "text"), model).collect()
    want = sorted(r.doc_id for r in told if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE)
    assert sorted(r.doc_id for r in one.collect()) == want and not {10_000, 10_001, 10_002} & set(want)
    assert len(want) >= 0.99 * (docs.count() - 3)

    kept = {r.doc_id: r for r in docs.collect() if r.doc_id in set(want)}
    two = stages["ngram_join"](spark, docs.filter(docs["doc_id"].isin(want)), FOLDER)
    assert two.columns == names
    firsts = {c for _, _, c in groups([(d, r.text) for d, r in kept.items()], 5, 80)}
    assert {r.doc_id: r.text for r in two.collect()} == {d: kept[d].text for d in firsts}

    three = stages["secret_scan"](spark, docs, FOLDER)
    assert three.columns == names and three.dtypes == docs.dtypes
    after = {r.doc_id: r for r in three.collect()}
    for r in docs.collect():
        assert after[r.doc_id].text == masked(r.text)
        assert after[r.doc_id].n_chars == (r.n_chars if masked(r.text) == r.text else len(masked(r.text)))

    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    ids = [d for d in firsts if d < 10_000]
    check(pieces, [(d, masked(kept[d].text)) for d in ids])


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    draw = random.Random(5)
    texts = ["Этот текст написан на языке, которого модель не знает. " * 5, "Η γλώσσα αυτή δεν διδάχθηκε ποτέ. " * 5, "这段文字用模型没有学过的语言写成。" * 5]
    texts += ["".join(draw.choice(letters) for _ in range(600)) for letters in (string.ascii_letters + string.digits + "+/", string.ascii_lowercase + " ", "asdfghjkl;")]
    odd = spark.createDataFrame([(20_000 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs.union(odd), FOLDER).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    own = {"score": F.lit(-7.5), "lang_pred": F.lit("mine"), "_lang": F.lit("x"), "_doc": F.col("doc_id"), "a.b": F.lit(3)}
    wide = docs.withColumns(own)
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    got, plain = stage(spark, wide, FOLDER), stage(spark, docs, FOLDER)
    assert got.columns == wide.columns and got.dtypes == wide.dtypes
    assert got.filter("score = -7.5 and lang_pred = 'mine' and _lang = 'x' and _doc = doc_id and `a.b` = 3").count() == got.count() == plain.count()
    assert sorted(map(tuple, got.select(*docs.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name

"""Language identification: kernel values by brute force, held-out accuracy, odd rows."""

import zlib

import numpy as np

from hailgrid.llm import langid

SMALL = "/root/testdata/sf0.001"


def test_kernel_by_brute_force():
    texts = ["the cat sat on the mat", "le chat est sur le tapis", "der hund schläft heute", "the dog", "un chien", "ein hund"]
    labels = ["en", "fr", "de", "en", "fr", "de"]
    model = langid.fit_sets([langid.gram_set(t) for t in texts], labels, landmarks=6)
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    turns = [2, 0, 1, 5, 3, 4]  # de, en, fr, and again
    values = model.kernel(model.presence(texts))
    for i, own in enumerate(grams):
        for j, k in enumerate(turns):
            want = len(own & grams[k]) / np.sqrt(len(own) * len(grams[k]))
            assert abs(values[i, j] - want) < 1e-5
    assert [model.labels[k] for k in model.scores(model.presence(texts)).argmax(axis=1)] == labels


def test_presence_over_segments(monkeypatch):
    text = "abcdefg hij klm nop" * 20
    whole = langid.gram_set(text)
    monkeypatch.setattr(langid, "SEGMENT", 7)
    assert (langid.gram_set(text) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter("NOT held_out"))
    found = langid.predict(docs, model).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    test = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_prediction_uses_text_only(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    other = docs.selectExpr("doc_id", "text", "'xx' lang", "'clash' lang_pred", "1 score").repartition(5)
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(other, model).collect()}
    assert plain.keys() == again.keys()
    assert all(plain[k][0] == again[k][0] and abs(plain[k][1] - again[k][1]) < 1e-4 for k in plain)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of " * 40_000), (4, "the and of"), (None, "été à la maison"), (6, "İstanbul\U0001f600")]
    docs = spark.createDataFrame([(d, t, "en" if d == 4 else "fr") for d, t in rows], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    found = langid.predict(docs, model).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.text): r for r in found}
    for d, t in rows[:3]:
        assert (by[d, t].lang_pred, by[d, t].score) == ("und", 0.0)
    assert by[4, "the and of"].lang_pred == "en"
    none = langid.fit(docs.selectExpr("text", "cast(null as string) lang"))
    assert none is None
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.filter("false"), model).count() == 0

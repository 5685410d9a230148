"""License scan against a plain scan of every block and word."""

import re

import duckdb

from hailgrid.llm import licenses as li
from hailgrid.llm import oracles

WORD = re.compile(li.WORD)
LOWER = {c: c + 32 for c in range(65, 91)}


def blocks(low, grain):
    for paragraph in re.split(li.PARAGRAPH, low):
        if grain == "paragraph":
            yield paragraph
        else:
            lines = re.split(li.LINE, paragraph)
            yield from ("\n".join(lines[i : i + n]) for n in range(1, li.LINES + 1) for i in range(len(lines)))


def brute(text, threshold=li.THRESHOLD):
    low = (text or "").translate(LOWER)
    own = WORD.findall(low)
    starts, base = [], set()
    for phrase, label in li.PHRASES:
        p = phrase.split()
        for i in range(len(own) - len(p) + 1):
            if own[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    labels, best = set(base), 0.0
    for grain, label, template in li.TEMPLATES:
        t = li.template_words(template)
        for block in blocks(low, grain):
            part = len(t & set(WORD.findall(block))) / len(t)
            if part >= threshold - 1e-12:
                labels.add(label)
                best = max(best, part)
    score = 1.0 if starts else best
    return (len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def rows(df):
    return sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in df.collect()), key=str)


MIT = next(t for g, label, t in li.TEMPLATES if g == "paragraph" and label == "mit")
TEXTS = [
    None, "", "MIT", "the MIT license. mit-license MITlicense", "x Apache\nLicense y General Public\tLicense z mit  license", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0",
    "Released\nunder the MIT\nlicense", MIT, MIT.replace(" ", "\n"), MIT.replace("merge", "x").replace("sell", "y"), " ".join(MIT.split()[: len(MIT.split()) // 2]),
    "a b " * 30_000 + "\n\n" + MIT.upper() + "\n \n" + "general public license " * 500, "É MIT License é1", "Use of this source code is governed by a BSD-style license", "\x00mit\x7flicense",
    "see\nLicensed under CC\nBY-NC 4.0.\nend", "Licensed under\r\nCC BY-SA\r\n4.0.", "Licensed\nunder\nCC BY\nNC 4.0.", "Licensed under CC\n\nBY-NC 4.0.",
    "This work is licensed under a Creative Commons\nAttribution 4.0\nInternational License.", *(t.replace(" ", "\n", 9) + "\n\nx" for g, _, t in li.TEMPLATES if g == "paragraph"),
]


def test_texts(spark):
    own = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, MIT)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in own], "doc_id long, text string, _row int, low string").repartition(3)
    assert rows(li.scan(docs)) == sorted(((str(d), *brute(t)) for d, t in own), key=str)
    assert rows(li.scan(docs, threshold=0.6)) == sorted(((str(d), *brute(t, 0.6)) for d, t in own), key=str)
    assert li.scan(docs.filter("false")).count() == 0


def test_wrapped_notices_and_whole_texts(spark):
    wrapped = [("cc-by-nc", "x\nLicensed under CC\nBY-NC 4.0.\ny"), ("cc-by-sa", "Licensed under\nCC BY-SA\n4.0."), ("bsd", "Use of this source code\nis governed by a\nBSD-style license."), ("", "Licensed under CC\n\nBY-NC 4.0.")]
    whole = [(label, "start\n\n" + text.replace(", ", ",\n")) for grain, label, text in li.TEMPLATES if grain == "paragraph"]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(wrapped + whole)], "doc_id long, text string")
    found = {r.doc_id: r.labels.split(",") for r in li.scan(docs).collect()}
    assert [label for i, (label, _) in enumerate(wrapped + whole) if label not in found[i]] == []
    assert {"mit", "apache", "gpl", "lgpl", "agpl", "bsd", "isc", "mpl", "unlicense", "cc0"} <= {x for own in found.values() for x in own}


def test_sql(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = [(str(r[0]), *r[1:7], round(r[7], 9)) for r in con.sql(oracles.oracle_sql()["op7_license_containment"]).fetchall()]
    assert sorted(((r[0], r[1], r[2], *r[3:]) for r in sql), key=str) == rows(li.scan(docs))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows(li.scan(docs))
    assert got == sorted(((str(r.doc_id), *brute(r.text)) for r in docs.collect()), key=str)
    assert {"mit", "apache", "gpl", "cc-by-nc"} <= {x for r in got for x in r[6].split(",")}


def test_word_order_follows_the_corpus(spark):
    docs = spark.createDataFrame([("a b",), ("a a a",), ("a b c",)], "text string")
    assert li.word_order(docs, ["a", "b", "c", "d"]) == {"d": 0, "c": 1, "b": 2, "a": 3}

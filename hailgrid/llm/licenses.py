"""License scan: phrases by position, and an exact set-similarity join of text blocks with license templates.

A block matches a template when it holds at least ``THRESHOLD`` of the template's distinct words.
Words are ordered by how many documents hold them, rarest first, counted over the
whole corpus. A matching block must hold one of the first |T| - ceil(t |T|) + 1
words of a template (prefix filter), enough template words at all (length filter), and
enough words around the one that was met (positional filter); what remains is counted exactly.

Notices of a sentence are looked for in every run of ``LINES`` adjacent lines of a paragraph, since they may be wrapped; longer texts in paragraphs.
The templates are a fixed list, so their index is small whatever the corpus is.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hailgrid.llm.common import lower_ascii, text_or_empty, with_row_id
from hailgrid.session import materialize

# The word pattern, the phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EDGE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# The same class put the other way, which Java's matcher runs over three times as fast, and what lies between words.
FAST_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
BETWEEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Public license notices and passages, each with its label.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
)
PASSAGES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
     "software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, "
     "without warranties or conditions of any kind, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
     "Software Foundation, either version 3 of the license, or at your option any later version."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for "
     "a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
     "of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
     "Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
     "Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
     "prior written permission."),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied "
     "warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, "
     "indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or "
     "profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
     "arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and "
     "fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data "
     "or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
     "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under "
     "copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies."),
    ("mpl", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one."),
)
TEMPLATES = tuple(("line", *x) for x in NOTICES) + tuple(("paragraph", *x) for x in PASSAGES)
LINE, PARAGRAPH = r"[\r\n]+", r"\r?\n[ \t]*\r?\n\s*"
# Adjacent lines that a notice may be wrapped over. A run of so many holds the words of all shorter ones in it.
LINES = 3
THRESHOLD = 0.9


def template_words(text: str) -> frozenset[str]:
    return frozenset(re.findall(WORD, text.lower()))


def words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(FAST_WORD), F.lit(0))


def line_runs(lines: Column) -> Column:
    """Every run of ``LINES`` adjacent lines, and the shorter ones at the end, as texts."""
    return F.transform(lines, lambda _, i: F.array_join(F.slice(lines, i + 1, F.lit(LINES)), "\n"))


def word_order(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Ranks of the template words, by the number of documents that hold them, rarest first; ties by the word."""
    # The plain lower() will do here: it differs in a few letters that no template has, and the order decides no result.
    held = docs.select(F.explode(F.array_intersect(F.split(F.lower("text"), BETWEEN, -1), F.array(*map(F.lit, vocabulary)))).alias("word"))
    # As many rows as the templates have words.
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def places(low: Column, phrases=PHRASES) -> Column:
    """Array of (start, label) for each place where a phrase's words stand consecutively."""
    own = words(low)
    most = max(len(p.split()) for p, _ in phrases)
    beside = F.arrays_zip(*[F.slice(own, i + 1, F.greatest(F.size(own) - i, F.lit(0))).alias(f"w{i}") for i in range(most)])

    def starts(phrase: str, label: str) -> Column:
        def found(x: Column, i: Column) -> Column:
            here = F.lit(True)
            for k, word in enumerate(phrase.split()):
                here = here & (x[f"w{k}"] == word)
            return F.when(here, F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

        return F.filter(F.transform(beside, found), lambda x: x.isNotNull())

    return F.concat(*[starts(*p) for p in phrases])


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs`` (doc_id, text).

    ``score`` is 1 where a phrase stands, else the best template containment that met the threshold, else 0. A null
    text is empty; a null doc_id stays null; repeated rows are scanned each; other columns are ignored; no rows give no rows.
    """
    sets = [(grain, label, template_words(text)) for grain, label, text in templates]
    rank = word_order(docs.select(text_or_empty().alias("text")), sorted(set().union(*[s for _, _, s in sets])))
    index = []  # (template, label, grain, its ranks in order, least overlap)
    for number, (grain, label, own) in enumerate(sets):
        index.append((number, label, grain, sorted(rank[w] for w in own), math.ceil(threshold * len(own) - 1e-9)))
    prefixes = [(t, label, grain, order, least, order[p], p) for t, label, grain, order, least in index for p in range(len(order) - least + 1)]
    by_rank = sorted(rank, key=rank.get)

    low = F.col("low")
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    vocabulary = F.array(*map(F.lit, by_rank))

    def blocks(grain: str) -> Column:
        """The template words, as ordered ranks, of each block that passes the prefix and the length filter."""
        first = sorted({by_rank[r] for _, _, g, _, _, r, _ in prefixes if g == grain})
        least = min(n for _, _, g, _, n in index if g == grain)
        met = rf"(?:^|{EDGE})(?:{'|'.join(map(re.escape, first))})(?:$|{EDGE})"
        chosen = F.filter(F.split(low, PARAGRAPH, -1), lambda block: block.rlike(met))
        if grain == "line":
            runs = F.flatten(F.transform(chosen, lambda block: line_runs(F.split(block, LINE, -1))))
            chosen = F.filter(runs, lambda block: block.rlike(met))
        held = F.transform(chosen, lambda b: F.sort_array(F.transform(F.array_intersect(words(b), vocabulary), lambda w: ranks[w])))
        long = F.filter(held, lambda b: F.size(b) >= least)
        return F.transform(long, lambda b: F.struct(F.lit(grain).alias("grain"), b.alias("own")))

    grains = sorted({g for g, _, _ in sets})
    # Few texts hold a phrase's last word or a prefix word; only those are lower-cased and cut up.
    last = "|".join(sorted({re.escape(p.split()[-1]) for p, _ in phrases}))
    first = F.array(*[F.lit(by_rank[r]) for r in sorted({r for *_, r, _ in prefixes})])
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.split(F.lower(text), BETWEEN, -1).alias("cut"))
    # lower() changes no word's edges, so the cuts give the number of words; a text that begins or ends between words has an empty end.
    ends = (F.get("cut", 0) == "").cast("int") + ((F.size("cut") > 1) & (F.get("cut", F.size("cut") - 1) == "")).cast("int")
    rows = rows.select(
        "doc_id",
        (F.size("cut") - ends).cast("long").alias("n_words"),
        F.col("text").rlike(f"(?i)(?:{last})").alias("has_last"),
        F.arrays_overlap("cut", first).alias("has_first"),
        "text",
    )
    marked = F.col("has_last") | F.col("has_first")
    rows = rows.select("doc_id", "n_words", "has_last", "has_first", F.when(marked, lower_ascii(F.col("text"))).alias("low"))
    rows = rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("has_last"), places(low, phrases)).alias("places"),
        F.when(F.col("has_first"), F.concat(*[blocks(g) for g in grains])).alias("blocks"),
    )
    rows = materialize(with_row_id(rows))

    spark = docs.sparkSession
    table = spark.createDataFrame(prefixes, "template int, label string, grain string, ranks array<int>, least int, met int, at int")
    held = rows.select("_row", F.explode("blocks").alias("b")).select("_row", "b.*").withColumn("met", F.explode("own"))
    # One row per prefix word of a fixed list of templates.
    pairs = held.join(F.broadcast(table), ["grain", "met"]).filter(F.size("own") >= F.col("least"))
    at = F.array_position("own", F.col("met")).cast("int") - 1
    most = F.least(at, "at") + 1 + F.least(F.size("own") - at - 1, F.size("ranks") - F.col("at") - 1)
    pairs = pairs.filter(most >= F.col("least"))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("own", "ranks"))).filter(F.col("overlap") >= F.col("least"))
    matched = pairs.groupBy("_row").agg(F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.size("ranks")).alias("best"))

    starts = F.transform("places", lambda x: x["start"])
    base = F.coalesce(F.array_distinct(F.transform("places", lambda x: x["label"])), F.array().cast("array<string>"))
    n_base = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")
    return rows.join(matched, "_row", "left").select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

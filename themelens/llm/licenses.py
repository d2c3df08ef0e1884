"""License scans: exact set-similarity join of text blocks with license templates.

Block and template are sets of words.  A template of n words (repeats counted) is compared
with every block of n / ``threshold`` consecutive words of a text, wherever its lines end; a
shorter text is one block.  It is found if a block holds at least ``threshold`` of its
distinct words.  The template words are ordered by the number of texts that hold them,
rarest first.  A text is compared only with the templates of which it holds one of the
first words in that order (prefix filter) and enough words at all (length filter).  Within
it, only those blocks are looked at that start with a word of the template, in which enough
words of it follow (positional filter), one of the first words among them; what passes is
verified by the exact overlap.  The templates are a small fixed index, of one value in the
plan whatever their number, that is looked up inside the row; nothing is shuffled but the
template words' counts.

Beside the join, the base places of short phrases are found word by word.

Defined results: a null text is the empty text, without words, labels or score; every row
is scanned for itself, so repeated rows, ties and null ids don't matter; an empty table
gives no rows; extra columns are carried along in ``row``, under any name; a template
without words is found nowhere.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.functions.vectors import json_literal, string_array

from .common import query, read

# Phrases whose words count as a base place, and their labels.
PHRASES = [
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
]

# Notices that licenses ask to be put in texts, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
            "of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with "
               "the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("reserved", "All rights reserved"),
]

#: Characters between words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Letters past ASCII that lower-casing would turn into ASCII ones: the Kelvin sign, I with a dot.
FOLDING = ["\u212A", "\u0130"]
INDEX_TYPE = "array<struct<label:string,words:array<string>,rare:array<string>,need:int,width:int>>"


def sequence_of(text: str) -> list[str]:
    """All words of a template."""
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def words_of(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys(sequence_of(text)))


def block_width(text: str, threshold: float) -> int:
    """Words of a block that is compared with a template."""
    return math.ceil(len(sequence_of(text)) / threshold - 1e-9)


def scan_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """row, flat (words joined by single spaces), words (none: the empty string)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for letter in FOLDING:  # no word with them is a template's or phrase's, nor may become one
        text = F.replace(text, F.lit(letter), F.lit("\u00E0"))
    flat = F.trim(F.regexp_replace(F.lower(text), BETWEEN, " "))
    return docs.select(F.struct("*").alias("row"), flat.alias("flat")).withColumn("words", F.split("flat", " "))


def word_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words by the number of texts that hold them, rarest first."""
    held = rows.select(F.explode(F.array_intersect(string_array(vocabulary), "words")).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}  # one row a template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_index(templates, order: list[str], threshold: float) -> list[dict]:
    """For each template its label, words in the global order, first words, least overlap and width of a block."""
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for label, text in templates:
        words = sorted(words_of(text), key=rank.__getitem__)
        need = max(math.ceil(threshold * len(words) - 1e-9), 1)
        if words:
            index.append({"label": label, "words": words, "rare": words[:len(words) - need + 1], "need": need,
                          "width": block_width(text, threshold)})
    return index


def best_overlap(spots, need, width):
    """The most distinct template words of a block, or null; ``spots``: (at, word, rare) of a template's words."""
    def block(k):
        return F.filter(F.slice(spots, k + 1, width), lambda x: x["at"] < F.get(spots, k)["at"] + width)

    starts = F.filter(F.sequence(F.lit(0), F.size(spots) - need),
                      lambda k: F.get(spots, k + need - 1)["at"] < F.get(spots, k)["at"] + width)
    blocks = F.filter(F.transform(starts, block), lambda b: F.exists(b, lambda x: x["rare"]))
    return F.array_max(F.transform(blocks, lambda b: F.size(F.array_distinct(b["word"]))))


def scan_licenses(docs: DataFrame, templates=None, phrases=None, threshold: float = 0.9,
                  text_col: str = "text") -> DataFrame:
    """row, n_words, places (label and first word of each base phrase), found (label and containment)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    rows = scan_rows(docs, text_col)
    order = word_order(rows, sorted({w for _, text in templates for w in words_of(text)}))
    index = template_index(templates, order, threshold)
    rare = string_array(sorted({w for t in index for w in t["rare"]}))

    rows = rows.withColumn("held", F.when(F.arrays_overlap("words", rare), F.array_intersect(string_array(order), "words")))
    rows = rows.withColumn("near", F.when(F.col("held").isNotNull(), F.filter(
        json_literal(index, INDEX_TYPE), lambda t: F.arrays_overlap(t["rare"], F.col("held"))
        & (F.size(F.array_intersect(t["words"], F.col("held"))) >= t["need"]))))
    rows = rows.withColumn("near", F.when(F.size("near") > 0, F.transform("near", lambda t: F.struct(
        t.alias("t"), F.filter(
            F.transform("words", lambda w, at: F.when(F.array_contains(t["words"], w), F.struct(
                at.alias("at"), w.alias("word"), F.array_contains(t["rare"], w).alias("rare")))),
            lambda x: x.isNotNull()).alias("spots")))))
    rows = rows.withColumn("found", F.transform("near", lambda n: F.struct(
        n["t"]["label"].alias("label"), n["t"]["need"].alias("need"), F.size(n["t"]["words"]).alias("size"),
        best_overlap(n["spots"], n["t"]["need"], n["t"]["width"]).alias("overlap"))))
    found = F.transform(F.filter("found", lambda f: f["overlap"] >= f["need"]), lambda f: F.struct(
        f["label"].alias("label"), (f["overlap"] / f["size"].cast("double")).alias("containment")))

    spaced = F.concat(F.lit(" "), F.col("flat"), F.lit(" "))
    any_place = F.lit(False)
    for words, _ in phrases:
        any_place = any_place | F.contains(spaced, F.lit(f" {' '.join(words)} "))
    rows = rows.withColumn("flat_words", F.when(any_place, F.col("words")))
    flat = F.col("flat_words")

    def places(words, label):
        def here(i):
            same = F.get(flat, i) == words[0]
            for k, w in enumerate(words[1:], 1):
                same = same & F.coalesce(F.get(flat, i + k) == w, F.lit(False))
            return same
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(flat) - 1), here),
                           lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("word")))

    n_words = F.when(F.col("flat") == "", 0).otherwise(
        F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) + 1)
    place = F.concat(*[places(*p) for p in phrases]) if phrases else None
    kinds = "array<struct<label:string,word:bigint>>", "array<struct<label:string,containment:double>>"
    return rows.select(
        "row", n_words.cast("long").alias("n_words"),
        (F.coalesce(F.when(flat.isNotNull(), place), F.array().cast(kinds[0])) if phrases
         else F.array().cast(kinds[0])).alias("places"),
        F.coalesce(found, F.array().cast(kinds[1])).alias("found"))


def joined(labels):
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _sql() -> str:
    fold = "coalesce(text, '')"
    for letter in FOLDING:
        fold = f"replace({fold}, chr({ord(letter)}), chr(224))"
    rows = ", ".join(f"({k}, '{label}', {words_of(text)}, {block_width(text, 0.9)})"
                     for k, (label, text) in enumerate(TEMPLATES))
    tests = " UNION ALL ".join(
        "SELECT k, '{}' AS label, unnest([i - 1 FOR i IN range(1, len(w) + 1) IF {}]) AS spot FROM d".format(
            label, " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(ws))) for ws, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
             regexp_extract_all(lower({fold}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) AS v(n, label, tw, width)),
s AS (SELECT k, n, i, word, width FROM (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS i FROM d)
      JOIN (SELECT n, width, unnest(tw) AS word FROM t) USING (word)),
b AS (SELECT k, n, count(DISTINCT word) OVER (PARTITION BY k, n ORDER BY i
        RANGE BETWEEN CURRENT ROW AND (width - 1) FOLLOWING) AS held FROM s),
c AS (SELECT k, label, max(held) / CAST(len(tw) AS DOUBLE) AS part
      FROM b JOIN t USING (n) GROUP BY k, n, label, tw HAVING max(held) >= ceil(0.9 * len(tw) - 1e-9)),
p AS ({tests}),
pk AS (SELECT k, count(*) AS n, min(spot) AS first, max(spot) AS last,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY k),
lk AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM (SELECT k, label FROM p UNION ALL SELECT k, label FROM c) GROUP BY k),
ck AS (SELECT k, max(part) AS score FROM c GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
       CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
       coalesce(pk.labels, '') AS base_labels, coalesce(lk.labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN pk USING (k) LEFT JOIN lk USING (k) LEFT JOIN ck USING (k)
"""


@query("op10_license_scan", _sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of every document, and the labels and best containment of the join."""
    found = scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"))
    labels, words = F.col("places.label"), F.col("places.word")
    return found.select(
        "row.doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.col("found.label"))).alias("labels"),
        F.coalesce(F.array_max("found.containment"), F.lit(0.0)).alias("score"))

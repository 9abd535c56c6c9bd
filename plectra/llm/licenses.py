"""License scans by diagonal voting, with DataFrame functions only.

Every rolling k-gram of a document's words is joined to the templates' k-grams.  A hit votes for the
diagonal (document position less template position).  A diagonal with every vote of its template is an
exact place; neighbouring diagonals, which words put in or left out pull apart, are merged, and a merged
span is verified by the share of the template's k-grams that it holds.  A template's k-grams are bits, so a diagonal
and a span have a fixed size, however often a phrase is repeated.

Defined results: a template of fewer than three words has no k-gram and is never found; a null text is empty; a row is a document, and repeated rows give equal results; ids may
be null; without labels the label strings are empty; other columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import ascii_lower, order_id, table

GRAM = 3
SHARE = 0.8
SLACK = 3
BROADCAST_GRAMS = 20_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base scan.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Whole notices of public licences, and the short forms by which texts refer to them.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]


def scan_words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD, -1), "")


def word_count(text: str) -> int:
    """How many words ``scan_words`` finds in a template."""
    return len([w for w in re.split(NOT_WORD, text) if w])


def grams(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, at, a, b, c): each run of three words and its start, from 0."""
    w = F.col(words)
    shift = lambda k: F.slice(w, k, F.greatest(F.size(w), F.lit(1)))
    zipped = F.arrays_zip(w.alias("a"), shift(2).alias("b"), shift(3).alias("c"))
    rows = df.select(*keys, F.posexplode(zipped).alias("at", "g"))
    return rows.select(*keys, "at", "g.a", "g.b", "g.c").where(F.col("c").isNotNull())


def templates(spark: SparkSession, base: list, notices: list) -> DataFrame:
    """(tid, label, base, n_grams, t_at, a, b, c)"""
    rows = [(i, label, i < len(base), text) for i, (label, text) in enumerate([*base, *notices])]
    df = spark.createDataFrame(rows, "tid int, label string, base boolean, text string")
    df = df.select("tid", "label", "base", scan_words(F.col("text")).alias("words"))
    df = df.withColumn("n_grams", F.size("words") - (GRAM - 1))
    return grams(df, ["tid", "label", "base", "n_grams"], "words").withColumnRenamed("at", "t_at")


def license_spans(docs: DataFrame, base: list = BASE_PHRASES, notices: list = NOTICES, share: float = SHARE, slack: int = SLACK) -> DataFrame:
    """(id, th, tid, label, base, exact, start, stop, coverage): merged spans and exact places.

    ``id`` and ``th`` name a document's id and text.
    """
    spark = docs.sparkSession
    known = templates(spark, base, notices)
    sizes = [word_count(text) for _, text in [*base, *notices]]
    if sum(sizes) <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    rows = docs.select(order_id().alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), scan_words(F.col("text")).alias("words"))
    rolling = grams(rows, ["id", "th"], "words").withColumn("gram", F.xxhash64("a", "b", "c"))
    known = known.withColumn("gram", F.xxhash64("a", "b", "c"))
    hits = rolling.join(known, ["gram", "a", "b", "c"])
    marks = [f"m{i}" for i in range(1 + max(sizes, default=0) // 64)]
    own_bit = F.expr("shiftleft(1L, t_at % 64)")
    bits = [F.bit_or(F.when(F.floor(F.col("t_at") / 64) == i, own_bit).otherwise(F.lit(0).cast("long"))).alias(m) for i, m in enumerate(marks)]
    held = lambda: sum((F.bit_count(m) for m in marks[1:]), F.bit_count(marks[0]))
    diagonals = hits.groupBy("id", "th", "tid", "label", "base", "n_grams", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        *bits, F.min("at").alias("start"), (F.max("at") + GRAM).alias("stop")
    )
    diagonals = diagonals.withColumn("exact", held() == F.col("n_grams"))
    order = Window.partitionBy("id", "th", "tid").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    island = F.sum(F.when(gap <= slack, 0).otherwise(1)).over(order)
    spans = (
        diagonals.withColumn("island", island)
        .groupBy("id", "th", "tid", "label", "base", "n_grams", "island")
        .agg(
            F.sum(F.col("exact").cast("long")).alias("exact"),
            F.min(F.when(F.col("exact"), F.col("start"))).alias("first_exact"),
            F.max(F.when(F.col("exact"), F.col("start"))).alias("last_exact"),
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            *[F.bit_or(m).alias(m) for m in marks],
        )
    )
    return spans.withColumn("coverage", held() / F.col("n_grams")).drop("island", "n_grams", *marks).withColumn(
        "accepted", F.col("coverage") >= share
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    exact = F.col("base") & (F.col("exact") > 0)
    names = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    found = license_spans(docs).groupBy("id", "th").agg(
        F.sum(F.when(F.col("base"), F.col("exact"))).alias("n_base"),
        F.min(F.when(exact, F.col("first_exact"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("last_exact"))).cast("long").alias("last_word"),
        names(exact).alias("base_labels"),
        names(exact | (~F.col("base") & F.col("accepted"))).alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select(
        "doc_id",
        order_id().alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.size(scan_words(F.col("text"))).cast("long").alias("n_words"),
    )
    none = F.lit("")
    return rows.join(found, ["id", "th"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

Features are word n-grams (single words and pairs) of the licence notices below that hardly
occur in ordinary paragraphs. A multinomial logistic regression (Spark ML, on the JVM)
learns the families from the notices and parts of them, and the class "unknown" from all
ordinary paragraphs of the corpus, counted by their known n-grams. A paragraph is taken for a family if that
class is likeliest and its probability reaches a threshold that at most `false_share` of
these paragraphs reach; it is confirmed by the notice of that family whose n-grams
it contains most of, `contained` of them at least.

A notice may be wrapped, with marks of comments before its lines. So n-grams also join over
line ends up to a line without words, and each notice is looked for in windows of WIDER times
its words, wherever lines end. Where most of its n-grams are, if they are `contained` at
least and on several lines, the classifier judges the window as it does a line.

Scoring explodes paragraphs into n-grams and joins them with the table of weights, which is
no larger than the notices and so is broadcast; only hits are shuffled.

Defined cases: null and empty texts have no paragraph and no licence; very long texts are
scanned whole; repeated rows are found each; an empty table gives no rows; paragraphs are
lines that aren't blank, and wrapped notices whose family no line of theirs has; extra columns are kept, and input columns named as the results
are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from hayrick.llm import common

# Customary notices and paragraphs of each family's text.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "zlib": (
        "Licensed under the zlib license.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public domain": (
        "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NOTICES]
LENGTHS = [len([w for w in re.split(r"[\W_]+", t) if w]) for ts in NOTICES.values() for t in ts]
#: Words of a window, times those of its notice
WIDER = 1.25
#: Frames of Spark's windows are whole numbers: a window's width is so many units.
SCALE = 1_000_000


def ngrams(text: Column) -> Column:
    """Words and pairs of neighbouring words of a short text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.contains(" "))))


def paragraphs(docs: DataFrame, *keep: str) -> DataFrame:
    lines = docs.select(*keep, F.posexplode(F.split(common.whole_text(), "\n")).alias("paragraph", "line"))
    return lines.where(F.trim("line") != "")


def _starts(grams: list[str]) -> list[str]:
    """The words that these n-grams begin with: others needn't be looked up."""
    return sorted({g.split(" ")[0] for g in grams})


def positioned(docs: DataFrame, starts: list[str], *keep: str) -> DataFrame:
    """keep, block (a run of lines with words), line and word (numbers within it), ngram (begins with one of starts), and across (a pair over a line end)."""
    blocks = docs.select(*keep, F.posexplode(F.split(F.lower(common.whole_text()), r"\n(?:[^\p{L}\p{N}\n]*+\n)++")).alias("block", "text"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.transform(F.split(x, r"[^\p{L}\p{N}]+"), lambda w: F.struct(i.alias("line"), w.alias("w"))))
    words = blocks.select(*keep, "block", F.filter(F.flatten(lines), lambda w: w["w"] != "").alias("words"))
    both = words.select(*keep, "block", F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))).alias("word", "z")).where(F.col("z.a.w").isin(starts))
    a, b = F.col("z.a"), F.col("z.b")
    two = F.array(F.struct(a["w"].alias("ngram"), F.lit(False).alias("across")), F.struct(F.concat(a["w"], F.lit(" "), b["w"]).alias("ngram"), (a["line"] != b["line"]).alias("across")))
    return both.select(*keep, "block", a["line"].alias("line"), "word", F.inline(two)).where(F.col("ngram").isNotNull())


class Model:
    """weights: DataFrame of ngram, weights (one a class) and notices (numbers of those that contain it)."""

    def __init__(self, weights: DataFrame, intercepts: list[float], sizes: list[tuple[int, int]], threshold: float = 0.5):
        self.weights, self.intercepts, self.sizes, self.threshold = weights, intercepts, sizes, threshold

    def hits(self, lines: DataFrame, keep: list[str]) -> DataFrame:
        """Per paragraph with any known n-gram: the sum of weights by class, and matched n-grams by notice."""
        words = lines.select(*keep, F.split(F.lower("line"), r"[^\p{L}\p{N}]+").alias("words"))
        both = words.select(*keep, F.inline(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))))
        grams = both.select(*keep, F.explode(F.array(F.col("a"), F.concat(F.col("a"), F.lit(" "), F.col("b")))).alias("ngram"))
        return self.summed(grams.where(F.col("ngram").isNotNull()).join(F.broadcast(self.weights), "ngram"), keep)

    def summed(self, found: DataFrame, keep: list[str]) -> DataFrame:
        once = found.groupBy(*keep, "ngram").agg(F.first("weights").alias("weights"), F.first("notices").alias("notices"))
        sums = [F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(FAMILIES))]
        counts = [F.sum(F.array_contains("notices", i).cast("int")).alias(f"t{i}") for i in range(len(self.sizes))]
        return once.groupBy(*keep).agg(F.count(F.lit(1)).alias("n_ngrams"), *sums, *counts)

    def scored(self, lines: DataFrame, keep: list[str]) -> DataFrame:
        """keep, family (the likeliest), probability (of it) and containment (the largest of the family's notices)."""
        return self.judged(self.hits(lines, keep), keep)

    def judged(self, hits: DataFrame, keep: list[str]) -> DataFrame:
        z = [F.col(f"z{k}") + F.lit(self.intercepts[k]) for k in range(len(FAMILIES))]
        top = F.greatest(*z)
        total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
        best = F.array_max(F.array(*[F.struct(x.alias("z"), F.lit(k).alias("k")) for k, x in enumerate(z)]))
        shares = {k: [F.col(f"t{i}") / F.lit(size) for i, (family, size) in enumerate(self.sizes) if family == k] for k in range(1, len(FAMILIES))}
        contained = F.lit(0.0)
        for k, some in shares.items():
            contained = F.when(F.col("k") == k, F.greatest(*some) if len(some) > 1 else some[0]).otherwise(contained)
        rows = hits.withColumn("best", best).withColumn("k", F.col("best.k"))
        return rows.select(*keep, F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("k") + 1).alias("family"), (F.exp(F.col("best.z") - top) / total).alias("probability"), contained.alias("containment"))


def _grams(lines: DataFrame, starts: list[str], *keep: str) -> DataFrame:
    """Words and pairs of neighbouring words of lines that begin with one of starts, each as often as it occurs."""
    words = lines.select(*keep, F.split(F.lower("line"), r"[^\p{L}\p{N}]+").alias("words"))
    both = words.select(*keep, F.inline(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b")))).where(F.col("a").isin(starts))
    return both.select(*keep, F.explode(F.array(F.col("a"), F.concat(F.col("a"), F.lit(" "), F.col("b")))).alias("ngram")).where(F.col("ngram").isNotNull())


def _touched(docs: DataFrame, grams: list[str]) -> DataFrame:
    """row, paragraph and line of paragraphs with any of these n-grams."""
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(g,) for g in grams], "ngram string"))  # no more than the notices have
    rows = docs.select(F.monotonically_increasing_id().alias("row"), common.whole_text().alias("text"))
    found = _grams(paragraphs(rows, "row"), _starts(grams), "row", "paragraph", "line").join(wanted, "ngram", "left_semi")
    return common.materialize(found.groupBy("row", "paragraph").agg(F.first("line").alias("line")), "touched")


def train(docs: DataFrame, *, common_share: float = 0.005, false_share: float = 0.0005, much: float = 0.4) -> Model:
    """Learn from the notices, and from every paragraph of docs that hasn't more than `much` of a notice's n-grams.

    Paragraphs without an n-gram of the vocabulary are alike to the classifier, and so are those
    with the same n-grams: they enter as one row that weighs as many as they are.
    """
    spark = docs.sparkSession
    flat = [(FAMILIES.index(f), i, t) for i, (f, t) in enumerate((f, t) for f, ts in NOTICES.items() for t in ts)]
    notices = spark.createDataFrame(flat, "family int, notice int, line string")
    of_notice: dict[int, set[str]] = {}
    for row in notices.select("notice", F.explode(ngrams(F.col("line"))).alias("ngram")).collect():
        of_notice.setdefault(row["notice"], set()).add(row["ngram"])
    everything = sorted(set().union(*of_notice.values()))
    known = F.broadcast(spark.createDataFrame([(g,) for g in everything], "ngram string"))
    counts = lambda lines: {r["ngram"]: r["n"] for r in _grams(lines, _starts(everything)).join(known, "ngram").groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).collect()}
    text = docs.select(common.whole_text().alias("text"))
    n_all = text.agg(F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint"))).first()[0] or 0
    times = counts(paragraphs(text, "text").select("line"))
    # Paragraphs with much of a notice are no examples of ordinary text; those that only speak of licences are. To find
    # them all, paragraphs with n-grams that occur seldom are looked at, as many n-grams as leave no notice `much` of its own.
    seldom = sorted(everything, key=lambda g: (times.get(g, 0), g))
    some = {g for g in everything if times.get(g, 0) <= common_share * n_all}
    for grams in of_notice.values():
        for g in seldom:
            if len(grams - some) <= much * len(grams):
                break
            if g in grams:
                some.add(g)
    parts_of = F.broadcast(spark.createDataFrame([(i, len(g), x) for i, g in of_notice.items() for x in sorted(g)], "notice int, size int, ngram string"))
    while True:
        touched = _touched(docs, sorted(some))
        shared = touched.select("row", "paragraph", F.explode(ngrams(F.col("line"))).alias("ngram")).join(parts_of, "ngram").groupBy("row", "paragraph", "notice", "size").agg(F.count(F.lit(1)).alias("n"))
        full = common.materialize(touched.join(shared.where(F.col("n") > much * F.col("size")).select("row", "paragraph").distinct(), ["row", "paragraph"]), "full")
        n, out = n_all - full.count(), counts(full.select("line"))
        usual = {g for g in everything if times.get(g, 0) - out.get(g, 0) > common_share * n}
        if some >= set(everything) - usual:
            break
        some |= set(everything) - usual  # what is frequent in notices only
    by_gram = {g: [i for i in of_notice if g in of_notice[i]] for g in everything if g not in usual}
    sizes = {i: len(g - usual) for i, g in of_notice.items()}
    rare = F.broadcast(spark.createDataFrame([(g,) for g in sorted(by_gram)], "ngram string"))
    each = touched.join(full.select("row", "paragraph"), ["row", "paragraph"], "left_anti").select("row", "paragraph", F.explode(ngrams(F.col("line"))).alias("ngram")).join(rare, "ngram")
    sets = each.groupBy("row", "paragraph").agg(F.array_sort(F.collect_set("ngram")).alias("ngrams")).groupBy("ngrams").agg(F.count(F.lit(1)).alias("times"))
    negatives = common.materialize(sets, "negatives")
    bare = n - (negatives.agg(F.sum("times")).first()[0] or 0)
    ordinary = negatives.unionByName(spark.createDataFrame([([], bare)] if bare else [], negatives.schema))
    vocabulary = sorted(by_gram)
    # Parts of notices, so that one cut short or wrapped is known too
    words = notices.withColumn("w", F.split("line", " "))
    parts = notices.select("family", "line")
    for a, b in ((0, 0.6), (0.4, 1), (0.2, 0.8)):
        parts = parts.unionByName(words.where(F.size("w") > 6).select("family", F.array_join(F.slice("w", (F.size("w") * a + 1).cast("int"), F.ceil(F.size("w") * (b - a)).cast("int")), " ").alias("line")))
    training = parts.select(F.col("family").cast("double").alias("label"), ngrams(F.col("line")).alias("ngrams"), F.lit(1).cast("bigint").alias("times"))
    training = training.unionByName(ordinary.select(F.lit(0.0).alias("label"), "ngrams", "times"))
    # every class has an equal share in the loss
    shares = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.sum("times").alias("n")).collect()}
    weight = F.col("times") * F.element_at(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, 1.0 / v)]), F.col("label"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "ngrams", "features", binary=True).transform(training).withColumn("w", weight)
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, standardization=False, weightCol="w").fit(vectors)
    matrix, intercepts = fitted.coefficientMatrix.toArray().tolist(), [float(x) for x in fitted.interceptVector]
    missing = len(FAMILIES) - len(matrix)  # classes come in order, and the last always has notices
    if missing:
        raise ValueError("a class has no training paragraph")
    rows = [(g, [row[j] for row in matrix], by_gram[g]) for j, g in enumerate(vocabulary)]
    schema = StructType([StructField("ngram", StringType()), StructField("weights", ArrayType(DoubleType())), StructField("notices", ArrayType(IntegerType()))])
    model = Model(spark.createDataFrame(rows, schema), intercepts, [(f, max(1, sizes.get(i, 0))) for f, i, _ in flat])
    scored = model.judged(model.summed(negatives.select("ngrams", "times", F.explode("ngrams").alias("ngram")).join(F.broadcast(model.weights), "ngram"), ["ngrams", "times"]), ["times"])
    by_value = scored.where(F.col("family") != UNKNOWN).groupBy("probability").agg(F.sum("times").alias("times"))
    allowed = int(false_share * n)
    for row in by_value.orderBy(F.desc("probability")).limit(allowed + 1).toLocalIterator():
        allowed -= row["times"]
        if allowed < 0:
            model.threshold = max(0.5, row["probability"] + 1e-6)
            break
    return model


def wrapped(model: Model, hits: DataFrame, contained: float) -> DataFrame:
    """row_key, block, family, first and last (lines) of notices on several lines that windows confirm.

    hits: row_key, block, line, word, ngram, weights and notices of known n-grams.
    """
    place = ["row_key", "block"]
    each = hits.select(*place, "line", "word", "ngram", F.explode("notices").alias("notice"))
    of_notice = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("notice") + 1)
    widths = [math.ceil(WIDER * n) for n in LENGTHS]
    least = contained * of_notice([size for _, size in model.sizes])
    # Blocks that don't have enough of a notice altogether have no such window.
    enough = each.groupBy(*place, "notice").agg(F.countDistinct("ngram").alias("n"), F.countDistinct("line").alias("n_lines")).where((F.col("n") >= least) & (F.col("n_lines") > 1))
    each = each.join(enough.select(*place, "notice"), [*place, "notice"]).withColumn("at", F.floor(F.col("word").cast("bigint") * F.lit(SCALE) / of_notice(widths)))
    ordered = Window.partitionBy(*place, "notice").orderBy("at")
    inside = ordered.rangeBetween(0, SCALE - 1)  # one width from this word on
    each = each.select(*place, "notice", "word", "at", F.size(F.collect_set("ngram").over(inside)).alias("n"), F.min("line").over(inside).alias("first"), F.max("line").over(inside).alias("last")).distinct()
    best = F.max(F.struct("n", "word")).over(ordered.rangeBetween(-SCALE, SCALE))
    each = each.withColumn("best", best).where((F.col("n") >= least) & (F.col("best.n") == F.col("n")) & (F.col("best.word") == F.col("word")) & (F.col("first") < F.col("last")))
    # All n-grams of a window; of two neighbouring buckets of the widest window's words it touches no others.
    widest = max(widths)
    windows = each.select(*place, "notice", F.col("word").alias("start"), (F.col("word") + of_notice(widths)).alias("end"), "first", "last", of_notice([FAMILIES[k] for k, _ in model.sizes]).alias("of"))
    touched = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / widest), F.floor(F.col("end") / widest))))
    parts = touched.join(hits.withColumn("bucket", F.floor(F.col("word") / widest)), [*place, "bucket"]).where((F.col("word") >= F.col("start")) & (F.col("word") < F.col("end")))
    keep = [*place, "notice", "start", "first", "last", "of"]
    found = model.judged(model.summed(parts, keep), keep)
    return found.where((F.col("family") == F.col("of")) & (F.col("probability") >= model.threshold)).select(*place, "family", "first", "last")


def scan(docs: DataFrame, model: Model, *, contained: float = 0.6) -> DataFrame:
    """docs with licences (confirmed families, in order), n_paragraphs (with a confirmed one) and n_unconfirmed."""
    docs = docs.drop("licences", "n_paragraphs", "n_unconfirmed")
    # Rows are told apart by id and text, so that rows with one id keep their own results.
    (key,) = common.unlike(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("text")))
    starts = _starts([r["ngram"] for r in model.weights.select("ngram").collect()])
    known = positioned(keyed.select(F.col(key).alias("row_key"), "text"), starts, "row_key").join(F.broadcast(model.weights.select("ngram")), "ngram")
    known = common.materialize(known, "known").join(F.broadcast(model.weights), "ngram")
    place = ["row_key", "block", "line"]
    found = model.judged(model.summed(known.where(~F.col("across")), place), place).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))
    lines = common.materialize(found.select(*place, "family", (F.col("containment") >= contained).alias("sure")), "lines")
    runs = common.materialize(wrapped(model, known, contained), "wrapped")
    # A run counts once, and only if none of its lines has its family; its lines are confirmed.
    covered = runs.select("row_key", "block", "family", "first", F.explode(F.sequence("first", "last")).alias("line"))
    told = covered.join(lines.where("sure"), [*place, "family"]).select("row_key", "block", "family", "first").distinct()
    until = Window.partitionBy("row_key", "block", "family").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = runs.join(told, ["row_key", "block", "family", "first"], "left_anti").withColumn("before", F.max("last").over(until))
    fresh = fresh.where(F.col("before").isNull() | (F.col("first") > F.col("before"))).select("row_key", "family", F.lit(True).alias("sure"))
    left = lines.where(F.col("sure")).unionByName(lines.where(~F.col("sure")).join(covered.select(*place).distinct(), place, "left_anti"))
    by_row = left.select("row_key", "family", "sure").unionByName(fresh).groupBy("row_key").agg(
        F.array_sort(F.collect_set(F.when(F.col("sure"), F.col("family")))).alias("licences"),
        F.sum(F.col("sure").cast("bigint")).alias("n_paragraphs"),
        F.sum((~F.col("sure")).cast("bigint")).alias("n_unconfirmed"),
    )
    out = keyed.join(by_row.withColumnRenamed("row_key", key), key, "left").drop(key)
    return out.withColumns({"licences": F.coalesce("licences", F.array().cast("array<string>")), "n_paragraphs": F.coalesce("n_paragraphs", F.lit(0)), "n_unconfirmed": F.coalesce("n_unconfirmed", F.lit(0))})


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs)).drop("text")

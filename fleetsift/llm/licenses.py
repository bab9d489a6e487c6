"""Licence scans: which paragraphs of a text state a licence, and of which family.

A sparse multinomial logistic regression over word n-grams is trained on varied notices of each
family, on licence-like sentences of none of them (class `unknown`) and on paragraphs of a bounded
sample of documents (class `none`).  Its probabilities are calibrated by a temperature fitted on
variants kept apart; what stays below the threshold is `unknown`.  A family is confirmed where the
paragraph holds most words of one of its notices.  DataFrame and SQL functions and Spark's own
regression only.

Only n-grams with a *cue*, a word of the notices that hardly occurs in lines of the documents, are
features.  A paragraph without a cue has no feature and is `none` by the intercepts; so looking for
cues first, once over all words of a text, changes no answer.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.llm.common import uniform, written

#: Fixed texts: usual short notices of each family.
NOTICES = [
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0", "Released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0",
                    "you may not use this file except in compliance with the License. You may obtain a copy at http://www.apache.org/licenses/LICENSE-2.0"]),
    ("MIT", ["Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]),
    ("GPL-3.0", ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under GPLv3",
                 "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"]),
    ("GPL-2.0", ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under GPLv2",
                 "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2"]),
    ("LGPL", ["Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the LGPL"]),
    ("AGPL-3.0", ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL"]),
    ("BSD", ["Licensed under the BSD 3-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-2-Clause",
             "Redistribution and use in source and binary forms, with or without modification, are permitted"]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC0-1.0", ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright: CC0 1.0 Universal public domain dedication"]),
    ("unknown", ["All rights reserved", "See the LICENSE file for details", "Licensed under the terms of the accompanying agreement",
                 "This text is licensed under a custom licence", "Distributed under a proprietary license", "Copyright by the authors, use only with written permission"]),
]
#: Sampled documents for class `none`, lines drawn from each, variants of each notice, share of their words left out.
SAMPLE_DOCS, LINES_OF_DOC, VARIANTS, DROPPED = 300, 4, 16, 0.15
#: Lines that speak of licences are no examples of class `none`.
SPEAKS = r"(?i)licen[cs]e|copyright|rights reserved"


def line_words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def ngrams(words: str) -> Column:
    """Distinct runs of one to three words."""
    def runs(n):
        at = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def anchored(words: str, cues: list[str]) -> Column:
    """The n-grams that hold a cue: the only ones that can be features."""
    return F.filter(ngrams(words), lambda g: F.arrays_overlap(F.split(g, " "), F.array(*[F.lit(c) for c in cues])))


class LicenseModel:
    """Cues, weights (n-gram, one number for each class), intercepts, classes and a temperature."""

    def __init__(self, cues, weights, intercepts, classes, temperature):
        self.cues, self.weights, self.intercepts, self.classes, self.temperature = cues, weights, intercepts, classes, temperature


def train(docs: DataFrame, notices=None, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Fits on notices and at most LINES_OF_DOC lines of each of SAMPLE_DOCS documents, both drawn by hashes.

    Which words are cues rests on all lines of all documents: a word of the notices that over 1 % of them hold is none.
    """
    spark = docs.sparkSession
    notices = notices or NOTICES
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("text"))
    plain_lines = F.filter(F.split("text", "\n"), lambda t: ~t.rlike(SPEAKS) & t.rlike("[A-Za-z0-9]"))
    drawn = texts.orderBy(uniform("licences", "_id"), "_id", "text").limit(SAMPLE_DOCS)
    lines = drawn.select(F.explode(F.slice(F.array_sort(F.transform(plain_lines, lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), 1, LINES_OF_DOC)).alias("line"))
    plain = written(lines.select(line_words("line.t").alias("words")), "licence-lines")
    known = spark.createDataFrame([(f, t) for f, texts in notices for t in texts], "family string, text string").select("family", line_words("text").alias("words"))
    vocabulary = {r[0] for r in known.select(F.explode("words")).distinct().collect()}
    # One row for each word of the notices leaves a task; the empty word counts the lines.
    wanted = F.array(*[F.lit(w) for w in sorted(vocabulary)])
    held = texts.select(F.explode(plain_lines).alias("line")).select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(wanted, line_words("line")))).alias("w"))
    times = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    common = {w for w, n in times.items() if w and n > max(1, times[""] / 100)}
    cues = sorted(w for w in vocabulary - common if len(w) > 1)
    grams = sorted(r[0] for r in known.select(F.explode(anchored("words", cues))).distinct().collect())
    variant = F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))
    varied = known.withColumn("variant", variant).withColumn("seed", F.md5(F.concat_ws(" ", "words", "variant")))
    drop = lambda w, i: (F.col("variant") < 2) | (F.conv(F.substring(F.md5(F.concat(F.col("seed"), i.cast("string"))), 1, 6), 16, 10).cast("double") / 16 ** 6 >= DROPPED)
    varied = varied.withColumn("words", F.filter("words", drop))
    classes = [f for f, _ in notices] + ["none"]
    number = F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*[F.lit(float(k)) for k in range(len(classes))])), F.col("family"))
    rows = varied.select("family", "words", "variant").union(plain.select(F.lit("none"), "words", F.pmod(F.xxhash64("words"), F.lit(VARIANTS)).cast("int")))
    rows = written(rows.withColumn("label", number).withColumn("grams", ngrams("words")), "licence-rows").coalesce(2)
    vectors = CountVectorizerModel.from_vocabulary(grams, inputCol="grams", outputCol="features", minTF=1.0).setBinary(True).transform(rows)
    fitting, apart = vectors.where("variant % 4 <> 3"), vectors.where("variant % 4 = 3")
    fitted = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60, standardization=False).fit(fitting)
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().tolist()
    scored = [(r["rawPrediction"].toArray(), int(r["label"])) for r in fitted.transform(apart).select("rawPrediction", "label").collect()]  # a quarter of the rows above

    def loss(t):
        return sum(math.log(sum(math.exp((x - z[y]) / t) for x in z)) for z, y in scored)
    temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    weights = [(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(grams) if abs(matrix[:, k]).max() > 0]
    return LicenseModel(cues, weights, intercepts, classes, temperature)


def scan(docs: DataFrame, model: LicenseModel, notices=None, least: float = 0.5, similar: float = 0.6, covered: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed, line): one row for each paragraph that states a licence.

    Paragraphs are lines, counted from 0, and runs of adjacent lines that all hold a cue, as a
    wrapped notice does.  `family` is the likeliest class if its calibrated probability is `least`
    or more; a paragraph likelier to state some licence than none, but none of the families so
    surely, is `unknown`.  `similarity` is the largest share of a notice's words that the paragraph
    holds, over the family's notices (0 for unknown); a family is `confirmed` from `similar` on.
    A run counts only if it is confirmed by a notice that holds `covered` of the run's words, and
    none of its lines is confirmed alone; it then stands for its lines, under its first line's
    number, with its lines joined by a space.  Null and empty texts have no paragraph that counts;
    null ids and repeated rows come as they are; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    notices = notices or NOTICES
    cues = F.array(*[F.lit(c) for c in model.cues])
    # One pass over all words; texts without a cue end here.
    cued = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.arrays_overlap(line_words("text"), cues))
    # Cued lines bear their number, others are blank; so blank lines part the runs.
    numbered = F.transform(F.split("text", "\n"), lambda t, i: F.when(F.arrays_overlap(line_words(t), cues), F.concat(i.cast("string"), F.lit("\x01"), t)).otherwise(""))
    runs = cued.select("doc_id", F.explode(F.split(F.array_join(numbered, "\n"), "\n\n+")).alias("run")).select("doc_id", F.filter(F.split("run", "\n"), lambda t: t != "").alias("run"))
    runs = runs.where(F.size("run") > 0).withColumn("first", F.substring_index(F.get("run", F.lit(0)), "\x01", 1).cast("int"))
    runs = runs.withColumn("run", F.transform("run", lambda t: F.regexp_replace(t, "^[0-9]+\x01", ""))).withColumn("run_id", F.monotonically_increasing_id())
    whole = F.when(F.size("run") > 1, F.array(F.struct(F.col("first").alias("paragraph"), F.array_join("run", " ").alias("line"), F.lit(True).alias("whole")))) \
        .otherwise(F.array().cast("array<struct<paragraph:int,line:string,whole:boolean>>"))
    single = F.transform("run", lambda t, i: F.struct((F.col("first") + i).alias("paragraph"), t.alias("line"), F.lit(False).alias("whole")))
    lines = written(runs.select("doc_id", "run_id", F.explode(F.concat(single, whole)).alias("part")).select("doc_id", "run_id", "part.*"), "licence-paragraphs")
    # Equal paragraphs are judged once.
    grams = lines.select("line").distinct().withColumn("words", line_words("line")).select("line", F.explode(anchored("words", model.cues)).alias("gram"))
    n = len(model.classes)
    table = spark.createDataFrame(model.weights, "gram string, w array<double>")  # as many rows as the notices have n-grams
    sums = [F.sum(F.coalesce(F.col("w")[k], F.lit(0.0))).alias(f"s{k}") for k in range(n)]
    scores = grams.join(F.broadcast(table), "gram", "left").groupBy("line").agg(*sums)
    logits = F.array(*[(F.col(f"s{k}") + F.lit(model.intercepts[k])) / F.lit(model.temperature) for k in range(n)])
    judged = scores.withColumn("z", logits).withColumn("top", F.array_max("z"))
    judged = judged.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top")))).withColumn("all", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    judged = judged.select("line", F.transform("e", lambda x: x / F.col("all")).alias("p"))
    names = F.array(*[F.lit(c) for c in model.classes])
    families = F.slice("p", 1, n - 2)
    best = F.array_max(families)
    judged = judged.withColumn("best", best).withColumn("none", F.col("p")[n - 1])
    judged = judged.where("none < 0.5").select(
        "line", F.when(F.col("best") >= least, F.element_at(names, F.array_position(families, F.col("best")).cast("int"))).otherwise("unknown").alias("family"),
        F.when(F.col("best") >= least, F.col("best")).otherwise(1 - F.col("none")).alias("probability"))
    known = spark.createDataFrame([(f, t) for f, texts in notices for t in texts if f != "unknown"], "family string, notice string").select(
        "family", F.array_distinct(line_words("notice")).alias("notice"))
    shared = F.size(F.array_intersect("notice", line_words("line")))
    likeness, cover = shared / F.size("notice"), shared / F.size(F.array_distinct(line_words("line")))
    compared = judged.join(F.broadcast(known), "family", "left").groupBy("line", "family", "probability").agg(
        F.coalesce(F.max(likeness), F.lit(0.0)).alias("similarity"), F.coalesce(F.max(F.when(likeness >= similar, cover)), F.lit(0.0)).alias("cover"))
    compared = written(compared, "licence-verdicts")
    sure = (F.col("family") != "unknown") & (F.col("similarity") >= similar)
    found = written(lines.join(compared, "line").withColumn("confirmed", sure), "licence-found")
    states = found.groupBy("run_id").agg(F.max(F.col("whole") & F.col("confirmed") & (F.col("cover") >= covered)).alias("by_run"), F.max(~F.col("whole") & F.col("confirmed")).alias("by_line"))
    merged = states.where("by_run and not by_line").select("run_id", F.lit(True).alias("merged"))
    return found.join(merged, "run_id", "left").where(F.col("whole") == F.coalesce("merged", F.lit(False))).select(
        "doc_id", "paragraph", "family", "probability", "similarity", "confirmed", "line")

"""Licence families of paragraphs by a trained classifier.

A paragraph is a line of a document; its features are the distinct word 1-grams and 2-grams that the templates use and ordinary text
rarely does.  A sparse multinomial logistic regression (L1) learns the families from the templates, from shortened variants of them, and from
a bounded sample of different ordinary paragraphs (``NEGATIVES``; the only sample).  Its probabilities are calibrated on variants that training did not
see: a paragraph that is licence-like but below the calibrated probability of every family is ``unknown``.  A predicted family counts
only if the paragraph matches one of its templates; else it is ``unknown`` too.

Scoring is sparse: a paragraph without any of the words that the weighted n-grams need has no feature and leaves at once; n-grams of the
others meet the few hundred weighted ones in a broadcast join.
DataFrame and ML operations in the JVM only; the model that reaches the driver has vocabulary x families numbers.

Defined results: a null or empty text has no paragraphs; repeated rows get equal results; a null id is kept; an empty table trains on
templates alone and gives an empty result; extra columns are ignored; equal probabilities go to the first family.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcheck.llm.common import written

WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
NEGATIVES = 2000  # ordinary paragraphs for training
COMMON_SHARE = 0.02  # n-grams in more of them are no feature
NONE, UNKNOWN = "none", "unknown"
LIKE = 0.5  # probability of any licence from which a paragraph is licence-like
PRECISION = 0.98  # of the calibrated probability
CONFIRM = 0.6  # shared n-grams, of the shorter of paragraph and template
CUES = r"(?i)licen[cs]e|copyright|warrant|permission|redistribut|spdx|public domain|rights reserved"

# Wording of licence notices by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal, and dedicated it to the public domain."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.", "Copyright. All rights reserved."],
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams(w: Column) -> Column:
    """Distinct 1-grams and 2-grams."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, pairs))


def json_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from values the driver holds, as one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def template_rows(spark: SparkSession) -> DataFrame:
    """family, template and the words of every template."""
    rows = [{"family": f, "template": i, "body": t} for f, ts in sorted(TEMPLATES.items()) for i, t in enumerate(ts)]
    return json_rows(spark, rows, "family string, template int, body string").withColumn("w", words(F.col("body")))


def variants(templates: DataFrame) -> DataFrame:
    """Templates, their first and last parts, and templates without every k-th word; some of the latter are for calibration."""
    kinds = [("whole", 0, 0), ("first", 0, 0), ("last", 0, 0)] + [("without", k, r) for k in (5, 4, 3) for r in range(k)]
    kind = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(k).alias("k"), F.lit(r).alias("r")) for a, k, r in kinds])).alias("v")
    n = F.size("w")

    def stays(_: Column, i: Column) -> Column:
        part = F.when(F.col("v.a") == "first", 5 * i < 3 * n).when(F.col("v.a") == "last", 5 * i >= 2 * n)
        return part.when(F.col("v.a") == "without", i % F.col("v.k") != F.col("v.r")).otherwise(True)

    left = templates.select("family", "w", kind).withColumn("w", F.filter("w", stays))
    return left.filter(F.size("w") > 1).select("family", "w", ((F.col("v.a") == "without") & (F.col("v.r") % 3 == 2)).alias("held"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(key, para, line) of lines with text."""
    return docs.select("key", F.posexplode(F.split("body", "\n")).alias("para", "line")).filter(F.col("line").rlike("[A-Za-z]"))


def ordinary(docs: DataFrame) -> DataFrame:
    """A bounded sample of different paragraphs without a licence cue: those of the smallest hashes.  Hashes are told apart first, so only sampled lines move."""
    lines = paragraphs(docs).select("line", F.xxhash64("line").alias("h"))
    plain = ~F.col("line").rlike(CUES)
    last = lines.filter(plain).select("h").distinct().orderBy("h").limit(NEGATIVES).agg(F.max("h")).first()[0]
    sample = lines.filter(F.col("h") <= F.lit(last)).filter(plain).distinct().orderBy("h", "line").limit(NEGATIVES)
    return sample.select(F.lit(NONE).alias("family"), words(F.col("line")).alias("w"), (F.col("h") % 3 == 0).alias("held"))


def fit(docs: DataFrame) -> tuple[DataFrame, list[str], list[float], float, list[str]]:
    """(gram, id, w) with a weight for each family, the families, their intercepts, the calibrated probability, and the gate:
    of every weighted n-gram its rarest word in ordinary paragraphs, so that a paragraph without any of them has no feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark = docs.sparkSession
    positive, negative = variants(template_rows(spark)), written(ordinary(docs), "licence-negatives")
    many = max(1, COMMON_SHARE * negative.count())
    common = negative.select(F.explode(grams(F.col("w"))).alias("gram")).groupBy("gram").count().filter(F.col("count") > many).select("gram")
    used = template_rows(spark).select(F.explode(grams(F.col("w"))).alias("gram")).distinct().join(common, "gram", "left_anti")
    vocabulary = sorted(r["gram"] for r in used.collect())  # n-grams of the templates at most
    names = sorted(TEMPLATES) + [NONE]
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("double") - 1
    rows = positive.unionByName(negative).select("family", grams(F.col("w")).alias("grams"), label.alias("label"), "held")
    rows = written(rows.withColumn("weight", F.when(F.col("family") == NONE, 0.5).otherwise(1.0)), "licence-training")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", binary=True)
    data = vectors.transform(rows)
    model = LogisticRegression(maxIter=60, regParam=0.0005, elasticNetParam=1.0, family="multinomial", weightCol="weight", standardization=False).fit(data.filter("not held"))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    names = names[: len(bias)]
    table = [
        {"gram": g, "id": i, "w": [round(float(x), 6) for x in matrix[:, i]]} for i, g in enumerate(vocabulary) if abs(matrix[:, i]).max() > 1e-6
    ]
    weights = json_rows(spark, table, "gram string, id int, w array<double>")
    parts = sorted({w for r in table for w in r["gram"].split(" ")})
    seen = negative.select(F.explode(F.array_distinct("w")).alias("word")).filter(F.col("word").isin(parts)).groupBy("word").count()
    often = {r["word"]: r["count"] for r in seen.collect()}  # words of the weighted n-grams at most
    gate = sorted({min(r["gram"].split(" "), key=lambda w: (often.get(w, 0), w)) for r in table})
    return weights, names, [round(float(b), 6) for b in bias], calibrated(model, data, names), gate


def calibrated(model, data: DataFrame, names: list[str]) -> float:
    """The least probability at which held-out predictions of a family are right often enough."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array(F.col("probability"))
    scored = model.transform(data.filter("held")).select(F.array_max(p).alias("p"), (F.col("prediction") == F.col("label")).alias("right"), "prediction")
    steps = F.explode(F.array(*[F.lit(k / 20) for k in range(8, 20)])).alias("least")
    said = scored.filter(F.col("prediction") < len(names) - 1).select("*", steps).filter("p >= least")
    good = said.groupBy("least").agg(F.avg(F.col("right").cast("double")).alias("share")).filter(F.col("share") >= PRECISION).agg(F.min("least").alias("least"))
    return float(good.first()["least"] or 0.95)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_paragraphs, n_licensed, n_unknown, families (sorted, comma-joined), found.

    ``found`` holds (para, family, probability, match) of every licence-like paragraph.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    source = source.withColumn("key", F.xxhash64(F.col("id").cast("string"), "body"))
    weights, names, bias, least, gate = fit(source)
    weights = written(weights, "licence-weights")

    # Sparse scoring; sets, so that repeated rows (one key) add nothing.
    lines = paragraphs(source).select("key", "para", words(F.col("line")).alias("words"))
    open_lines = lines.filter(F.arrays_overlap("words", F.array(*map(F.lit, gate)))) if gate else lines.limit(0)
    each = open_lines.select("key", "para", grams(F.col("words")).alias("g")).select("key", "para", F.size("g").alias("n"), F.explode("g").alias("gram"))
    hits = each.join(F.broadcast(weights), "gram").groupBy("key", "para").agg(F.max("n").alias("n"), F.collect_set(F.struct("id", "w")).alias("hits"))
    zero = F.array(*map(F.lit, bias))
    logits = F.aggregate(F.array_sort("hits"), zero, lambda s, h: F.zip_with(s, h["w"], lambda a, b: a + b))
    scored = hits.withColumn("p", softmax(logits)).filter(F.element_at("p", len(names)) <= 1 - LIKE)
    family_p = F.slice("p", 1, len(names) - 1)
    best = scored.withColumn("probability", F.array_max(family_p)).withColumn("guess", F.element_at(F.array(*map(F.lit, names)), F.array_position(family_p, F.array_max(family_p)).cast("int")))

    # Template comparison of what is left: shared n-grams of paragraph and template.
    grams_of = template_rows(docs.sparkSession).select("family", "template", F.explode(grams(F.col("w"))).alias("gram")).join(F.broadcast(weights.select("gram", "id")), "gram")
    template = grams_of.groupBy("family", "template").agg(F.collect_set("id").alias("ids")).groupBy("family").agg(F.collect_list("ids").alias("templates"))
    met = best.join(F.broadcast(template), F.col("guess") == F.col("family"), "left").withColumn("ids", F.transform("hits", lambda h: h["id"]))
    share = lambda t: F.size(F.array_intersect(t, F.col("ids"))) / F.least(F.size(t), F.col("n"))
    match = F.coalesce(F.array_max(F.transform("templates", share)), F.lit(0.0))
    sure = (F.col("probability") >= least) & (match >= CONFIRM)
    judged = met.select("key", F.struct("para", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"), F.round(match, 6).alias("match")).alias("f"))
    per_doc = judged.groupBy("key").agg(F.array_sort(F.collect_list("f")).alias("found")).withColumnRenamed("key", "_key")

    joined = source.withColumn("n_paragraphs", F.size(F.filter(F.split("body", "\n"), lambda x: x.rlike("[A-Za-z]")))).drop("body").join(per_doc, F.col("key") == F.col("_key"), "left")
    found = F.coalesce("found", F.array())
    named = F.filter(found, lambda f: f["family"] != UNKNOWN)
    return joined.select(
        F.col("id").alias(id_col),
        F.greatest(F.coalesce("n_paragraphs", F.lit(0)), F.lit(0)).cast("bigint").alias("n_paragraphs"),
        F.size(named).cast("bigint").alias("n_licensed"),
        (F.size(found) - F.size(named)).cast("bigint").alias("n_unknown"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(named, lambda f: f["family"])))).alias("families"),
        found.alias("found"),
    )

"""Licence scans: which licence family a paragraph names, by a trained sparse classifier that a template must confirm.

A multinomial logistic regression with an L1 penalty over word uni- and bigrams is trained on windows cut from licence
notices, against ordinary paragraphs of the corpus. Few n-grams keep a weight, so scoring a paragraph is a set test and a
sum in Spark expressions. A paragraph whose likeliest family is above a cut set on held-out windows, and which shares
enough bigrams with a notice of that family, is ``confirmed``; one that fails either test, but is a licence
of some family with probability LIKELY and holds FEWEST weighted n-grams, is of family ``unknown``.

Defined results: paragraphs are lines; null, empty and blank texts have none that count; a paragraph with no weighted
n-gram is no licence; every such paragraph of every row is reported, also of repeated rows; an empty table is scored
by a model without ordinary paragraphs and gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import materialize

NONE, UNKNOWN = "none", "unknown"
#: Documents, first by hash of the id, whose paragraphs are the ordinary class.
SAMPLE_DOCS = 200
#: Words of the windows cut from notices, and the step between them.
WINDOWS = (6, 10, 18, 30)
STEP = 2
#: Share of common bigrams (of the smaller set) from which a notice confirms.
CONFIRMS = 0.5
#: For the unknown family: probability of all families together, and weighted n-grams.
LIKELY, FEWEST = 0.9, 3
#: A word in at least this share of the ordinary paragraphs names no licence by itself.
COMMON = 0.002
#: Held-out windows above the cut are wrong at most this often.
WRONG = 0.01

#: How public licences are named and how their notices begin.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
        "This project is available under the Apache 2.0 license. SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license. SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
        "Released under the GPL version 2. SPDX-License-Identifier: GPL-3.0-or-later",
        "This library is free software under the GNU Lesser General Public License, version 2.1.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License. SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0. SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0, for noncommercial use only.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is available under a Creative Commons Attribution-ShareAlike 3.0 License. CC BY-SA 3.0.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "reserved": (
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written "
        "permission of the publisher.",
    ),
}
FAMILIES = tuple(NOTICES)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")


def grams(text: Column) -> Column:
    """Distinct lower-case words and pairs of neighbours."""
    w = tokens(text)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))))


def paragraphs(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line: ``keep``, paragraph (line number from 0), line."""
    return docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph", "line"))


def windows() -> list[tuple[str, str]]:
    """(text, family): every notice whole, and windows of its words."""
    out = []
    for family, notices in NOTICES.items():
        for notice in notices:
            words = notice.split()
            out += [(notice, family)] * 6
            for size in WINDOWS:
                out += [(" ".join(words[at : at + size]), family) for at in range(0, len(words) - size + 1, STEP)]
    return out


@dataclass(frozen=True)
class Model:
    """``weights``: n-gram to one weight per class, in the order of ``classes``."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    cut: float
    anchors: tuple[str, ...]


def overlap(g: Column, family: str) -> Column:
    """Greatest share of bigrams in common with a notice of the family, of the smaller of both sets."""
    pairs = F.filter(g, lambda x: F.contains(x, F.lit(" ")))
    shares = []
    for notice in NOTICES[family]:
        own = F.filter(grams(F.lit(notice)), lambda x: F.contains(x, F.lit(" ")))
        shares.append(F.size(F.array_intersect(pairs, own)) / F.greatest(F.lit(1), F.least(F.size(pairs), F.size(own))))
    return F.greatest(*shares, F.lit(0.0)) if len(shares) > 1 else shares[0]


def _any_overlap(g: Column) -> Column:
    return F.greatest(*[overlap(g, f) for f in FAMILIES])


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", penalty: float = 0.0002) -> Model:
    """Fits on windows of notices and on paragraphs of SAMPLE_DOCS documents that share little with any notice.

    Features are the n-grams of notices that hold a word that is rare in ordinary paragraphs (in under COMMON of them). A
    quarter of the rows is held out to set the cut: the least probability above which at most WRONG of the held-out
    predictions are wrong, between 0.5 and 0.95.
    """
    spark: SparkSession = docs.sparkSession
    few = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_DOCS)
    plain = materialize(paragraphs(few, "t").select(F.col("line").alias("text"), grams(F.col("line")).alias("g")), "lines")
    plain = plain.where(F.size("g") > 0).where(_any_overlap(F.col("g")) < CONFIRMS).select("text", F.lit(NONE).alias("family"), "g")
    cut = spark.createDataFrame(windows(), "text string, family string").withColumn("g", grams(F.col("text")))
    classes = (*FAMILIES, NONE)
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    rows = cut.unionByName(plain).withColumn("label", number.cast("double"))
    rows = materialize(rows.withColumn("held", F.pmod(F.xxhash64("text", "family"), F.lit(4)) == 0).coalesce(4), "windows")
    licence, ordinary = rows.where(F.col("family") != NONE), rows.where(F.col("family") == NONE)
    least = COMMON * ordinary.count()
    seen = ordinary.select(F.explode("g").alias("x")).where(~F.contains("x", F.lit(" "))).groupBy("x").count()
    common = {r.x for r in seen.where(F.col("count") >= max(1.0, least)).collect()}  # bounded by the sample
    offered = {r.x for r in licence.select(F.explode("g").alias("x")).groupBy("x").count().where("count > 1").collect()}
    vocabulary = sorted(x for x in offered if not common.issuperset(x.split()))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="features").setBinary(True)
    fitted = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=1.0, maxIter=80, standardization=False)
    model = fitted.fit(counter.transform(rows.where(~F.col("held"))))
    classes = classes[: model.numClasses]  # the last is missing when there are no ordinary paragraphs
    table = model.coefficientMatrix.toArray()
    weights = {g: tuple(map(float, table[:, i])) for i, g in enumerate(vocabulary) if abs(table[:, i]).max() > 1e-6}
    anchors = {w for g in weights for w in g.split()} - common
    found = Model(classes, weights, tuple(map(float, model.interceptVector.toArray())), 0.5, tuple(sorted(anchors)))
    tried = rows.where("held").select("label", probabilities(logits(F.col("g"), found)).alias("p"))
    tried = tried.select("label", F.array_max("p").alias("top"), (F.array_position("p", F.array_max("p")) - 1).alias("best"))
    tried = tried.select("top", (F.col("best") != F.col("label")).cast("int").alias("wrong"))
    results = sorted(((r.top, r.wrong) for r in tried.collect()), reverse=True)  # bounded by the sample
    cut_at, wrong = 0.95, 0
    for n, (top, bad) in enumerate(results, 1):
        wrong += bad
        if wrong <= WRONG * n:
            cut_at = top
    return replace(found, cut=min(0.95, max(0.5, cut_at)))


def logits(g: Column, model: Model) -> Column:
    """Unnormalised log-probability of each class from an array of n-grams."""
    names = [*model.weights]
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.array(*map(F.lit, model.weights[x])) for x in names]))
    hits = F.filter(g, lambda x: x.isin(names))
    start = F.array(*map(F.lit, model.bias))
    return F.aggregate(hits, start, lambda acc, x: F.zip_with(acc, F.element_at(table, x), lambda a, b: a + b))


def probabilities(z: Column) -> Column:
    parts = F.transform(z, lambda x: F.exp(x))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def scan(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Licence paragraphs: doc_id, paragraph, family, likeliest, probability, overlap, confirmed, line.

    Every weighted n-gram holds an anchor word, so lines without one are no licences and are passed over.
    """
    lines = paragraphs(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), "t", "doc_id")
    lines = lines.where(F.exists(F.split(F.lower("line"), r"[^a-z0-9]+"), lambda x: x.isin(list(model.anchors))))
    scored = lines.withColumn("z", logits(grams(F.col("line")), model))
    if NONE in model.classes:  # all families together can only be likelier than none if one is within ln of their number
        near = F.log(F.lit(len(FAMILIES) + 0.5))
        scored = scored.where(F.array_max(F.slice("z", 1, len(FAMILIES))) >= F.element_at("z", len(model.classes)) - near)
    scored = materialize(scored, "candidates").withColumn("g", grams(F.col("line"))).withColumn("p", probabilities(F.col("z")))
    scored = scored.where(F.exists("g", lambda x: x.isin([*model.weights])))
    licence = 1 - F.element_at("p", len(model.classes)) if NONE in model.classes else F.lit(1.0)
    scored = scored.withColumn("licence", licence).where(F.col("licence") > 0.5)
    families = F.slice("p", 1, len(FAMILIES))
    scored = scored.withColumn("probability", F.array_max(families))
    best = F.array_position(families, F.col("probability"))
    scored = scored.withColumn("likeliest", F.element_at(F.array(*map(F.lit, FAMILIES)), best.cast("int")))
    share = F.lit(0.0)
    for f in FAMILIES:
        share = F.when(F.col("likeliest") == f, overlap(F.col("g"), f)).otherwise(share)
    scored = scored.withColumn("overlap", share)
    sure = (F.col("probability") >= model.cut) & (F.col("overlap") >= CONFIRMS)
    hits = F.size(F.filter("g", lambda x: x.isin([*model.weights])))
    scored = scored.where(sure | (F.col("licence") >= LIKELY) & (hits >= FEWEST))
    family = F.when(sure, F.col("likeliest")).otherwise(F.lit(UNKNOWN))
    return scored.select("doc_id", "paragraph", family.alias("family"), "likeliest", "probability", "overlap", sure.alias("confirmed"), "line")

"""Licence scan: a trained paragraph classifier, confirmed by comparison with licence texts. DataFrame and Spark ML only."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.session import stage_table

# Sentences of public licences and of their usual notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "This software is released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved.", "Copyright by the authors. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."],
}
FAMILIES = ["none", *TEMPLATES]


def grams(text: Column) -> Column:
    """Distinct words and word pairs in lower case; words are runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # bound as a lambda's variable, so that the text is split once
    both = F.transform(F.array(words), lambda w: F.array_distinct(F.concat(w, F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)))))
    return F.element_at(both, 1)


def _grams(text: str) -> list[str]:
    """The same of a licence sentence."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(words + [" ".join(x) for x in zip(words, words[1:])]))


def paragraphs(docs: DataFrame, *columns: str) -> DataFrame:
    """A row per paragraph (U+000A ends one) with a letter or digit."""
    rows = docs.where("text is not null").select(*columns, F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
    return rows.where(F.col("body").rlike(r"[\p{L}\p{N}]"))


@dataclass
class Classifier:
    """A fitted model, its temperature, and the probability from which a family is named."""

    model: LogisticRegressionModel
    features: int
    temperature: float
    threshold: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (with ``grams``) of which some family is likelier than none, with ``probability`` of a licence of any family, ``family`` (the likeliest) and its ``family_probability``."""
        hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=self.features, binary=True).transform(rows)
        scored = self.model.transform(hashed).where("prediction <> 0").withColumn("raw", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction")
        scored = scored.withColumn("raw", F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / self.temperature)))
        total = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x)
        best = F.array_max(F.slice("raw", 2, len(FAMILIES)))
        family = F.element_at(F.array(*map(F.lit, FAMILIES[1:])), F.array_position(F.slice("raw", 2, len(FAMILIES)), best).cast("int"))
        return scored.select("*", (1 - F.element_at("raw", 1) / total).alias("probability"), family.alias("family"), (best / total).alias("family_probability")).drop("raw")


def _positives(seed: int, copies: int) -> list[tuple[str, str]]:
    """Every licence sentence, whole and in parts of at least five words, in several cases."""
    r, out = random.Random(seed), []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            out += [(family, text)] * 4 + [(family, text.upper())]
            for _ in range(copies):
                n = r.randint(min(5, len(words)), len(words))
                a = r.randint(0, len(words) - n)
                # short notices are known by all their words
                out.append((family, " ".join(words[a : a + n] if len(words) > 12 else words)))
    return out


def _containment(own: Column, other: Column) -> Column:
    """Share of the smaller set of n-grams that is common."""
    return F.size(F.array_intersect(own, other)) / F.greatest(F.least(F.size(own), F.size(other)), F.lit(1))


def _templates(spark: SparkSession) -> DataFrame:
    """A row per family with its sentences and their n-grams."""
    rows = [(family, [(f"{family}/{i}", _grams(text)) for i, text in enumerate(texts)]) for family, texts in TEMPLATES.items()]
    return spark.createDataFrame(rows, "family string, templates array<struct<template: string, grams: array<string>>>")


def fit(docs: DataFrame, sample: int = 4000, copies: int = 8, features: int = 1 << 15, seed: int = 5, precision: float = 0.995) -> Classifier:
    """Train on licence sentences and on a bounded sample of the corpus.

    ``sample``: paragraphs with the least hashes, which bounds the training table whatever the size of the corpus. Half of them
    are examples of none (unless they contain most of a licence sentence), the others get a licence sentence in front or behind and
    are examples of its family, so that a notice inside a paragraph is learnt too. A fifth of all examples is held out: on those the temperature is
    the one of least log loss, and the threshold the least probability from which ``precision`` of the named families are right.
    """
    spark = docs.sparkSession
    listed = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    everything = F.array(*[F.lit(g) for g in sorted({g for _, t in listed for g in _grams(t)})])
    drawn = paragraphs(docs.select("text")).select("body", F.xxhash64(F.lit(seed), "body").alias("u"))
    last = drawn.select("u").distinct().orderBy("u").limit(sample).agg(F.max("u")).first()[0]
    drawn = drawn.where(F.col("u") <= F.lit(last)).distinct()
    drawn = drawn.withColumn("own", grams(F.col("body"))).where(_containment(F.col("own"), everything) < 0.5).drop("own")
    # at most sample rows; stored, as the corpus would be split again by each use
    drawn = stage_table(drawn, "licence-sample")
    pick = F.element_at(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in listed]), (F.pmod("u", F.lit(len(listed))) + 1).cast("int"))
    odd = F.pmod(F.shiftright("u", 20), F.lit(2)) == 1
    front = F.pmod(F.shiftright("u", 21), F.lit(2)) == 1
    none = drawn.where(~odd).select(F.lit("none").alias("family"), "body", "u")
    mixed = drawn.where(odd).withColumn("t", pick).select("t.family", F.when(front, F.concat_ws(" ", "t.text", "body")).otherwise(F.concat_ws(" ", "body", "t.text")).alias("body"), "u")
    plain = spark.createDataFrame(_positives(seed, copies), "family string, body string").withColumn("u", F.xxhash64(F.lit(seed), "body"))
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    rows = stage_table(none.union(mixed).union(plain).select("family", "body", "u", label.alias("label"), grams(F.col("body")).alias("grams")).orderBy("u", "body").coalesce(1), "licence-examples")
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True).transform(rows)
    held = F.pmod(F.shiftright("u", 24), F.lit(5)) == 0
    # the sentences themselves are always learnt; every family has a row among them
    learnt = hashed.where(~held | F.col("body").isin([t for _, t in listed])).cache()
    model = LogisticRegression(regParam=0.001, elasticNetParam=0.5, maxIter=40, family="multinomial").fit(learnt)
    learnt.unpersist()
    tested = model.transform(hashed.where(held)).select("label", vector_to_array("rawPrediction").alias("raw")).collect()  # at most a fifth of sample + positives
    temperature, threshold = calibrate([(int(r["label"]), list(r["raw"])) for r in tested], precision)
    return Classifier(model, features, temperature, threshold)


def calibrate(tested: list[tuple[int, list[float]]], precision: float) -> tuple[float, float]:
    """Temperature of least log loss, and the least threshold at which the families that it names are right often enough."""

    def softmax(raw: list[float], t: float) -> list[float]:
        top = max(raw)
        e = [math.exp((x - top) / t) for x in raw]
        return [x / sum(e) for x in e]

    if not tested:
        return 1.0, 0.5
    grid = [0.25 * 1.2**k for k in range(20)]
    temperature = min(grid, key=lambda t: -sum(math.log(max(softmax(raw, t)[y], 1e-300)) for y, raw in tested))
    named = sorted(((max(p[1:]), p.index(max(p[1:]), 1) == y) for y, p in ((y, softmax(raw, temperature)) for y, raw in tested)), reverse=True)
    threshold, right = 1.0, 0
    for i, (p, ok) in enumerate(named, 1):
        right += ok
        if right >= precision * i:
            threshold = p
    return temperature, max(0.5, threshold)


def scan(docs: DataFrame, classifier: Classifier | None = None, similarity: float = 0.6) -> DataFrame:
    """Every paragraph that reads like a licence: ``doc_id``, ``paragraph``, ``family``, ``probability``, ``template``, ``similarity``, ``body``.

    All paragraphs of all texts are classified. A paragraph is reported if some family is likelier than none. Its
    family is the likeliest one if the calibrated probability reaches the classifier's threshold and at least ``similarity`` of the
    n-grams of the paragraph or of one of the family's sentences are common; else the family is ``unknown``.

    A notice that is wrapped over several lines is reported by those of its lines that read like a licence on their own.

    Null text: no paragraphs. Null ``doc_id``: kept. Repeated rows: reported each. Other columns are not read. An empty
    table gives no rows.
    """
    classifier = classifier or fit(docs)
    rows = paragraphs(docs.select("doc_id", "text"), "doc_id").withColumn("grams", grams(F.col("body")))
    found = classifier.score(rows)
    near = F.transform("templates", lambda t: F.struct(_containment(F.col("grams"), t["grams"]).alias("similarity"), t["template"].alias("template")))
    found = found.join(F.broadcast(_templates(docs.sparkSession)), "family", "left").withColumn("near", F.array_max(near))
    sure = (F.col("family_probability") >= classifier.threshold) & (F.col("near.similarity") >= similarity)
    return found.select("doc_id", "paragraph", F.when(sure, F.col("family")).otherwise("unknown").alias("family"), "probability", F.col("near.template").alias("template"), F.col("near.similarity").alias("similarity"), "body")

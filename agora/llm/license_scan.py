"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is a non-blank line; its sentences, and their parts between "and" and
"or", are looked at as well, so that a line may name several licences. Sparse word n-grams (1 and 2, of the templates'
vocabulary without stop words) feed a multinomial logistic regression over
licence families and an unknown class. It is trained on varied copies of the
templates, on sentences that use licence words without granting one, and on a
bounded sample of corpus paragraphs; its probabilities are calibrated by a
temperature on a fold that training doesn't see. A predicted family must then be
confirmed by comparison with that family's templates, stop words left out.

A paragraph without a single n-gram of the vocabulary has the intercept's score,
which is the unknown class; such paragraphs are passed over without scoring.
DataFrame functions and JVM-side ``pyspark.ml`` only.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.session import write_shared

UNKNOWN = "unknown"
#: Corpus paragraphs in training, and varied copies of each fixed paragraph.
SAMPLE, COPIES = 2_000, 24
#: Least calibrated probability, and least share of shared bigrams: of a template's,
#: and of a piece's that is compared as a part of a template.
LEAST_PROBABILITY, LEAST_SHARE, LEAST_OWN = 0.5, 0.6, 0.8

# Licence notices as their publishers word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}
# Sentences that use the words of licences and grant none.
OTHER = [
    "He lost his driving license and had to apply for a new version at the office.",
    "The public library is open to any person free of charge.",
    "She asked for permission to use the source of the river.",
    "The restaurant was licensed to serve food and wine to the general public.",
    "All rights reserved by the author of the work.",
    "The software was released in its second version last year.",
    "A copy of the document was published without notice.",
    "The foundation is free to modify the terms of the grant at any time.",
    "The fishing license costs a small fee and is valid for one year.",
    "General conditions of use of this site may change without notice.",
    "The creative work of the commons committee was published in four volumes.",
    "The Apache people live in the southwest of the country.",
    "The program of the concert was distributed free of charge.",
    "The new version of the file was saved under another name.",
    "The university grants a license to teach after the final examination.",
    "The following conditions were met before the school was permitted to open.",
    "Copyright 2019 by the publisher.",
    "The GNU is a large antelope of the public parks.",
    "The source code of the library was written in 1984.",
    "They redistribute food to the public without restriction.",
    "You should have received a copy of the programme along with this ticket.",
    "Permission is hereby granted to any person to park in the yard free of charge.",
    "You may obtain a copy of the license at the town hall.",
    "The license number of the car was noted along with its version.",
]
#: Lines that name a family by its identifier.
NAMED = ["SPDX-License-Identifier: {}", "License: {}"]


def words_of(paragraph: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; of one word, the word."""
    n = F.size(words)
    return F.when(n < 2, words).otherwise(F.array_distinct(F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b))))


def _stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def terms_of(words: Column) -> Column:
    """Distinct words and bigrams, stop words left out."""
    kept = F.array_except(words, F.array(*[F.lit(w) for w in _stop_words()]))
    several = F.filter(words, lambda w: ~w.isin(_stop_words()))
    return F.array_union(kept, _bigrams(several))


def _telling(words: Column) -> Column:
    """Bigrams of the words that aren't stop words."""
    return _bigrams(F.filter(words, lambda w: ~w.isin(_stop_words())))


def _units(paragraph: Column) -> Column:
    """The paragraph, its sentences, and their parts between "and" and "or"."""
    sentences = F.split(paragraph, r"(?<=[.;!?])\s+")
    parts = F.flatten(F.transform(sentences, lambda s: F.split(s, r"(?i),?\s+(?:and/or|and|or)\s+")))
    return F.array_distinct(F.concat(F.array(paragraph), sentences, parts))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, i, p) for f, ps in TEMPLATES.items() for i, p in enumerate([*ps, *(n.format(f) for n in NAMED)])]
    return spark.createDataFrame(rows, "family string, template int, paragraph string").coalesce(1)


def _varied(rows: DataFrame, copies: int) -> DataFrame:
    """Copies of each paragraph that lack up to a quarter of the words; the first
    copy is whole."""
    words = words_of(F.col("paragraph"))
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    out = rows.select("family", words.alias("all"), copy.alias("copy"))
    kept = F.transform("all", lambda w, i: F.when(
        F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(100)) >= F.col("copy") % 6 * 5, w))
    return out.select("family", "copy", F.filter(kept, lambda w: w.isNotNull()).alias("words"))


def _vectors(vocabulary: list[str]) -> CountVectorizerModel:
    made = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
    return made.setBinary(True)


class Model:
    """Vocabulary, regression, labels and temperature of a trained scan."""

    def __init__(self, vocabulary: list[str], regression: LogisticRegressionModel, labels: list[str],
                 temperature: float):
        self.words = sorted({t for t in vocabulary if " " not in t})
        self.vectors = _vectors(vocabulary)
        self.regression, self.labels, self.temperature = regression, labels, temperature

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``words``) plus ``raw``: the linear scores by label,
        written out so that each is computed once."""
        vec = self.vectors.transform(rows.withColumn("terms", terms_of(F.col("words"))))
        return write_shared(self.regression.transform(vec).withColumn("raw", vector_to_array("rawPrediction"))
                            .select(*rows.columns, "raw"), "scored")


def probabilities(raw: Column, temperature: float) -> Column:
    """Softmax of an array of scores at a temperature."""
    exps = F.transform(raw, lambda r: F.exp(r / temperature))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def _paragraphs(text: str) -> Column:
    """Array of (place, paragraph): non-blank lines with their line number."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                        lambda p, i: F.struct(i.alias("place"), p.alias("paragraph")))
    return F.filter(lines, lambda s: F.trim(s["paragraph"]) != "")


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE,
          copies: int = COPIES) -> Model:
    """Fit and calibrate. From the corpus come at most ``sample`` paragraphs: one,
    chosen by hash, of each of the documents with the smallest hash of their id
    and text. Those that share half of a template's bigrams are left out."""
    spark = documents.sparkSession
    templates = _templates(spark)
    vocabulary = [r[0] for r in templates.select(F.explode(terms_of(words_of(F.col("paragraph")))).alias("t"))
                  .distinct().orderBy("t").collect()]
    h = F.xxhash64(F.col(key), F.col(text))
    chosen = (documents.filter(F.col(text).isNotNull()).select(h.alias("h"), _paragraphs(text).alias("p"))
              .filter(F.size("p") > 0)
              .select("h", F.element_at("p", (F.pmod("h", F.size("p")) + 1).cast("int"))["paragraph"].alias("paragraph"))
              .orderBy("h").limit(sample))
    corpus = chosen.select(words_of(F.col("paragraph")).alias("words"))
    known = templates.select(_bigrams(words_of(F.col("paragraph"))).alias("b"))
    patterns = [r[0] for r in known.collect()]  # as many as there are templates
    like = None
    for b in patterns:
        t = F.array(*[F.lit(x) for x in b])
        one = F.size(F.array_intersect(_bigrams(F.col("words")), t)) * 2 >= len(b)
        like = one if like is None else like | one
    corpus = corpus.filter(~like).select(F.lit(UNKNOWN).alias("family"),
                                         F.pmod(F.xxhash64("words"), F.lit(copies)).cast("int").alias("copy"), "words")
    other = spark.createDataFrame([(UNKNOWN, p) for p in OTHER], "family string, paragraph string").coalesce(1)
    rows = _varied(templates.drop("template").unionByName(other), copies).unionByName(corpus)
    labels = [*TEMPLATES, UNKNOWN]
    label = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("family")) - 1
    rows = write_shared(rows.withColumn("label", label.cast("double")), "training")

    vectors = _vectors(vocabulary)
    fold = vectors.transform(rows.filter("copy % 4 <> 3").withColumn("terms", terms_of(F.col("words")))).select(
        "features", "label")
    regression = LogisticRegression(maxIter=60, regParam=1e-3, family="multinomial").fit(fold)
    model = Model(vocabulary, regression, labels, 1.0)
    held = model.scored(rows.filter("copy % 4 = 3"))
    grid = (0.5, 0.7, 1.0, 1.4, 2.0)
    own = [F.element_at(probabilities(F.col("raw"), t), (F.col("label") + 1).cast("int")) for t in grid]
    losses = held.agg(*[F.avg(-F.log(F.greatest(p, F.lit(1e-12)))) for p in own]).first()
    model.temperature = min((loss, t) for loss, t in zip(losses, grid))[1]
    return model


def scan(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, key, n_paragraphs`` of every document, and ``found``: an array of
    (place, family, probability, share) of its confirmed licence paragraphs.

    A family is predicted for a paragraph, a sentence or a part of one at a
    calibrated probability of ``LEAST_PROBABILITY`` or more, and confirmed if that
    and one of the family's templates have in common ``LEAST_SHARE`` of the
    template's bigrams, or ``LEAST_OWN`` of its own (at least four bigrams); a
    template of one bigram must be ``LEAST_SHARE`` of it. A place has
    each of its families once, with the highest probability and share. Null and
    empty texts have no paragraph; repeated rows each come out; other columns are
    ignored.
    """
    spark = documents.sparkSession
    vocabulary = F.array(*[F.lit(w) for w in model.words])
    paragraphs = _paragraphs(text)
    touched = F.filter(F.col("paragraphs"), lambda s: F.arrays_overlap(words_of(s["paragraph"]), vocabulary))
    docs = write_shared(
        documents.select(F.col(key).alias("key"), paragraphs.alias("paragraphs"))
        .select("key", F.size("paragraphs").cast("long").alias("n_paragraphs"), touched.alias("touched"))
        .withColumn("row", F.monotonically_increasing_id()), "paragraphs")
    units = docs.select("row", F.explode("touched").alias("t")).select(
        "row", "t.place", F.explode(_units(F.col("t.paragraph"))).alias("unit"))
    rows = units.select("row", "place", words_of(F.col("unit")).alias("words")).filter(
        F.arrays_overlap("words", vocabulary))
    best = F.array_max(F.zip_with(
        probabilities(F.col("raw"), model.temperature), F.array(*[F.lit(x) for x in model.labels]),
        lambda p, f: F.struct(p.alias("probability"), f.alias("family"))))
    predicted = (model.scored(rows).withColumn("best", best)
                 .filter((F.col("best.family") != UNKNOWN) & (F.col("best.probability") >= LEAST_PROBABILITY))
                 .select("row", "place", "best.family", "best.probability", _telling(F.col("words")).alias("bigrams")))
    # the templates are fixed values of this module: bounded
    patterns = F.broadcast(_templates(spark).select("family", _telling(words_of(F.col("paragraph"))).alias("template")))
    common = F.size(F.array_intersect("bigrams", "template"))
    of_own = common / F.greatest(F.size("bigrams"), F.lit(1))
    share = F.when(F.size("template") < 2, of_own).otherwise(F.greatest(
        common / F.size("template"), F.when((F.size("bigrams") >= 4) & (of_own >= LEAST_OWN), of_own).otherwise(0.0)))
    confirmed = (predicted.join(patterns, "family").withColumn("share", share).filter(F.col("share") >= LEAST_SHARE)
                 .groupBy("row", "place", "family").agg(F.max("probability").alias("probability"), F.max("share").alias("share")))
    found = confirmed.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("place", "family", "probability", "share"))).alias("found"))
    return (docs.select("row", "key", "n_paragraphs").join(found, "row", "left")
            .withColumn("found", F.coalesce("found", F.array().cast(
                "array<struct<place:int,family:string,probability:double,share:double>>")))
            .withColumnRenamed("key", key))

"""Licence scans: a paragraph classifier over sparse word n-grams, with template confirmation.

DataFrame functions and Spark ML only. Training paragraphs are the notices
below, cut and mixed with neutral text, against paragraphs of the corpus that
hold no cue word. Classes are the families, `unknown` (licence wording of no
family) and `none`. `unknown` is learnt from the families' own notices with
made-up names, which are no features, in place of the words that only one
family has. It is calibrated
by leaving whole families out of a fit: their notices must come out `unknown`,
while left-out notices of the other families must keep their names. Every
paragraph is judged: those without a word of triggers() are `none` by the
fitted weights, so they need no scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakelane.llm.common import written

#: Notices by family, as authors put them into texts and headers.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is available under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "MIT License",
        "Distributed under the MIT License.",
        "Veröffentlicht unter der MIT-Lizenz.",
        "Publicado bajo la licencia MIT.",
        "Publié sous licence MIT.",
        "Licencia MIT",
        "MIT-Lizenz",
        "Steht unter der MIT-Lizenz.",
        "Licence MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under Apache 2.0.",
        "Veröffentlicht unter der Apache-Lizenz 2.0.",
        "Steht unter der Apache-Lizenz 2.0.",
        "Publicado bajo la licencia Apache 2.0.",
        "Publié sous licence Apache 2.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under GPLv3.",
        "GPLv3",
        "Available under the GPL.",
        "Veröffentlicht unter der GPL.",
        "Publicado bajo la licencia GPL.",
        "Publié sous licence GPL.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Distributed under LGPLv3.",
        "LGPLv3",
        "Available under the LGPL.",
        "Veröffentlicht unter der LGPL.",
        "Publicado bajo la licencia LGPL.",
        "Publié sous licence LGPL.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Distributed under the BSD License.",
        "Veröffentlicht unter der BSD-Lizenz.",
        "BSD-Lizenz",
        "Publicado bajo la licencia BSD.",
        "Publié sous licence BSD.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Distributed under MPL 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Lizenziert unter CC BY 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Lizenziert unter CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Lizenziert unter CC BY-NC 4.0.",
    ],
    "public-domain": [
        "This work has been released into the public domain under CC0 1.0 Universal.",
        "Dedicated to the public domain.",
        "Released under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved. Unauthorized copying is prohibited.",
        "Confidential and proprietary. All rights reserved.",
        "Alle Rechte vorbehalten.",
        "Todos los derechos reservados.",
        "Tous droits réservés.",
    ],
}
#: Licence wording of no family above.
OTHER = [
    "Licensed under the terms of the Example Corporation license.",
    "Released under a custom license.",
    "This file is distributed under the license of the project.",
    "See the license file for the terms of use.",
    "Use of this material is subject to the license agreement.",
    "SPDX-License-Identifier: LicenseRef-Custom",
    "Licensed under the Example Public License, version 7.",
]
#: Made-up names that stand for a family's own words.
NAMES = ["acme", "quillon", "borealis", "wexford", "zanthor", "example", "frobnicate", "meridian"]
#: How licences are named; texts of `unknown`, with each of the first three names.
NAMED = [
    "{} License",
    "{} Public License",
    "The {} Software License, version 1.0",
    "{} License 2.0",
    "Covered by the {} license.",
    "{}-Lizenz",
    "Licencia {}",
    "Licence {}",
    "Subject to the {} licence",
]
#: Of a notice with names put in, at least this share is its own words, and one says that it is about a licence.
OWN_SHARE = 0.5
ABOUT = r"licen[cs]|lizenz|derechos|rechte|droits|rights|domain"
#: Parts of the families that are left out of one fit each.
FOLDS = 3
#: Texts with a cue word that state no licence.
PLAIN = [
    "The driver must show a valid driving license at the counter.",
    "A fishing licence costs ten pounds a year.",
    "The public domain of the kingdom was large.",
    "Apache helicopters flew over the city.",
    "He studied at MIT and copied the software of a friend.",
    "Her rights were reserved for a later hearing.",
    "The binary form of the number was redistributed.",
    "Permission was granted to enter the building.",
    "The source of the river is in the mountains.",
    "the and of to in is that it for with as on by this",
    "der die das und mit von zu in ist auf nach unter für als bei",
    "el la los de que y en bajo por para con un una se",
    "le la les de et en sous pour par avec des un une est",
    "Er kam mit dem Zug und mit dem Hund in die Stadt.",
    "Der Fahrer hat unter der Brücke die Lizenz verloren.",
    "La licencia de conducir caduca en mayo.",
    "Il faut une licence pour pêcher sous le pont.",
    "The book is available and was released and distributed under the old name.",
]
#: Lines with one of these are not taken from the corpus as negatives. No other use: every paragraph is judged.
CUES = r"licen[cs]|lizenz|gpl|\bcc0\b|apache|\bbsd\b|derechos reservados|rechte vorbehalten|droits réservés|rights reserved|copyright|public domain|creative commons|spdx|\bcc[ -]by\b|\bgnu\b|permission is hereby granted|redistribution and use"
NONE, UNKNOWN = "none", "unknown"
#: Bound of the negatives taken from the corpus, by smallest hash, and their length in words.
NEGATIVES = 400
NEGATIVE_WORDS = 24
NGRAMS = 3
#: Words of a window over the joined lines of a paragraph, and the step: any WINDOW - STEP words in a row lie in one.
WINDOW, STEP = 64, 32
#: Share of a template's word pairs that a paragraph must have to confirm its family.
CONFIRM = 0.6
#: Probability of a family under which a paragraph is `unknown`; raised by calibration.
LEAST_PROBABILITY = 0.5
#: By what `none` leads all other classes, at least, on a text without a known n-gram, in log odds; fits of few negatives fall short of it.
LEAST_LEAD = 0.5


def words(text: Column) -> Column:
    """Lower-case words; letters, digits, and points and hyphens between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*)"), 1)


def grams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of a word array."""
    count = F.size(tokens) - n + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))).otherwise(F.array().cast("array<string>"))


def phrases(tokens: Column) -> Column:
    """Word pairs of a template, or its only word."""
    return F.when(F.size(tokens) == 1, tokens).otherwise(grams(tokens, 2))


def features(tokens: Column) -> Column:
    return F.concat(*(grams(tokens, n) for n in range(1, NGRAMS + 1)))


def triggers(vocabulary: list[str], weights: np.ndarray, intercepts: np.ndarray, none: int, common: list[str]) -> list[str] | None:
    """Words without any of which a paragraph is surely `none`; None if there are no such words.

    A class beats `none` by its intercept and the weights of the paragraph's
    n-grams, less those of `none`. Words of `common` are left out, in their
    order, as long as for each class all positive differences of the n-grams
    made only of left-out words do not outweigh the intercepts.
    """
    gain = np.maximum(np.delete(weights - weights[none], none, 0), 0)
    total = np.delete(intercepts - intercepts[none], none)
    if (total >= 0).any():
        return None
    missing = [set(g.split(" ")) for g in vocabulary]
    holders: dict[str, list[int]] = {}
    for i, g in enumerate(missing):
        for w in g:
            holders.setdefault(w, []).append(i)
    kept = set(holders)
    for w in common:
        if w in kept:
            whole = [i for i in holders[w] if missing[i] == {w}]
            after = total + gain[:, whole].sum(1)
            if (after < -1e-6).all():
                total = after
                kept.discard(w)
                for i in holders[w]:
                    missing[i].discard(w)
    return sorted(kept)


def known(tokens: Column, vocabulary: list[str]) -> Column:
    """The word array with null in place of the words that stand in no n-gram of the vocabulary."""
    own = sorted({w for g in vocabulary for w in g.split(" ")})
    return F.transform(tokens, lambda w: F.when(w.isin(own), w))


def known_features(tokens: Column) -> Column:
    """n-grams of a word array that have no null, repeated ones included: all that a vocabulary can find in it."""
    grown = tokens
    parts = [tokens]
    for n in range(2, NGRAMS + 1):
        grown = F.zip_with(grown, F.slice(tokens, n, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grown)
    return F.array_compact(F.concat(*parts))


def needs(tokens: Column, some: list[str] | None) -> Column:
    """Whether a word array, maybe with nulls, needs scores, by triggers()."""
    return F.lit(True) if some is None else F.coalesce(F.exists(tokens, lambda w: w.isin(some)), F.lit(False))


def paragraphs(text: Column, some: list[str] | None, vocabulary: list[str]) -> Column:
    """known() words of each line of each paragraph (between blank lines) of the whole text that needs scores."""
    blocks = F.transform(F.split(text, r"\n(?:[^\S\n]*\n)+"), lambda b: F.transform(F.split(b, "\n"), lambda line: known(words(line), vocabulary)))
    return F.filter(blocks, lambda b: F.exists(b, lambda w: needs(w, some)))


def units(lines: Column, some: list[str] | None) -> Column:
    """(joined, w) of what is scored of a paragraph: its lines, and if there are several, windows over their joined words."""
    joined = F.flatten(lines)
    starts = F.sequence(F.lit(0), F.greatest(F.size(joined) - WINDOW + STEP - 1, F.lit(0)), F.lit(STEP))
    windows = F.when(F.size(lines) > 1, F.transform(starts, lambda i: F.struct(F.lit(True).alias("joined"), F.slice(joined, i + 1, WINDOW).alias("w")))).otherwise(F.array())
    return F.filter(F.concat(F.transform(lines, lambda w: F.struct(F.lit(False).alias("joined"), w.alias("w"))), windows), lambda u: needs(u.w, some))


def renamed(known: DataFrame) -> DataFrame:
    """(label UNKNOWN, text, notice, of) from notices (label, text): words of one family only are replaced by made-up names, in three ways."""
    tokens = known.select("label", "text", words(F.col("text")).alias("w"))
    own = tokens.select("label", F.explode("w").alias("t")).groupBy("t").agg(F.count_distinct("label").alias("c")).where("c = 1").agg(F.collect_set("t").alias("own"))
    rows = tokens.join(F.broadcast(own)).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))  # one row of a fixed number of words
    name = lambda t: F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.xxhash64("text", "k", t), F.lit(len(NAMES))) + 1).cast("int"))
    put = F.transform("w", lambda t: F.when(F.array_contains("own", t), name(t)).otherwise(t))
    left = F.size(F.filter("w", lambda t: ~F.array_contains("own", t)))
    rows = rows.where((left >= OWN_SHARE * F.size("w")) & (left < F.size("w"))).select(F.lit(UNKNOWN).alias("label"), F.array_join(put, " ").alias("text"), F.col("text").alias("notice"), F.col("label").alias("of"))
    return rows.where(F.rlike("text", F.lit(ABOUT)))


def training(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(label, text, notice, of): notices alone and inside neutral words, and bounded negatives of the corpus; `of` is the family a notice is made from."""
    families = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "label string, text string")
    named = [t.format(n) for t in NAMED for n in NAMES[:3]]
    others = spark.createDataFrame([(UNKNOWN, t) for t in OTHER + named] + [(NONE, t) for t in PLAIN], "label string, text string")
    known = families.select("label", "text", F.col("text").alias("notice"), F.col("label").alias("of")).unionByName(others.select("label", "text", F.col("text").alias("notice"), F.lit("").alias("of"))).unionByName(renamed(families))
    neutral = F.array(*(F.lit(x) for x in ("", "lorem ipsum dolor ", "the whole of it was here and then there ", "version 1.2 of 2024 by the authors ")))
    mixed = known.withColumn("before", F.explode(neutral)).withColumn("after", F.explode(neutral))
    mixed = mixed.select("label", F.concat("before", "text", F.lit(" "), "after").alias("text"), "notice", "of")
    lines = docs.where("text IS NOT NULL").select(F.element_at(F.split("text", "\n"), -1).alias("text")).where(~F.rlike(F.lower("text"), F.lit(CUES)))
    lines = lines.select(F.array_join(F.slice(F.split("text", " "), 1, NEGATIVE_WORDS), " ").alias("text"))
    negative = lines.where("text <> ''").distinct().orderBy(F.xxhash64("text"), "text").limit(NEGATIVES)
    return mixed.unionByName(negative.select(F.lit(NONE).alias("label"), "text", F.col("text").alias("notice"), F.lit("").alias("of")))


def calibrated(seen: list[tuple[str, str, float]]) -> tuple[float, dict[str, float]]:
    """Threshold, and shares right at it, from (true class, best class, its probability) of left-out notices.

    A text is right if its class comes out once families under the threshold
    are `unknown`. The threshold is the smallest of those with the best mean
    share over `unknown` and the families, and not under LEAST_PROBABILITY.
    """
    named = lambda best, p, t: UNKNOWN if best not in (NONE, UNKNOWN) and p < t else best
    share = lambda rows, t: sum(named(b, p, t) == c for c, b, p in rows) / max(len(rows), 1)
    kinds = {k: [r for r in seen if (r[0] == UNKNOWN, r[0] == NONE) == v] for k, v in (("unknown", (True, False)), ("families", (False, False)), ("none", (False, True)))}
    cuts = sorted({LEAST_PROBABILITY, *(p + 1e-9 for _, b, p in seen if b not in (NONE, UNKNOWN) and p >= LEAST_PROBABILITY)})
    best = max(cuts, key=lambda t: (round(share(kinds["unknown"], t) + share(kinds["families"], t), 9), -t))
    stated = [(c, named(b, p, best)) for c, b, p in seen]
    right = sum(c == b for c, b in stated if b not in (NONE, UNKNOWN))
    return best, {f"recall_{k}": share(rows, best) for k, rows in kinds.items()} | {"precision_families": right / max(sum(b not in (NONE, UNKNOWN) for _, b in stated), 1)}


class Classifier:
    """Vocabulary, multinomial logistic regression, class names, the calibrated threshold and triggers().

    The odds of `none` are raised by `lift`, which is 0 where the fit gives it its LEAST_LEAD.
    """

    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel, classes: list[str], threshold: float, some: list[str] | None = None, figures: dict[str, float] | None = None):
        self.vectors, self.model, self.classes, self.threshold, self.some = vectors, model, classes, threshold, some
        base = model.interceptVector.toArray()
        self.lift = max(0.0, float(np.delete(base, classes.index(NONE)).max() + LEAST_LEAD - base[classes.index(NONE)]))
        #: Shares right on left-out notices, by calibrated().
        self.figures = figures or {}

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds family and probability to rows with an array column grams."""
        out = self.model.transform(self.vectors.transform(df))
        p = vector_to_array("probability")
        if self.lift:
            none, odds = self.classes.index(NONE), float(np.exp(self.lift))
            rest = 1 + (odds - 1) * p[none]
            p = F.transform(p, lambda x, i: F.when(i == none, x * odds).otherwise(x) / rest)
        best = F.array_max(p)
        name = F.element_at(F.array(*(F.lit(c) for c in self.classes)), F.array_position(p, best).cast("int"))
        sure = F.when(name.isin(NONE, UNKNOWN) | (best >= self.threshold), name).otherwise(UNKNOWN)
        return out.withColumn("family", sure).withColumn("probability_of", best).drop("vector", "rawPrediction", "probability", "prediction").withColumnRenamed("probability_of", "probability")


def learn(spark: SparkSession, docs: DataFrame) -> Classifier:
    """Trains on training(); the threshold is calibrated on what FOLDS fits have not seen: whole families, and notices of the others.

    The training table has at most NEGATIVES rows of the corpus and a fixed
    number of notices, so all that reaches the driver is bounded.
    """
    classes = [*sorted(TEMPLATES), UNKNOWN, NONE]
    place = lambda c: F.array_position(F.array(*(F.lit(x) for x in classes)), F.col(c)).cast("double") - 1
    rows = training(spark, docs).select("label", "of", words(F.col("text")).alias("w"), F.xxhash64("notice").alias("h"))
    # A name that no fit has seen is in no n-gram of the vocabulary, and so are the made-up ones.
    known = F.filter(features(F.col("w")), lambda g: ~F.rlike(g, F.lit(rf"\b({'|'.join(NAMES)})\b")))
    rows = rows.select("label", "of", "w", known.alias("grams"), F.pmod("h", F.lit(4)).alias("part"), place("label").alias("k"), F.pmod(place("of"), F.lit(float(FOLDS))).cast("int").alias("fold"))
    rows = rows.withColumn("fold", F.when(F.col("of") == "", -1).otherwise(F.col("fold"))).coalesce(1).cache()
    vectors = CountVectorizer(inputCol="grams", outputCol="vector", binary=True, minDF=1, vocabSize=1 << 16).fit(rows.where(F.col("label") != NONE))
    regression = LogisticRegression(featuresCol="vector", labelCol="k", weightCol="weight", regParam=1e-4, maxIter=60, family="multinomial", standardization=False)

    def fit(some: DataFrame) -> LogisticRegressionModel:
        share = some.groupBy("k").agg(F.count("*").alias("n"))
        return regression.fit(vectors.transform(some.join(F.broadcast(share), "k").withColumn("weight", 1 / F.col("n"))))

    last = fit(rows)
    seen = []
    for f in range(FOLDS):
        out, held = F.col("fold") == f, F.col("part") == f
        # A class that a fit has not seen needs no place of its own: its families' rows are gone.
        model = Classifier(vectors, fit(rows.where(~out & ~held)), classes, 0.0)
        # Left-out families are judged by their own notices, not by those with names put in.
        test = rows.where((out & (F.col("label") == F.col("of"))) | (~out & held)).withColumn("true", F.when(out, UNKNOWN).otherwise(F.col("label")))
        seen += [(r["true"], r["family"], r["probability"]) for r in model.apply(test).select("true", "family", "probability").collect()]
    threshold, figures = calibrated(seen)
    # Words of the negatives, a bounded table, by the number of texts that have them.
    common = rows.where(F.col("label") == NONE).select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w")
    model = Classifier(vectors, last, classes, threshold, None, figures)
    base, none = last.interceptVector.toArray().copy(), classes.index(NONE)
    base[none] += model.lift
    model.some = triggers(vectors.vocabulary, last.coefficientMatrix.toArray(), base, none, [r["w"] for r in common.collect()])
    rows.unpersist()
    return model


def scan(df: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: license, licenses, n_paragraphs, probability, similarity, confirmed.

    Every line of the whole text is classified, and so are windows over the
    joined lines of a paragraph, as notices are wrapped. n_paragraphs counts
    the lines that state one (families and `unknown`), and the paragraphs of
    which only windows do. license is the most probable confirmed family,
    else `unknown` if some paragraph has licence wording, else `none`;
    licenses lists all confirmed families in order. similarity is the largest
    share of a template's word pairs (of a one-word template, its word) found in the paragraph. Null and empty
    texts are `none`; repeated ids give a row each; other columns are not read.
    Paragraphs without a word of triggers() are `none` by the weights alone;
    only the others are scored and shuffled.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), paragraphs(text, classifier.some, classifier.vectors.vocabulary).alias("found"))
    # Written, so that the texts are read and cut into words once.
    cued = written(docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.posexplode_outer("found").alias("block", "lines")), "license-paragraphs")
    bare = cued.where("lines IS NULL")
    scored = cued.where("lines IS NOT NULL").select("doc_id", "row", "block", F.inline(units(F.col("lines"), classifier.some)))
    rated = classifier.apply(scored.select("doc_id", "row", "block", "joined", "w", known_features(F.col("w")).alias("grams"))).drop("grams")
    templates = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, template string")
    pairs = templates.select("family", phrases(words(F.col("template"))).alias("pairs")).groupBy("family").agg(F.collect_list("pairs").alias("templates"))
    # One row per family: fixed size.
    near = rated.join(F.broadcast(pairs), "family", "left")
    # Only families have templates; the row's own pairs are made once for all of them.
    match = lambda own: F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, own)) / F.greatest(F.size(t), F.lit(1))))
    share = F.when(F.col("templates").isNotNull(), F.transform(F.array(F.concat(grams(F.col("w"), 2), F.array_distinct("w"))), match)[0])
    near = near.withColumn("similarity", F.coalesce(share, F.lit(0.0))).withColumn("ok", F.col("similarity") >= CONFIRM)
    states = F.col("family") != NONE
    blocks = lambda joined: F.collect_set(F.when(states & (F.col("joined") == joined), F.col("block")))
    best = F.max(F.when(F.col("ok"), F.struct("probability", "similarity", "family")))
    grouped = near.groupBy("row", "doc_id").agg(best.alias("best"), F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("family")))).alias("licenses"), (F.count_if(states & ~F.col("joined")) + F.size(F.array_except(blocks(True), blocks(False)))).alias("n_paragraphs"), F.max(F.when(states, F.struct("probability", "similarity"))).alias("other"))
    stated = grouped.select(
        "doc_id",
        F.coalesce("best.family", F.when(F.col("n_paragraphs") > 0, UNKNOWN).otherwise(NONE)).alias("license"),
        "licenses",
        "n_paragraphs",
        F.coalesce("best.probability", "other.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("best.similarity", "other.similarity", F.lit(0.0)).alias("similarity"),
        F.col("best").isNotNull().alias("confirmed"),
    )
    rest = bare.select("doc_id", F.lit(NONE).alias("license"), F.array().cast("array<string>").alias("licenses"), F.lit(0).cast("long").alias("n_paragraphs"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("similarity"), F.lit(False).alias("confirmed"))
    return rest.unionByName(stated)

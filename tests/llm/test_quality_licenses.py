"""Quality rules and licence scans: brute-force columns, decoding, held-out accuracy, odd rows."""

import itertools
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelane.llm import licenses, quality
from wakelane.llm.queries import op6_quality, op7_licenses

SF = "/root/testdata/sf0.01"
SEP = " \t\n\x0b\x0c\r"


def brute_base(text):
    t = text or ""
    w = [x for x in re.split(f"[{SEP}]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip(SEP)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {x for x in win if win.count(x) > 1} if len(win) < 3000 else {x for x in set(win) if win.count(x) > 1}
    inside = {i + k for i, x in enumerate(win) if x in many for k in range(8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def texts():
    return [None, "", " \n\t", "a", "a b c d e f g h " * 3, "x\x1cy z\xa0w", "# * $ % & | < >", "same line\nsame line\n\n\nsame line ", ("one two three four five six seven eight nine ten " * 4 + "\n") * 3, "é " * 40, " ".join(map(str, range(500)))]


def test_base_columns_against_brute_force(spark):
    rows = [(i, t, True, 0) for i, t in enumerate(texts())]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words int"), None).collect()
    for r in out:
        n, chars, symbols, dup, repeat = brute_base(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert r.kept == (not r.base_failed)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(60):
        chain = quality.Chain(rng.normal(size=(quality.N_CODES, 2)), rng.normal(size=(2, 2)))
        n = int(rng.integers(1, 8))
        codes = rng.integers(0, quality.N_CODES, (n, 13))
        score = chain.scores(codes)
        value = lambda y: sum(score[i, y[i]] for i in range(n)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))
        assert value(chain.decode(codes)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(4)
    chain = quality.Chain(rng.normal(size=(quality.N_CODES, 2)), rng.normal(size=(2, 2)))
    codes = rng.integers(0, quality.N_CODES, (1, 4, 13))
    score = chain.scores(codes[0])
    all_y = list(itertools.product((0, 1), repeat=4))
    p = np.exp([sum(score[i, y[i]] for i in range(4)) + sum(chain.move[a, b] for a, b in zip(y, y[1:])) for y in all_y])
    p /= p.sum()
    line, pair = chain._marginals(codes, np.ones((1, 4), bool), np.array([4]))
    for i in range(4):
        assert line[0, i, 1] == pytest.approx(sum(q for q, y in zip(p, all_y) if y[i]))
    assert pair[0, 0, 1] == pytest.approx(sum(q * sum((a, b) == (0, 1) for a, b in zip(y, y[1:])) for q, y in zip(p, all_y)))


def test_verdicts_agree_with_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op6_quality(spark, SF).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in rows}
    assert share[1] > 0.97 and share.get(0, 0) < 0.2


def test_marginals_with_sightings_are_those_of_all_labellings():
    rng = np.random.default_rng(5)
    chain = quality.Chain(rng.normal(size=(quality.N_CODES, 2)), rng.normal(size=(2, 2)))
    codes, seen = rng.integers(0, quality.N_CODES, (1, 4, 13)), np.log([[0.1, 0.9], [0.1, 0.9], [0.9, 0.1], [0.1, 0.9]])
    score = chain.scores(codes[0]) + seen
    all_y = list(itertools.product((0, 1), repeat=4))
    p = np.exp([sum(score[i, y[i]] for i in range(4)) + sum(chain.move[a, b] for a, b in zip(y, y[1:])) for y in all_y])
    p /= p.sum()
    line, _ = chain._marginals(codes, np.ones((1, 4), bool), np.array([4]), seen[None])
    for i in range(4):
        assert line[0, i, 1] == pytest.approx(sum(q for q, y in zip(p, all_y) if y[i]))


def test_menu_prose_and_footer_in_one_text(spark):
    chain = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    menu = ["HOME!! NEWS!! SHOP!! CONTACT!! LOGIN!! ABOUT!!"] * 3
    prose = ["The old harbour was rebuilt after the storm, and most of the boats returned within the year.", "Since then the town has grown, and two schools have opened near the market.", "Its people still meet there on Sundays."]
    footer = ["$$$ sale### now*** click&&& here%%% now$$$ sale###"] * 3
    after = ["In winter the ferry runs twice a day, if the wind allows it.", "The lighthouse has been closed to visitors for many years."]
    verdict = lambda lines: chain.decode(quality.line_features("\n".join(lines))[0]).tolist()
    assert verdict(menu + prose + footer) == [0] * 3 + [1] * 3 + [0] * 3
    assert verdict(prose + menu + after) == [1] * 3 + [0] * 3 + [1] * 2
    assert verdict(prose + footer[:1] + after) == [1] * 3 + [0] + [1] * 2


def test_no_labels_no_model(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert quality.judge(docs.limit(0), None).count() == 0


def test_licenses_of_the_given_documents(spark):
    stated = {"Licensed under CC BY-NC 4.0": "cc-by-nc", "GNU General Public License": "gpl", "Apache License": "apache-2.0", "MIT License": "mit", "All rights reserved": "proprietary"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op7_licenses(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = sorted({v for k, v in stated.items() if k in docs[r.doc_id]})
        assert r.licenses == want and r.license == (want[0] if len(want) == 1 else r.license if want else "none")


def test_license_rows(spark):
    docs = spark.createDataFrame([(100 + i, f"Some text about thing {i} and other things.") for i in range(40)], "doc_id long, text string")
    model = licenses.learn(spark, docs)
    long = "word " * 40000
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "A text.\nReleased under the MIT License.", "x"), (3, "A text.\nReleased under the MIT License.", "x"),
        (4, "He lost his driving licence on the way to town.", "x"), (5, long + "\nLicensed under the Apache License, Version 2.0. And then it went on for long.\n" + long, "x"),
        (6, "Licensed under the Frobnication Public License, version 9.", "x"), (7, "MIT License\nAll rights reserved.\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "x"),
        (8, "(c) Licensed under CC BY-SA 4.0 and nothing else", "x"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string"), model).collect()
    got = sorted((r.doc_id, r.license, tuple(r.licenses)) for r in out if r.doc_id != 7)
    assert got == [(1, "none", ()), (2, "none", ()), (3, "mit", ("mit",)), (3, "mit", ("mit",)), (4, "none", ()), (5, "apache-2.0", ("apache-2.0",)), (6, "unknown", ()), (8, "cc-by-sa", ("cc-by-sa",))]
    seven = next(r for r in out if r.doc_id == 7)
    assert {"gpl", "proprietary"} <= set(seven.licenses)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_license_plan_is_native(spark):
    model = licenses.learn(spark, spark.createDataFrame([(1, "plain text here.")], "doc_id long, text string"))
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_statements_without_a_usual_cue(spark):
    model = licenses.learn(spark, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = {"Distributed under GPLv3.": "gpl", "Available under the LGPL.": "lgpl", "Released under CC0 1.0.": "public-domain", "Distributed under Apache 2.0.": "apache-2.0", "MIT-Lizenz": "mit", "Steht unter der MIT-Lizenz.": "mit", "Este programa tiene licencia MIT.": "mit", "Er kam mit dem Hund nach Hause.": "none"}
    out = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string"), model).collect()
    assert {list(want)[r.doc_id]: r.license for r in out} == want


def test_paragraphs_without_triggers_are_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.learn(spark, docs)
    assert model.some is not None and {"gpl", "gplv3", "mit-lizenz", "licencia"} <= set(model.some)
    others = sorted({w for g in model.vectors.vocabulary for w in g.split()} - set(model.some))
    lines = docs.select(F.explode(F.split("text", "\n")).alias("p")).unionByName(spark.createDataFrame([(" ".join(others * 3),), (" ".join(others[::-1]),)], "p string"))
    lines = lines.select(licenses.words(F.col("p")).alias("w")).where(~F.arrays_overlap("w", F.array(*map(F.lit, model.some))))
    rated = model.apply(lines.select(licenses.features(F.col("w")).alias("grams")))
    assert rated.count() > 100 and rated.where("family <> 'none'").count() == 0


def test_known_features_are_the_n_grams_of_the_vocabulary(spark):
    vocabulary = ["mit", "the mit", "the mit license", "of the"]
    texts = ["", "the", "of the mit license", "the red mit license of the mit", "zzz zzz", "mit mit the the mit license", "of", "license of"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", licenses.words(F.col("text")).alias("w"))
    got = {r.i: (r.k, r.g) for r in df.select("i", licenses.known(F.col("w"), vocabulary).alias("k"), licenses.known_features(licenses.known(F.col("w"), vocabulary)).alias("g")).collect()}
    own = {"mit", "the", "license", "of"}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [w[j : j + n] for n in (1, 2, 3) for j in range(len(w) - n + 1)]
        assert got[i][0] == [x if x in own else None for x in w]
        assert sorted(got[i][1]) == sorted(" ".join(g) for g in grams if own.issuperset(g))
    # Masked words find the triggers that the plain ones do.
    both = df.select(licenses.needs(F.col("w"), ["license", "mit"]).alias("a"), licenses.needs(licenses.known(F.col("w"), vocabulary), ["license", "mit"]).alias("b")).collect()
    assert all(r.a == r.b for r in both) and [r.a for r in both] == [False, False, True, True, False, True, False, True]


def test_wrapped_notices(spark):
    notices = {
        "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    }
    rows, want = [], []
    for family, notice in notices.items():
        for width, mark, end in ((72, "", "\n"), (40, " * ", "\n"), (30, "# ", "\r\n")):
            rows.append((len(rows), end.join(["A short text about a thing.", "", *(mark + x for x in textwrap.wrap(notice, width)), "", "The end of it."])))
            want.append(family)
    model = licenses.learn(spark, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r.license for r in sorted(out, key=lambda r: r.doc_id)] == want
    assert max(len(re.findall(r"[\w.-]+", t)) for ts in licenses.TEMPLATES.values() for t in ts) <= licenses.WINDOW - licenses.STEP


def test_licences_outside_the_families_are_unknown(spark):
    model = licenses.learn(spark, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    print(model.threshold, model.figures, len(model.some or []))
    texts = ["Licensed under the European Union Public Licence (EUPL) 1.2", "Boost Software License - Version 1.0", "ISC License", "Artistic License 2.0 applies to this package", "zlib license", "Eclipse Public License", "Licensed under the terms of the Python Software Foundation License", "Released under the Open Font License, version 1.1."]
    plain = ["The driver lost her license after the accident in the town.", "She was released from hospital in May.", "The source of the river is the glacier."]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string"), model).collect()
    got = {(texts + plain)[r.doc_id]: r.license for r in out}
    assert got == dict.fromkeys(texts, "unknown") | dict.fromkeys(plain, "none")
    f = model.figures
    # Of notices that a fit has not seen; families have three to fourteen notices each.
    assert f["recall_unknown"] >= 0.6 and f["recall_families"] >= 0.35 and f["precision_families"] >= 0.7 and f["recall_none"] >= 0.9


def test_calibration_by_left_out_notices():
    seen = [("unknown", "mit", p) for p in (0.55, 0.6, 0.7)] + [("mit", "mit", p) for p in (0.65, 0.8, 0.9, 0.95)] + [("none", "none", 0.99)]
    t, figures = licenses.calibrated(seen)
    assert 0.7 < t < 0.8 and figures == {"recall_unknown": 1.0, "recall_families": 0.75, "recall_none": 1.0, "precision_families": 1.0}
    assert licenses.calibrated([])[0] == licenses.LEAST_PROBABILITY


def test_scores_against_a_plain_version(spark):
    """Grams, softmax, threshold and template share recomputed word by word."""
    import numpy as np
    import regex

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.learn(spark, docs)
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts][::3] + licenses.OTHER + licenses.PLAIN + ["", "GPLv3 MIT", "Ünïcode LICENSE v2.0-rc"]
    texts += [x for r in docs.limit(40).collect() for x in (r.text or "").split("\n")[:2]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", licenses.words(F.col("text")).alias("w")).withColumn("grams", licenses.features(F.col("w")))
    got = {r.i: (r.family, r.probability) for r in model.apply(df).select("i", "family", "probability").collect()}
    place = {g: k for k, g in enumerate(model.vectors.vocabulary)}
    weights, base = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    for i, t in enumerate(texts):
        w = regex.findall(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*", t.lower())
        some = {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        z = base + weights[:, [place[g] for g in some if g in place]].sum(1)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = model.classes[int(p.argmax())]
        want = "unknown" if best not in ("none", "unknown") and p.max() < model.threshold else best
        assert got[i][1] == pytest.approx(p.max(), abs=1e-9) and (got[i][0] == want or abs(p.max() - np.sort(p)[-2]) < 1e-9)
    near = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    pairs = lambda w: {" ".join(w[k : k + 2]) for k in range(len(w) - 1)}
    cut = lambda t: regex.findall(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*", t.lower())
    for r in near:
        if got[r.doc_id][0] in licenses.TEMPLATES and r.confirmed:
            own = cut(texts[r.doc_id])
            share = max(len((pairs(cut(t)) if len(cut(t)) > 1 else set(cut(t))) & (pairs(own) | set(own))) / max(len(pairs(cut(t)) or cut(t)), 1) for t in licenses.TEMPLATES[got[r.doc_id][0]])
            assert r.license == got[r.doc_id][0] and r.similarity == pytest.approx(share)

"""Registered queries with SQL against DuckDB; all names; the pipeline against its stages' brute force."""

import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_neardup import brute
from tests.oracle import difference, duck
from wakelane.llm import stages
from wakelane.llm.quality import judged
from wakelane.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    assert difference(spark, duck(SF), QUERIES[name], ORACLES[name], SF) is None


def test_names():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "packing"]


def corpus(spark, path):
    """Clean documents with copies and near copies, junk, and rows with nulls, beside labels that mark the junk."""
    rng = random.Random(8)
    words = {"en": "the cat sat on a mat and then dogs came home to eat their bread with us".split(), "de": "der hund und die katze sind nicht auf dem tisch sondern im haus mit uns".split()}
    rows, labels = [], []

    def add(text, lang, quality=None):
        rows.append((len(rows), text, lang, "s", len(text or "")))
        if quality is not None:
            labels.append((rows[-1][0], quality, 0))

    for i in range(120):
        lang = ("en", "de")[i % 2]
        body = [f"{rng.choice(words[lang])}{rng.choice(['', '', 's', 'er'])}" for _ in range(90)]
        text = "\n".join(" ".join(body[k : k + 15]).capitalize() + "." for k in range(0, 90, 15))
        add(text, lang, 1)
        if i % 10 == 0:
            add(text, lang)
            add(text.replace(body[40], "x" + body[40], 1), lang)
        if i % 4 == 0:
            add("\n".join(" | ".join(rng.choice(body) + rng.choice("*#%") * 3 for _ in range(12)) for _ in range(6)), lang, 0)
    add(None, None)
    add("", "en")
    add("too short", "en")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return rows, labels


def test_stages_one_after_another(spark, tmp_path):
    rows, labels = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    junk = {i for i, q, _ in labels if q == 0}
    kept = stages.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    base = {i for i, t, *_ in rows if not judged(t, None)[5]}
    assert ids <= base and not ids & junk and {i for i, q, _ in labels if q == 1} <= ids
    named = stages.language(spark, kept, str(tmp_path))
    assert named.columns == docs.columns and {r.doc_id for r in named.collect()} == ids
    single = stages.near_dedup(spark, named, str(tmp_path))
    classes = brute([(i, t) for i, t, *_ in rows if i in ids])
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, c in classes.items() if i == c)
    packed = stages.packing(spark, single, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, c in classes.items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in packed}


def test_stages_of_empty_tables(spark, tmp_path):
    rows, _ = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0

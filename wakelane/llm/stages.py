"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each one operator's decision.

All but the last return the columns of documents. Models are learnt from the
tables in sf_dir, decisions are taken on all rows of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from wakelane.llm import langid, neardup
from wakelane.llm import packing as pack
from wakelane.llm import quality as rules
from wakelane.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own(docs):
    """The columns of documents that docs has; others are dropped, so that none can clash."""
    return [c for c in COLUMNS if c in docs.columns]


def quality(spark, docs, sf_dir):
    """Documents that the base rules and the line labelling keep."""
    chain = rules.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.judge(docs.select(*own(docs)), chain).where("kept").select(*own(docs))


def language(spark, docs, sf_dir):
    """Documents whose language is one of the learnt ones, by a clear lead."""
    known = table(spark, sf_dir, "documents").where(~langid.held_out(F.col("doc_id")))
    return langid.identify(docs.select(*own(docs)), langid.learn(known)).where(~F.col("lang_rejected")).select(*own(docs))


def near_dedup(spark, docs, sf_dir):
    """The document with the smallest id of each near-duplicate class; documents without an id stay."""
    docs = docs.select(*own(docs))
    gone = neardup.near_duplicates(docs).where("class_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark, docs, sf_dir):
    """Places of all pieces of all documents kept so far."""
    return pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=pack.CAPACITY).places.drop("part", "row")

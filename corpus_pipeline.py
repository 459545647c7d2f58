"""The corpus pipeline: quality rules, language ID, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakelane.llm import stages
from wakelane.llm.common import table, written

#: (name, function of (spark, docs, sf_dir)); each works on all that its predecessor kept.
STAGES = [
    ("quality_rules", stages.quality),
    ("language_id", stages.language),
    ("near_dedup", stages.near_dedup),
    ("packing", stages.packing),
]

#: Trained models, signatures and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

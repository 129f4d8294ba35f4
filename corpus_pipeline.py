"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadflow.llm import stages
from leadflow.llm.common import table, written

STAGES = [
    ("quality_classifier", stages.quality),
    ("minhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontamination),
    ("pii", stages.pii),
    ("packing", stages.packing),
]
#: a trained classifier, minhashes and a tokenizer are outside SQL; tests/llm checks the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

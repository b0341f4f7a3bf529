"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import common, decontaminate, jaccard, language_id, mixing, sharding

STAGES = [
    ("language_id", language_id.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Language models and hashed sets have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before it kept, each result written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

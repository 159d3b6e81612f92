"""The corpus pipeline: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sphereframe.llm import decontam, minhash, packing, rules, secrets
from sphereframe.llm.common import materialize, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", rules.stage),
    ("near_dedup", minhash.stage),
    ("decontamination", decontam.stage),
    ("secret_scan", secrets.stage),
    ("packing", packing.stage),
]

#: Quantile sketches, MinHash and the trained network cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that pass every stage, with their places in sequences."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

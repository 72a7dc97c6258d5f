"""From raw documents to packed training sequences, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.stages import dedup_stage, mixing_stage, packing_stage, quality_stage, rules_stage
from loomgraph.runtime import stage, table

STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression, fingerprints and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import stages
from loomgraph.llm.common import checkpoint, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("exact_dedup", stages.exact_copies),
    ("near_dedup", stages.near_copies),
    ("line_dedup", stages.repeated_passages),
    ("packing", stages.packed),
]

#: The trees, the near-duplicate classes and the packing have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs

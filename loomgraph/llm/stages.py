"""The stages of the corpus pipeline: documents in, documents out with the same columns; the last one gives pieces.

Cases that all share: null and empty texts are rejected by the first stage, and later stages take them as empty where
they are called alone; rows that repeat an id are one document (all stay or go, and lose the same words); rows without
an id stay in the duplicate stages, which cannot name them; ties go to the smallest id; texts of any length are read
whole; columns beside the id and the text are carried along under whatever name; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, packing, quality
from .common import table
from .exact_dedup import kept_documents
from .near_dedup import distinct_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return distinct_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_line_words=line_dedup.MIN_WORDS)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences; one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)

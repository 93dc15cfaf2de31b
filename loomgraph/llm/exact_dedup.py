"""Exact deduplication by 128-bit content hash, with byte comparison inside equal hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_ids


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, dropped ones too.

    Columns: the id, keep_id (smallest id of the rows with an equal text), group_size, kept,
    text_sha256 and text_md5. Join to docs on the id for other columns.

    Plan: one partial aggregation by (md5, text) sends each distinct text of a task once, however
    many copies it has, so a group that holds a third of all rows costs one row per task. Texts
    with the same md5 stay apart because the text itself is in the key: that is the comparison
    of bytes. Rows then find their group by md5 and SHA-256, so that no text travels twice. Groups
    of one row are not joined; the join has one row per group on the right, and Spark splits a
    hot group's rows on the left.

    Defined cases: null text equals the empty text; rows that repeat the smallest id are one
    document and are all kept; a null id is smaller than none: it is kept only where no row
    of its group has an id; an empty table gives an empty result.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm")).select(
        "id", "norm", F.unhex(F.md5("norm")).alias("hash"), F.sha2("norm", 256).alias("sha")
    )
    repeated = (
        rows.groupBy("hash", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") > 1)
        .select(F.col("hash").alias("r_hash"), F.sha2("norm", 256).alias("r_sha"), "keep_id", "size")
    )
    joined = rows.select("id", "hash", "sha").join(
        repeated, (F.col("hash") == F.col("r_hash")) & (F.col("sha") == F.col("r_sha")), "left"
    )
    grouped = F.col("r_hash").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("id"))
    size = F.coalesce("size", F.lit(1))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        size.cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.lower(F.hex("hash")).alias("text_md5"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    return with_ids(docs, exact_dedup(docs, id_col, text_col).filter("kept").select(id_col), id_col)

"""Reindexing as a stream: files that arrive in a folder as (path, content, seq) rows bring a store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomgraph.sources.store import Store


def watch(spark: SparkSession, source: str, store: Store, checkpoint: str) -> StreamingQuery:
    """A query that applies each batch of changed files in `source` (Parquet rows path, content, seq; content null: removed) to the store.

    The row with the largest seq of a path counts, over all batches: the store keeps the last seq of every path beside
    what it brought, and older rows that come later are dropped. Applying a batch twice changes nothing, so a restart is safe.
    """
    changes = spark.readStream.schema("path string, content string, seq long").parquet(source)

    def apply(batch: DataFrame, _: int) -> None:
        store.apply(batch)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(store: Store, changed: DataFrame) -> None:
    """Reindexes the changed files alone; files that the batch does not name stay."""
    store.reindex(changed, partial=True)

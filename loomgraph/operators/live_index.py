"""An index that is kept up to date: segments for what has been added, tombstones for what has gone, merges now and then."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.layered import Layered
from loomgraph.sources.lineage import materialise

from .search import COLUMNS, MOST_BUCKETS, Index, write_index

#: Segments after which all are merged.
MOST_SEGMENTS = 8
#: Ids that have gone, counted when they were written, up to which they are broadcast.
FEW_GONE = 50_000


class LiveIndex(Layered, Index):
    """Searches give what search() over the rows that are in it gives, after any additions, replacements and deletions.

    A change writes a segment of its own: postings, lengths and terms of what is new, and the ids that it takes out of
    earlier segments. Rows' number and total length are kept exact in the version's file: what goes is looked up once, when it goes.
    A query reads the terms it names in all segments and leaves out hits that a later segment has taken out.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: tuple[str, ...] = COLUMNS, id_type: str = "string", buckets: int = 64) -> None:
        Layered.__init__(self, spark, folder)
        Index.__init__(self, folder, columns, min(buckets, MOST_BUCKETS))
        self.id_type = id_type

    def _state(self) -> dict:
        found = self._pointers()
        return self._told(found[-1]) | {"number": found[-1][0]} if found else {"layers": [], "gone": {}, "n": 0, "places": 0, "buckets": self.buckets, "number": -1}

    def _folders(self) -> list[str]:
        return [f"{self.folder}/{v}" for v in self._state()["layers"]]

    def _read(self, spark: SparkSession, id_type: str) -> tuple[DataFrame, DataFrame, int, float | None]:
        state = self._state()
        self.buckets = state["buckets"]
        if not state["layers"]:
            empty = spark.createDataFrame([], f"term string, id {id_type}, field string, places array<int>, bucket int, _layer int")
            return empty, spark.createDataFrame([], f"id {id_type}, length int, _layer int"), 0, None
        return *self._tables(spark, self._folders(), id_type), state["n"], state["places"] / state["n"] if state["n"] else None

    def _gone(self, state: dict) -> DataFrame | None:
        held = [(k, v) for k, v in enumerate(state["layers"]) if state["gone"].get(v)]
        if not held:
            return None
        rows = [self.spark.read.schema(f"id {self.id_type}").parquet(f"{self.folder}/{v}/gone").select("id", F.lit(k).alias("_gone")) for k, v in held]
        last = reduce(DataFrame.unionAll, rows).groupBy("id").agg(F.max("_gone").alias("_gone"))
        return F.broadcast(last) if sum(state["gone"].values()) <= FEW_GONE else last

    def _alive(self, rows: DataFrame) -> DataFrame:
        gone = self._gone(self._state())
        if gone is None:
            return rows
        gone = gone.withColumnRenamed("id", "_id")
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("_gone") > F.col("_layer")), "left_anti")

    def add(self, rows: DataFrame, id_col: str = "id") -> None:
        """Adds rows with unique ids; rows that have these ids go."""
        self._change(rows.select(F.col(id_col).alias("id"), *self.columns), rows.select(F.col(id_col).alias("id")))

    def delete(self, ids: DataFrame) -> None:
        """Takes out the rows with the ids (one column); ids that are not there change nothing."""
        none = self.spark.createDataFrame([], f"id {self.id_type}, " + ", ".join(f"`{c}` string" for c in self.columns))
        self._change(none, ids.toDF("id"))

    def _change(self, rows: DataFrame, ids: DataFrame) -> None:
        state, version = self._state(), f"s-{uuid.uuid4().hex}"
        _, lengths, _, _ = self._read(self.spark, self.id_type)
        ids = materialise(ids.distinct())
        gone = materialise(self._alive(lengths).join(ids, "id", "left_semi"))
        n_gone, places_gone = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        n, places, _ = write_index(rows, f"{self.folder}/{version}", "id", self.columns, state["buckets"])
        gone.select("id").write.parquet(f"{self.folder}/{version}/gone")
        told = {"version": version, "layers": [*state["layers"], version], "gone": state["gone"] | {version: n_gone}, "n": state["n"] - n_gone + n, "places": state["places"] - places_gone + places, "buckets": state["buckets"]}
        self._name(told, state["number"])
        if len(told["layers"]) > MOST_SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """Writes all segments as one, without what has gone; texts are not read."""
        state, version = self._state(), f"s-{uuid.uuid4().hex}"
        if len(state["layers"]) < 2:
            return
        postings, lengths = self._tables(self.spark, self._folders(), self.id_type)
        folder = f"{self.folder}/{version}"
        self._alive(lengths).drop("_layer").write.parquet(f"{folder}/lengths")
        self._alive(postings).drop("_layer").repartition("bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{folder}/postings")
        terms = self.spark.read.schema("term string, bucket int").parquet(f"{folder}/postings").select("term", "bucket").distinct()
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        self._name({k: state[k] for k in ("n", "places", "buckets")} | {"version": version, "layers": [version], "gone": {}}, state["number"])

"""Edges kept for walks: two bucketed tables, by either end, that any number of walks read."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.lineage import Steps, shared_folder

from .traverse import DIRECTIONS, oriented, small

#: Edges in a bucket, about, and buckets at most.
BUCKET_EDGES, MOST_BUCKETS = 4_000_000, 8192
#: Cells of a level, counted when it was written, up to which their ids are named in the filter of the scan.
FEW_NODES = 200


class Adjacency:
    """Steps (cell, there, kind) along edges and against them, each in buckets by cell and sorted by it.

    A cell is the node a step goes from; a hub has a cell for each BUCKET_EDGES of its steps, so no bucket grows with it.
    A level of few nodes names them: the scan opens the buckets they fall in, and there the row groups that may hold
    them. A wider level is broadcast while it is small; beyond, it alone is dealt, into the buckets of the steps. Edges are
    exchanged when the tables are written and never again. Parallel edges of a kind are one step.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int) -> None:
        self.sparkSession, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._tables: dict[str, str] = {}
        self._hubs: dict[str, DataFrame | None] = {}

    @classmethod
    def build(cls, edges: DataFrame, folder: str | None = None, buckets: int | None = None) -> Adjacency:
        """Writes the tables, by default in the shared folder. Edges with a null end lead nowhere and are left out. buckets: by default as many as the edges ask for."""
        spark = edges.sparkSession
        work = Steps(spark)
        rows, told = work.write(edges.select("source", "target", "kind").filter("source IS NOT NULL AND target IS NOT NULL").distinct())
        found = cls(spark, folder or shared_folder(spark, "adjacency"), buckets or min(MOST_BUCKETS, max(1, -(-told["n"] // BUCKET_EDGES))))
        for direction in DIRECTIONS:
            steps = oriented(rows, direction, keep=("kind",))
            degrees = steps.groupBy("here").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_EDGES)
            degrees.select("here", F.ceil(F.col("n") / BUCKET_EDGES).cast("int").alias("parts")).write.mode("overwrite").parquet(f"{found.folder}/hubs_{direction}")
            found._enter(direction, steps)
        work.drop(rows)
        spark.createDataFrame([(found.buckets,)], "buckets int").write.mode("overwrite").parquet(f"{found.folder}/totals")
        return found

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Adjacency:
        """The tables that build() wrote in the folder."""
        found = cls(spark, folder, spark.read.parquet(f"{folder.rstrip('/')}/totals").first().buckets)
        for direction in DIRECTIONS:
            found._enter(direction)
        return found

    def _enter(self, direction: str, steps: DataFrame | None = None) -> None:
        """Enters the table of a direction in the session's catalog, which knows its buckets; steps are written first if given."""
        name, path = f"adjacency_{direction}_{uuid.uuid4().hex}", f"{self.folder}/{direction}"
        hubs = self.sparkSession.read.schema("here string, parts int").parquet(f"{self.folder}/hubs_{direction}")
        n = hubs.count()
        self._hubs[direction] = small(hubs, n) if n else None
        if steps is not None:
            part = F.lit(0)
            if n:
                steps = steps.join(self._hubs[direction], "here", "left")
                part = F.pmod(F.xxhash64("there"), F.coalesce("parts", F.lit(1)))
            cells = steps.select(_cell(F.col("here"), part).alias("cell"), "there", "kind").repartition(self.buckets, "cell")  # one file a bucket
            cells.write.format("parquet").mode("overwrite").option("path", path).bucketBy(self.buckets, "cell").sortBy("cell").saveAsTable(name)
        else:
            self.sparkSession.sql(f"CREATE TABLE {name} (cell STRING, there STRING, kind STRING) USING parquet CLUSTERED BY (cell) SORTED BY (cell) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self._tables[direction] = name

    def close(self) -> None:
        """Takes the tables out of the catalog; their files stay."""
        for name in self._tables.values():
            self.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()

    def beyond(self, level: DataFrame, n: int, direction: str = "out", kinds: Iterable[str] | None = None) -> DataFrame:
        """level (n rows with _here) and there, for each step from _here."""
        met = [self._beyond(level, n, d, kinds) for d in (DIRECTIONS if direction == "both" else (direction,))]
        return met[0] if len(met) == 1 else met[0].unionAll(met[1])

    def _beyond(self, level: DataFrame, n: int, direction: str, kinds: Iterable[str] | None) -> DataFrame:
        steps = self.sparkSession.table(self._tables[direction])
        if kinds is not None:
            steps = steps.filter(F.col("kind").isin(list(kinds)))
        hubs = self._hubs[direction]
        if hubs is None:
            cells = level.withColumn("_cell", _cell(F.col("_here"), F.lit(0)))
        else:
            parts = level.join(hubs, F.col("_here") == F.col("here"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            cells = parts.withColumn("_cell", _cell(F.col("_here"), F.col("_part"))).drop("here", "parts", "_part")
        if n <= FEW_NODES:
            named = [r[0] for r in cells.select("_cell").distinct().limit(FEW_NODES + 1).collect()]
            if len(named) <= FEW_NODES:
                steps = steps.filter(F.col("cell").isin(named))
        # a hub's cells are as many as its share of the buckets, so a level that may be broadcast still may in cells
        return steps.join(small(cells, n), F.col("_cell") == F.col("cell")).drop("kind", "cell", "_cell")


def _cell(here: Column, part: Column) -> Column:
    """The name of a part of a node's steps: the id itself in the first. NUL in ids is doubled, so names never meet."""
    name = F.replace(here, F.lit("\0"), F.lit("\0\0"))
    return F.when(part == 0, name).otherwise(F.concat(name, F.lit("\0"), part.cast("string")))

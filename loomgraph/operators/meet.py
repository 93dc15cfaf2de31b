"""The shortest path between two nodes, searched from both ends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.lineage import Steps

from .adjacency import Adjacency
from .traverse import BROADCAST_ROWS, GATHER_AFTER, Written, small, union

PATH = "node_id string, depth int, path array<string>"


class _End:
    """The levels of one end: rows (node_id, other[, _met]), where other is the node of the level before it that a step joins it to."""

    def __init__(self, work: Steps, ways: Adjacency | Written, node: str, direction: str, kinds: Iterable[str] | None) -> None:
        self.work, self.ways, self.direction, self.kinds = work, ways, direction, kinds
        self.spark = ways.sparkSession
        first, told = work.write(self.spark.createDataFrame([(node, None)], "node_id string, other string"))
        self.levels, self.n, self.seen = [first], told["n"], told["n"]
        self._gathered, self._since = None, [first]

    def nodes(self, k: int = -1) -> DataFrame:
        return self.levels[k].select("node_id").distinct()

    def go_on(self, facing: _End) -> bool:
        """Writes the next level; whether it meets the last level of the other end."""
        last = self.nodes().withColumnRenamed("node_id", "_here")
        found = self.ways.beyond(last, self.n, self.direction, self.kinds).select(F.col("there").alias("node_id"), F.col("_here").alias("other"))
        if len(self._since) > GATHER_AFTER:
            merged, _ = self.work.write(union([self._gathered, *self._since], "node_id").distinct())
            self.work.drop(*([self._gathered] if self._gathered is not None else []))
            self._gathered, self._since = merged, []
        seen = union([self._gathered, *self._since], "node_id")
        found = found.distinct().join(F.broadcast(seen) if self.seen <= BROADCAST_ROWS else seen, "node_id", "left_anti")
        mark = facing.nodes().withColumn("_met", F.lit(True))
        found = found.join(small(mark, facing.n), "node_id", "left")
        level, told = self.work.write(found, met=F.coalesce(F.bool_or("_met"), F.lit(False)))
        self.levels.append(level)
        self._since.append(level)
        self.n = told["n"]
        self.seen += told["n"]
        return told["met"]


def between(edges: DataFrame | Adjacency, a: str, b: str, kinds: Iterable[str] | None = None) -> DataFrame:
    """One row (node_id, depth, path) if b can be reached from a along edges, none if not; [a] if they are equal.

    Levels are written from a along edges and from b against them; the end with fewer rows in its last level goes on.
    A level holds all nodes of its distance, so the first level that meets the other end's last one does so on all
    shortest paths. The path is the one a search from a alone gives, which takes the smallest parent of each node: from the
    meeting nodes the levels of b are followed back, keeping what shortest paths pass, and then one row a level is
    looked up from b to a. The steps are not read again for it. A hub's rows in a level are (node, other) pairs, dealt by both.
    """
    spark = edges.sparkSession
    if a == b:
        return spark.createDataFrame([(b, 0, [b])], PATH)
    kinds = None if kinds is None else list(kinds)
    work = Steps(spark)
    ways = Written(edges, work) if isinstance(edges, DataFrame) else edges
    ahead, back = _End(work, ways, a, "out", kinds), _End(work, ways, b, "in", kinds)
    met = False
    while ahead.n and back.n and not met:
        near, far = (ahead, back) if ahead.n <= back.n else (back, ahead)
        met = near.go_on(far)
    path = None
    if met:
        passed = _passed(work, ahead, back)
        at, path = b, [b]
        for level in [*reversed(passed), *reversed(ahead.levels[1:])]:  # (node_id, other): other is one step nearer to a
            at = level.filter(F.col("node_id") == at).agg(F.min("other")).first()[0]
            path.append(at)
        work.drop(*passed)
    if isinstance(ways, Written):
        ways.drop()
    work.drop(*ahead.levels, *back.levels)
    return spark.createDataFrame([] if path is None else [(b, len(path) - 1, path[::-1])], PATH)


def _passed(work: Steps, ahead: _End, back: _End) -> list[DataFrame]:
    """Tables (node_id, other) of the steps that shortest paths take behind the meeting nodes, nearest to a first; other is one step nearer to a."""
    on, n = ahead.nodes().join(back.nodes(), "node_id", "left_semi"), min(ahead.n, back.n)
    out = []
    for level in reversed(back.levels[1:]):  # (node_id, other): other is one step nearer to b
        taken = level.join(small(on, n), "node_id", "left_semi")
        table, told = work.write(taken.select(F.col("other").alias("node_id"), F.col("node_id").alias("other")))
        out.append(table)
        on, n = table.select("node_id").distinct(), told["n"]
    return out

"""Betweenness centrality: shortest-path counts forwards by level, dependencies backwards (Brandes 2001), for many sources at once."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.lineage import Steps
from loomgraph.sources.model import Graph

from .traverse import GATHER_AFTER, oriented, small, union

#: Ways into ends that a task sorts, about: some 64 bytes each.
WAYS_A_TASK = 1_000_000
#: Of so many nodes one is looked at to tell how many ways into ends there are.
COUNTED_SHARE = 16


def sample_error(nodes: int, sources: int, delta: float = 0.05) -> float:
    """By how much a sampled betweenness may differ from the true one, for all nodes together, but for probability delta.

    Of a sample of sources, a node's mean dependency lies between 0 and nodes - 2; Hoeffding's bound over all nodes.
    """
    return nodes * max(0, nodes - 2) * math.sqrt(math.log(2 * max(1, nodes) / delta) / (2 * sources))


def betweenness(g: Graph, kinds: Iterable[str] | None = None, sample: int | None = None) -> DataFrame:
    """(id, betweenness) of every node: over all ordered pairs of other nodes, the share of the shortest ways between them that it lies on.

    Ways follow edges' direction; parallel edges are one, and self-loops none. sample: so many sources (those with the
    smallest hash of their id) stand for all and are scaled up; see sample_error.

    Nodes are numbered, as ids would be most of what is moved. All sources travel together, one job a level, but only to nodes that edges
    lead on from: the number of shortest ways to each (source, node) is a sum over the last level. What edges end at (all else) no way leads through, so
    it has no level: once the levels are known, all ways into it are compared at once, and each goes back to the node before as its share.
    Then levels are gone through backwards, and each (source, node) gets its share of what depends on those behind
    it. Rows that are kept are pairs of a source and what it reaches that leads on, so a large graph is to be sampled.
    """
    work = Steps(g.nodes.sparkSession)
    edges = oriented(g.edges, "out", kinds).filter("here <> there")
    ids, n = _numbered(g, edges, work)
    steps, told = _steps(edges, ids, work)
    onward = steps.filter("onward").select("here", "there")
    level, count = onward.select(F.col("here").alias("source"), F.col("there").alias("node"), F.lit(1.0).alias("ways")), told["onward"] or 0
    k = max(1, n)
    if sample is not None and sample < n:
        k = max(1, sample)
        chosen = ids.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("number").alias("source"))
        level, told = work.write(level.join(small(chosen, sample), "source", "left_semi"))
        count = told["n"]
    levels, counts = _levels(level, count, onward, work)
    into_ends = _shares_of_ends(levels, counts, steps.filter("NOT onward").select("here", "there"), work)
    gained, behind = [], None
    for d in range(len(levels), 0, -1):
        # what lies behind the nodes of this level: ends, and the level after it
        rows = levels[d - 1].join(into_ends.filter(F.col("depth") == d).select("source", "node", "share"), ["source", "node"], "left")
        depends = F.coalesce("share", F.lit(0.0))
        if behind is not None:
            ends = behind.select("source", F.col("node").alias("there"), ((1 + F.col("depends")) / F.col("ways")).alias("each"))
            last = small(levels[d - 1].select("source", "node"), counts[d - 1])
            shares = onward.join(last, F.col("here") == F.col("node")).join(ends, ["source", "there"]).groupBy("source", "node").agg(F.sum("each").alias("each"))
            rows = rows.join(shares, ["source", "node"], "left")
            depends = depends + F.col("ways") * F.coalesce("each", F.lit(0.0))
        behind, _ = work.write(rows.select("source", "node", "ways", depends.alias("depends")))
        gained.append(behind.select("node", "depends"))
    if not gained:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    total = reduce(DataFrame.unionAll, gained).groupBy(F.col("node").alias("number")).agg((F.sum("depends") * (n / k)).alias("total"))
    return ids.join(total, "number", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("betweenness"))


def _numbered(g: Graph, edges: DataFrame, work: Steps) -> tuple[DataFrame, int]:
    """(id, number, onward) of every node, numbered from 0 on, and how many there are. onward: edges lead on from it, if only to what is no node."""
    leads = edges.select(F.col("here").alias("id"), F.lit(True).alias("_onward")).distinct()
    nodes = g.nodes.select("id").distinct().join(leads, "id", "left")
    placed, told = work.write(nodes.select("id", F.coalesce("_onward", F.lit(False)).alias("onward"), F.monotonically_increasing_id().alias("_place")))
    task = F.shiftright("_place", 33)
    firsts, first = [], 0
    for r in placed.groupBy(task.alias("_task")).count().orderBy("_task").collect():  # a row for each task that wrote them
        firsts.append((r["_task"], first))
        first += r["count"]
    firsts = g.nodes.sparkSession.createDataFrame(firsts, "_task long, _first long")
    numbered = placed.withColumn("_task", task).join(F.broadcast(firsts), "_task")
    return numbered.select("id", (F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias("number"), "onward"), told["n"]


def _steps(edges: DataFrame, ids: DataFrame, work: Steps) -> tuple[DataFrame, dict]:
    """Distinct steps (here, there, onward) between nodes, as numbers; onward: edges lead on from there. Its counts: n, and onward of those."""
    # an id is one row, so a table of those of a task is small beside its edges, which need no sorting
    heres = ids.select(F.col("id").alias("here"), F.col("number").alias("_here")).hint("shuffle_hash")
    theres = ids.select(F.col("id").alias("there"), F.col("number").alias("_there"), "onward").hint("shuffle_hash")
    rows = edges.join(heres, "here").select("_here", "there").join(theres, "there")
    steps = rows.groupBy("there", "_there", "_here").agg(F.first("onward").alias("onward"))  # where the join has put them
    return work.write(steps.select(F.col("_here").alias("here"), F.col("_there").alias("there"), "onward"), onward=F.count_if("onward"))


def _levels(level: DataFrame, count: int, steps: DataFrame, work: Steps) -> tuple[list[DataFrame], list[int]]:
    """(source, node, ways) level by level from the first on, and how many rows each has. What has been met is read from the levels, and gathered now and then."""
    levels, counts, gathered, since = [], [], None, []
    while count:
        levels.append(level)
        counts.append(count)
        since.append(level)
        if len(since) > GATHER_AFTER:
            merged, _ = work.write(union([gathered, *since], "source", "node"))
            work.drop(*([gathered] if gathered is not None else []))
            gathered, since = merged, []
        found = steps.join(small(level, count), F.col("here") == F.col("node")).filter("there <> source").groupBy("source", F.col("there").alias("node")).agg(F.sum("ways").alias("ways"))
        level, told = work.write(found.join(union([gathered, *since], "source", "node"), ["source", "node"], "left_anti"))
        count = told["n"]
    return levels, counts


def _shares_of_ends(levels: list[DataFrame], counts: list[int], steps: DataFrame, work: Steps) -> DataFrame:
    """(depth, source, node, share): over all ends that the steps lead to, what part of the shortest ways from the source goes through the node as the last before the end."""
    if not levels:
        return None
    met = [rows.select("source", "node", F.lit(d).alias("depth"), "ways") for d, rows in enumerate(levels, 1)]
    # an end beside its source is nearer than any way; sources that lead to ends alone have no other way
    own = levels[0].select("source", F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("ways")).distinct()
    met = reduce(DataFrame.unionAll, [own, *met])
    ways = steps.join(met, F.col("here") == F.col("node")).select("source", "there", "node", "depth", "ways")
    tasks = -(-_about(steps, met) // WAYS_A_TASK)
    if tasks > int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ways = ways.repartition(tasks, "source", "there")
    same = Window.partitionBy("source", "there")
    nearest = ways.withColumn("_least", F.min("depth").over(same)).filter("depth = _least")
    shares = nearest.withColumn("share", F.col("ways") / F.sum("ways").over(same)).filter("depth > 0").groupBy("depth", "source", "node").agg(F.sum("share").alias("share"))
    return work.write(shares.sortWithinPartitions("depth"))[0]  # so that a level reads its own pages


def _about(steps: DataFrame, met: DataFrame) -> int:
    """About how many rows steps from the nodes met make, by a share of the nodes; it only says over how many tasks all of them are dealt."""
    some = lambda c: F.pmod(F.xxhash64(c), F.lit(COUNTED_SHARE)) == 0
    sources = met.filter(some("node")).groupBy("node").agg(F.count(F.lit(1)).alias("sources"))
    ends = steps.filter(some("here")).groupBy(F.col("here").alias("node")).agg(F.count(F.lit(1)).alias("ends"))
    return COUNTED_SHARE * (sources.join(ends, "node").agg(F.sum(F.col("ends") * F.col("sources"))).first()[0] or 0)

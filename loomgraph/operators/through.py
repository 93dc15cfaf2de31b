"""Walks that must pass waypoints: a search over pairs of a node and the state of a small automaton."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.lineage import Steps
from loomgraph.sources.model import Graph

from .traverse import oriented, small

#: A mask has a bit for each waypoint.
MOST_WAYPOINTS = 31


def through(g: Graph, start: DataFrame, waypoints: Sequence[Column], exits: Column, direction: str = "out", kinds: Iterable[str] | None = None, max_depth: int = 10) -> DataFrame:
    """(seed, exit_id, depth, path): for each seed of start (seed, node_id) and each exit, the shortest walk that passes all waypoints in order.

    Waypoints and exits are conditions on the columns of nodes. A node that is entered serves the next waypoint if it meets
    its condition, one waypoint a visit; the start serves none, the exit may serve the last. Of equally short walks
    the one with the smallest path counts. Walks may enter a node again in another state, so paths may cross themselves.

    The state is how many waypoints have been passed. Which ones a node can serve is a mask that is joined to the steps
    once; a level is the last level joined to the steps, one row per (seed, node, state). Taking a waypoint as early
    as possible never makes a walk longer, so a (node, state) is entered once.
    """
    if len(waypoints) > MOST_WAYPOINTS:
        raise ValueError(f"at most {MOST_WAYPOINTS} waypoints")
    work = Steps(g.nodes.sparkSession)
    serves = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(w, F.lit(False)), 1 << k).otherwise(0) for k, w in enumerate(waypoints)], F.lit(0))
    marks = g.nodes.select(F.col("id").alias("there"), serves.alias("mask"), F.coalesce(exits, F.lit(False)).alias("is_exit")).filter("mask <> 0 OR is_exit")
    steps, _ = work.write(oriented(g.edges, direction, kinds).distinct().join(marks, "there", "left").select("here", "there", F.coalesce("mask", F.lit(0)).alias("mask"), F.coalesce("is_exit", F.lit(False)).alias("is_exit")))
    level, told = work.write(start.select("seed", "node_id").distinct().select("seed", "node_id", F.lit(0).alias("state"), F.lit(0).alias("depth"), F.array("node_id").alias("path"), F.lit(False).alias("is_exit")))
    levels, depth = [level], 0
    while told["n"] and depth < max_depth:
        depth += 1
        last = small(level.select("seed", "node_id", F.col("state").alias("_state"), "path"), told["n"])
        state = F.col("_state") + F.when(F.expr("(mask >> _state) & 1") == 1, 1).otherwise(0)
        found = steps.join(last, F.col("node_id") == F.col("here")).select("seed", F.col("there").alias("node_id"), state.alias("state"), F.concat("path", F.array("there")).alias("path"), "is_exit")
        found = found.groupBy("seed", "node_id", "state").agg(F.min("path").alias("path"), F.first("is_exit").alias("is_exit"))
        seen = reduce(DataFrame.unionAll, [old.select("seed", "node_id", "state") for old in levels])
        new = found.join(seen, ["seed", "node_id", "state"], "left_anti").select("seed", "node_id", "state", F.lit(depth).alias("depth"), "path", "is_exit")
        level, told = work.write(new)
        levels.append(level)
    work.drop(steps)
    ends = reduce(DataFrame.unionAll, levels[1:] or levels).filter((F.col("state") == len(waypoints)) & F.col("is_exit"))
    best = ends.groupBy("seed", F.col("node_id").alias("exit_id")).agg(F.min(F.struct("depth", "path")).alias("b"))
    return best.select("seed", "exit_id", "b.depth", "b.path")

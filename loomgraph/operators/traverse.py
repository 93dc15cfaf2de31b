"""Breadth-first traversal from many seeds at once, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.lineage import Steps
from loomgraph.sources.model import Graph

if TYPE_CHECKING:
    from .adjacency import Adjacency

#: Rows of a table, counted when it was written, up to which it is broadcast: a few ids a row, so some megabytes.
BROADCAST_ROWS = 50_000


#: Levels whose visited pairs are read one by one before they are gathered in one table.
GATHER_AFTER = 6


#: Along edges, and against them.
DIRECTIONS = ("out", "in")


def union(tables: list[DataFrame | None], *columns: str) -> DataFrame:
    return reduce(DataFrame.unionAll, [t.select(*columns) for t in tables if t is not None])


def oriented(edges: DataFrame, direction: str = "out", kinds: Iterable[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(here, there[, keep]) for each step the direction ('out', 'in', 'both') and kinds allow. Kinds are filtered before anything is joined."""
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(list(kinds)))
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), *keep)
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"), *keep)
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.unionAll(back)
    raise ValueError(f"direction must be out, in or both, not {direction!r}")


def neighbours(edges: DataFrame, node: str, direction: str = "out", kinds: Iterable[str] | None = None) -> DataFrame:
    """Distinct neighbours; a neighbour counts if any of its parallel edges has one of the kinds."""
    return oriented(edges, direction, kinds).filter(F.col("here") == node).select(F.col("there").alias("node_id")).distinct()


def seeds(spark: SparkSession, ids: Iterable[str]) -> DataFrame:
    """Start nodes, each its own seed. They need not be nodes of the graph."""
    return spark.createDataFrame([(i, i) for i in dict.fromkeys(ids)], "seed string, node_id string")


def small(df: DataFrame, n: int) -> DataFrame:
    """df to be broadcast if its n rows, counted when it was written, are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class Written:
    """The steps that a direction and kinds allow, in no order, written when they are first needed: for a walk or two over edges that are not kept."""

    def __init__(self, edges: DataFrame, work: Steps) -> None:
        self.sparkSession, self.edges, self.work, self.tables = edges.sparkSession, edges, work, {}

    def beyond(self, level: DataFrame, n: int, direction: str = "out", kinds: Iterable[str] | None = None) -> DataFrame:
        """level (n rows with _here) and there, for each step from _here. Steps against edges are those along them, read from the other end."""
        stored = "out" if direction == "in" else direction
        if stored not in self.tables:
            self.tables[stored], _ = self.work.write(oriented(self.edges, stored, kinds))
        steps = self.tables[stored]
        if direction == "in":
            steps = steps.select(F.col("there").alias("here"), F.col("here").alias("there"))
        return steps.join(small(level, n), F.col("_here") == F.col("here")).drop("here")

    def drop(self) -> None:
        self.work.drop(*self.tables.values())


def bfs(edges: DataFrame | Adjacency, start: DataFrame, direction: str = "out", kinds: Iterable[str] | None = None, max_depth: int | None = None, target: str | None = None, paths: bool = False) -> DataFrame:
    """(seed, node_id, depth, parent_id[, path]) for all nodes within max_depth steps of start (seed, node_id).

    Seeds travel together: one job per level, whatever their number. The steps that edges allow are written once,
    without a shuffle, or lie in an Adjacency already. A level is the last level joined to the steps, less what the seed has visited, one row per (seed, node)
    with the smallest parent; it is counted while it is written to the shared folder. A last level, and what has been
    visited, is broadcast up to BROADCAST_ROWS rows, so the steps stay where they are and only what is new is dealt once;
    beyond that both sides are dealt by node. Pairs visited on many levels are gathered in one table now and then. Nodes that edges name but the
    graph lacks are visited too. The walk ends with an empty level, at max_depth, or once target is reached by any seed.
    """
    kinds = None if kinds is None else list(kinds)
    work = Steps(edges.sparkSession)
    columns = ["seed", "node_id", "depth", "parent_id"] + ["path"] * paths
    level = start.select("seed", "node_id").distinct().select("seed", "node_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_id"), F.array("node_id").alias("path"))
    there_yet = F.coalesce(F.bool_or(F.col("node_id") == F.lit(target)), F.lit(False))
    level, told = work.write(level.select(columns), met=there_yet)
    ways = edges if not isinstance(edges, DataFrame) else Written(edges, work)
    levels, depth, n_visited = [level], 0, told["n"]
    gathered, since = None, [level]
    while told["n"] and not told["met"] and (max_depth is None or depth < max_depth):
        depth += 1
        parent = F.struct("node_id", "path") if paths else F.struct("node_id")
        last = level.select("seed", F.col("node_id").alias("_here"), parent.alias("_parent"))
        found = ways.beyond(last, told["n"], direction, kinds).select("seed", F.col("there").alias("node_id"), "_parent")
        if len(since) > GATHER_AFTER:
            merged, _ = work.write(union([gathered, *since], "seed", "node_id"))
            work.drop(*([gathered] if gathered is not None else []))
            gathered, since = merged, []
        visited = union([gathered, *since], "seed", "node_id")
        if n_visited <= BROADCAST_ROWS:
            found = found.join(F.broadcast(visited), ["seed", "node_id"], "left_anti").groupBy("seed", "node_id").agg(F.min("_parent").alias("_parent"))
        else:
            found = found.groupBy("seed", "node_id").agg(F.min("_parent").alias("_parent")).join(visited, ["seed", "node_id"], "left_anti")
        new = found.select(
            "seed", "node_id", F.lit(depth).alias("depth"), F.col("_parent.node_id").alias("parent_id"), *([F.concat("_parent.path", F.array("node_id")).alias("path")] if paths else [])
        )
        level, told = work.write(new, met=there_yet)
        levels.append(level)
        since.append(level)
        n_visited += told["n"]
    if isinstance(ways, Written):
        ways.drop()
    work.drop(*([gathered] if gathered is not None else []))
    return reduce(DataFrame.unionAll, levels)


def from_node(g: Graph, node: str, direction: str = "out", kinds: Iterable[str] | None = None, max_depth: int | None = None, keep: Column | None = None, paths: bool = False) -> DataFrame:
    """bfs from one node. keep hides result rows (columns of nodes; rows without a node pass) but not what lies behind them."""
    spark = g.edges.sparkSession
    found = bfs(g.edges, seeds(spark, [node]), direction, kinds, max_depth, paths=paths).drop("seed")
    return visible(found, g.nodes, keep)


def visible(found: DataFrame, nodes: DataFrame, keep: Column | None) -> DataFrame:
    if keep is None:
        return found
    hidden = nodes.filter(~F.coalesce(keep, F.lit(False))).select(F.col("id").alias("node_id"))
    return found.join(hidden, "node_id", "left_anti").select(found.columns)


def shortest_path(g: Graph, a: str, b: str, kinds: Iterable[str] | None = None) -> DataFrame:
    """One row (node_id, depth, path array) if b can be reached from a along out-edges, none if not; [a] if they are equal."""
    from .meet import between  # which is built on this module

    return between(g.edges, a, b, kinds)


def can_reach(g: Graph, a: str, b: str, kinds: Iterable[str] | None = None) -> bool:
    return not shortest_path(g, a, b, kinds).isEmpty()


def impact_of(g: Graph, node: str, max_depth: int = 10) -> DataFrame:
    """What depends on the node, itself included."""
    return from_node(g, node, "in", max_depth=max_depth)


def depends_on(g: Graph, node: str, max_depth: int = 10) -> DataFrame:
    """What the node depends on, itself included."""
    return from_node(g, node, "out", max_depth=max_depth)


def dfs(g: Graph, node: str, direction: str = "out", kinds: Iterable[str] | None = None, max_depth: int | None = None, most_edges: int = 1_000_000) -> DataFrame:
    """(node_id, depth, position): depth-first pre-order, neighbours in order of id; a node first met at max_depth is not gone on from.

    The order is inherently serial: the reachable part of the graph comes to the driver, and more than most_edges edges are an error.
    """
    spark = g.edges.sparkSession
    reached = bfs(g.edges, seeds(spark, [node]), direction, kinds).select(F.col("node_id").alias("here"))
    rows = oriented(g.edges, direction, kinds).join(reached, "here", "left_semi").distinct().limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"more than {most_edges} edges can be reached; raise most_edges or use bfs")
    ahead: dict[str, list[str]] = {}
    for here, there in rows:
        ahead.setdefault(here, []).append(there)
    out, seen, stack = [], set(), [(node, 0)]
    while stack:
        at, depth = stack.pop()
        if at in seen:
            continue
        seen.add(at)
        out.append((at, depth, len(out)))
        if max_depth is None or depth < max_depth:
            stack += [(n, depth + 1) for n in sorted(ahead.get(at, ()), reverse=True) if n not in seen]
    return spark.createDataFrame(out, "node_id string, depth int, position int")

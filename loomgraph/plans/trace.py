"""Workflow traces: which steps lead from the entries to the exits of a flow."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.through import through
from loomgraph.operators.traverse import bfs
from loomgraph.sources.lineage import materialise
from loomgraph.sources.model import Graph


@dataclass(frozen=True)
class SubFlow:
    """Patterns are case-insensitive regular expressions over a node's names; tags are matched whole."""

    id: str
    name: str = ""
    entry_patterns: tuple[str, ...] = ()
    entry_tags: tuple[str, ...] = ()
    exit_patterns: tuple[str, ...] = ()
    exit_tags: tuple[str, ...] = ()
    edge_kinds: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    max_depth: int = 10
    #: Waypoints, in order: a flow passes through a node that matches each of these patterns.
    through: tuple[str, ...] = ()


@dataclass(frozen=True)
class Trace:
    id: str
    name: str = ""
    sub_flows: tuple[SubFlow, ...] = ()
    description: str = ""
    icon: str = ""
    extra: dict = field(default_factory=dict, compare=False)


def trace_from(d: dict) -> Trace:
    """A definition as users write it: with subFlows, or flat as one sub-flow of its own id."""
    parts = d.get("subFlows")
    if parts is None:
        parts = [{k: v for k, v in d.items() if k not in ("description", "icon")}]

    def sub(s: dict) -> SubFlow:
        listed = lambda k: tuple(s.get(k) or ())
        kinds, types = s.get("edgeKinds"), s.get("nodeTypes")
        return SubFlow(s.get("id", d["id"]), s.get("name", ""), listed("entryPatterns"), listed("entryTags"), listed("exitPatterns"), listed("exitTags"), tuple(kinds) if kinds else None, tuple(types) if types else None, int(s.get("maxDepth") or 10), listed("throughPatterns"))

    return Trace(d["id"], d.get("name", d["id"]), tuple(map(sub, parts)), d.get("description", ""), d.get("icon", ""))


def load_traces(path: str) -> list[Trace]:
    """User definitions of a JSON file; anything but an array of objects with ids counts as none."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return []
    return [trace_from(d) for d in found if isinstance(d, dict) and d.get("id")] if isinstance(found, list) else []


def merged(builtin: Iterable[Trace], user: Iterable[Trace]) -> list[Trace]:
    """User definitions replace built-in ones of the same id."""
    return list(({t.id: t for t in builtin} | {t.id: t for t in user}).values())


def matches(patterns: Iterable[str], tags: Iterable[str], types: Iterable[str] | None, columns: Iterable[str]) -> Column:
    """Type allowed, and any pattern found in the lower-cased names or any tag; without patterns and tags, nothing."""
    columns = set(columns)
    patterns, tags = list(patterns), list(tags)
    hit = F.lit(False)
    if patterns:
        text = F.lower(F.concat_ws(" ", *[c for c in ("name", "id", "qualified_name", "file_path", "kind") if c in columns]))
        hit = hit | text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    if tags and "tags" in columns:
        hit = hit | F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False))
    return hit if types is None else hit & F.col("type").isin(list(types))


def with_tags(nodes: DataFrame) -> DataFrame:
    """nodes with an array column tags, from the metadata's JSON where there is one."""
    if "tags" in nodes.columns:
        return nodes
    tags = F.from_json("metadata", "tags array<string>")["tags"] if "metadata" in nodes.columns else F.lit(None).cast("array<string>")
    return nodes.withColumn("tags", tags)


#: Steps of an entry that paths() puts in one row at most.
MOST_STEPS = 100_000


@dataclass(frozen=True)
class Traced:
    """What a set of sub-flows gives, as flat tables keyed by subflow_id and entry_id."""

    visits: DataFrame
    spans: DataFrame
    side: DataFrame

    def path_ends(self) -> DataFrame:
        """One row per entry: its number of steps, whether it reached an exit, the last step, and the first exit."""
        step = F.struct("depth", "node_id")
        ends = self.spans.groupBy("subflow_id", "entry_id").agg(F.count(F.lit(1)).alias("steps"), F.max("is_exit").alias("reached_exit"), F.max(step).alias("_last"), F.min(F.when(F.col("is_exit"), step)).alias("_exit"))
        return ends.select("subflow_id", "entry_id", "steps", "reached_exit", F.when(F.col("reached_exit"), F.col("_last.node_id")).alias("last_id"), F.col("_exit.node_id").alias("exit_id"))

    def paths(self, most: int = MOST_STEPS) -> DataFrame:
        """path_ends with the steps themselves, in order, as an array. An entry with more than `most` steps is an error; spans has them as rows."""
        ends = self.path_ends()
        longest = ends.agg(F.coalesce(F.max("steps"), F.lit(0))).first()[0]
        if longest > most:
            raise ValueError(f"an entry has {longest} steps, and a row takes {most} at most; use spans")
        step = F.struct("depth", "node_id", "name", "type", "is_exit")
        grouped = self.spans.groupBy("subflow_id", "entry_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
        return grouped.join(ends.drop("steps"), ["subflow_id", "entry_id"]).select("subflow_id", "entry_id", "steps", "reached_exit", "last_id", "exit_id")

    def stats(self) -> DataFrame:
        """One row per sub-flow with spans."""
        steps = self.spans.groupBy("subflow_id").agg(F.count(F.lit(1)).alias("total_steps"), F.count_distinct("file_path").alias("files_touched"), F.count_distinct("entry_id").alias("path_count"))
        complete = self.spans.groupBy("subflow_id", "entry_id").agg(F.max("is_exit").alias("r")).groupBy("subflow_id").agg(F.count_if("r").alias("complete_paths"))
        unique = self.visits.groupBy("subflow_id").agg(F.count_distinct("node_id").alias("unique_nodes"))
        roles = {"api_calls": "api", "store_accesses": "store", "secure_accesses": "secure", "dispatches": "dispatch"}
        sides = self.side.groupBy("subflow_id").agg(*[F.count_if(F.col("role") == r).alias(n) for n, r in roles.items()])
        out = steps.join(complete, "subflow_id").join(unique, "subflow_id").join(sides, "subflow_id", "left")
        return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in roles}).withColumn("status", F.when(F.col("complete_paths") > 0, "complete").otherwise("partial"))

    def narrative(self) -> DataFrame:
        """One line per node a sub-flow passes, where it is first met."""
        first = Window.partitionBy("subflow_id", "node_id").orderBy("depth", "entry_id")
        mark = F.when(F.col("is_entry"), "START ").otherwise("")
        end = F.when(F.col("is_exit"), " → END").otherwise("")
        via = F.when(F.col("is_entry"), "").otherwise(F.concat(F.lit(" via "), F.col("edge_kind")))
        rows = self.spans.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        return rows.select("subflow_id", "node_id", "depth", F.concat(mark, "type", F.lit(":"), "name", F.lit(" ("), "file_path", F.lit(")"), via, end).alias("line"))

    def roll_up(self, traces: Iterable[Trace]) -> DataFrame:
        """One row per trace: sums over its sub-flows, and the distinct files of all of them."""
        spark = self.spans.sparkSession
        of = spark.createDataFrame([(f"{t.id}/{s.id}", t.id) for t in traces for s in t.sub_flows], "subflow_id string, trace_id string")
        files = self.spans.join(F.broadcast(of), "subflow_id").groupBy("trace_id").agg(F.count_distinct("file_path").alias("files_touched"))  # a row per sub-flow defined
        sums = [F.sum(c).alias(c) for c in ("total_steps", "unique_nodes", "path_count", "complete_paths", "api_calls", "store_accesses", "secure_accesses", "dispatches")]
        return self.stats().drop("files_touched").join(F.broadcast(of), "subflow_id").groupBy("trace_id").agg(F.count(F.lit(1)).alias("sub_flows"), *sums).join(files, "trace_id")


def run(g: Graph, traces: Iterable[Trace]) -> Traced:
    """All sub-flows of all traces. Those that share edge kinds and depth walk together, each entry a seed of its own.

    Entries and exits are nodes the patterns or tags match; a span is a visited node of the graph, with the edge
    it was first reached by (the smallest by kind, line, label among those of the sub-flow's kinds).
    """
    nodes = with_tags(g.nodes)
    groups: dict[tuple, list[tuple[str, SubFlow]]] = {}
    for t in traces:
        for s in t.sub_flows:
            groups.setdefault((s.edge_kinds, s.max_depth), []).append((f"{t.id}/{s.id}", s))
    if not groups:
        spark = g.edges.sparkSession
        visits = spark.createDataFrame([], "subflow_id string, entry_id string, node_id string, depth int, parent_id string, kinds array<string>")
        exits = spark.createDataFrame([], "node_id string, subflow_id string")
    else:
        visits = reduce(DataFrame.unionAll, [_visits(g, nodes, kinds, depth, members) for (kinds, depth), members in groups.items()])
        exits = _ends(nodes, [m for members in groups.values() for m in members], lambda s: (s.exit_patterns, s.exit_tags)).withColumnRenamed("id", "node_id")
    visits = materialise(visits)
    spans = _spans(g, nodes, visits, exits)
    return Traced(visits, spans, _side(g, nodes, spans))


def through_flows(g: Graph, traces: Iterable[Trace]) -> DataFrame:
    """(subflow_id, entry_id, exit_id, depth, path): the shortest way from each entry to each exit of a sub-flow that passes all its waypoints in order.

    Waypoints may be nodes of any type. Sub-flows without waypoints have no row.
    """
    nodes = with_tags(g.nodes)
    named = Graph(nodes, g.edges)
    found = [g.nodes.sparkSession.createDataFrame([], "subflow_id string, entry_id string, exit_id string, depth int, path array<string>")]
    for t in traces:
        for s in t.sub_flows:
            if s.through:
                entries = nodes.filter(matches(s.entry_patterns, s.entry_tags, s.types, nodes.columns)).select(F.col("id").alias("seed"), F.col("id").alias("node_id"))
                ways = through(named, entries, [matches([p], [], None, nodes.columns) for p in s.through], matches(s.exit_patterns, s.exit_tags, s.types, nodes.columns), "out", s.edge_kinds, s.max_depth)
                found.append(ways.select(F.lit(f"{t.id}/{s.id}").alias("subflow_id"), F.col("seed").alias("entry_id"), "exit_id", "depth", "path"))
    return reduce(DataFrame.unionAll, found)


def _ends(nodes: DataFrame, flows: list[tuple[str, SubFlow]], of: Callable[[SubFlow], tuple]) -> DataFrame:
    """(id, subflow_id) of the nodes that the patterns and tags `of` a sub-flow match; one pass over the nodes for all sub-flows."""
    hits = [F.when(matches(*of(s), s.types, nodes.columns), key) for key, s in flows]
    return nodes.select("id", F.explode(F.array_compact(F.array(*hits))).alias("subflow_id"))


def _visits(g: Graph, nodes: DataFrame, kinds: tuple[str, ...] | None, depth: int, flows: list[tuple[str, SubFlow]]) -> DataFrame:
    """What the entries of sub-flows with the same edge kinds and depth reach."""
    entries = _ends(nodes, flows, lambda s: (s.entry_patterns, s.entry_tags))
    start = entries.select(F.concat_ws("\u0001", "subflow_id", "id").alias("seed"), F.col("id").alias("node_id"))
    parts = F.split("seed", "\u0001")
    listed = F.lit(None).cast("array<string>") if kinds is None else F.array(*map(F.lit, kinds))
    return bfs(g.edges, start, "out", kinds, depth).select(parts[0].alias("subflow_id"), parts[1].alias("entry_id"), "node_id", "depth", "parent_id", listed.alias("kinds"))


def _spans(g: Graph, nodes: DataFrame, visits: DataFrame, exits: DataFrame) -> DataFrame:
    """The visited nodes of the graph, each with the edge it was first reached by."""
    ways = visits.select("parent_id", "node_id", "kinds").filter("parent_id IS NOT NULL").distinct()
    e = g.edges.select(F.col("source").alias("parent_id"), F.col("target").alias("node_id"), "kind", "line", "label")
    via = ways.join(e, ["parent_id", "node_id"]).filter(F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind")))
    via = via.groupBy(F.col("parent_id").alias("_p"), F.col("node_id").alias("_n"), F.col("kinds").alias("_k")).agg(F.min(F.struct("kind", "line", "label")).alias("via"))
    reached = F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("node_id") == F.col("_n")) & F.col("kinds").eqNullSafe(F.col("_k"))
    shown = nodes.select(F.col("id").alias("node_id"), "name", "type", "file_path", "tags")
    first = F.col("depth") == 0
    return (
        visits.join(shown, "node_id")
        .join(via, reached, "left")
        .join(exits.distinct().withColumn("is_exit", F.lit(True)), ["node_id", "subflow_id"], "left")
        .select(
            "subflow_id", "entry_id", "node_id", "name", "type", "file_path", "depth",
            F.when(first, "entry").otherwise(F.col("via.kind")).alias("edge_kind"), F.col("via.label").alias("label"), F.col("via.line").alias("line"),
            first.alias("is_entry"), F.coalesce("is_exit", F.lit(False)).alias("is_exit"), "tags",
        )
    )


def _side(g: Graph, nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(subflow_id, entry_id, node_id, role, target, kind, label, line): what visited nodes call, store and dispatch, along edges of any kind."""
    tagged = with_tags(g.edges).select(F.col("source").alias("node_id"), "target", "kind", "label", "line", "tags")
    stores = nodes.filter("type = 'store'").select(F.col("id").alias("target"), F.lit(True).alias("to_store"))
    e = tagged.filter(F.col("kind").isin("api_call", "storage_access", "dispatches", "call", "references")).join(stores, "target", "left")
    secure = F.coalesce(F.arrays_overlap("tags", F.array(F.lit("auth-storage"), F.lit("secure-storage"))), F.lit(False))
    roles = F.array_compact(
        F.array(
            F.when(F.col("kind") == "api_call", "api"),
            F.when(F.col("kind") == "storage_access", "store"),
            F.when((F.col("kind") == "storage_access") & secure, "secure"),
            F.when(F.col("kind") == "dispatches", "dispatch"),
            F.when(F.col("kind").isin("call", "references") & F.coalesce("to_store", F.lit(False)), "store"),
        )
    )
    return spans.select("subflow_id", "entry_id", "node_id").join(e.withColumn("role", F.explode(roles)), "node_id").select("subflow_id", "entry_id", "node_id", "role", "target", "kind", "label", "line")

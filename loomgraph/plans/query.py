"""An immutable builder of traversals."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.traverse import bfs, visible
from loomgraph.sources.model import Graph


def _listed(x: str | Iterable[str]) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


@dataclass(frozen=True)
class Query:
    """Where to start, how to walk, what to show. Each method returns a changed copy.

    Starts are explicit ids, else the nodes of the given types, else all nodes. A walk passes through nodes that
    the filters hide; ends without a node are shown.
    """

    graph: Graph
    ids: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    kinds: tuple[str, ...] | None = None
    way: str = "out"
    max_depth: int | None = None
    filters: tuple[Column, ...] = ()
    edges_too: bool = False
    most: int | None = None

    def from_(self, *ids: str) -> Query:
        return replace(self, ids=tuple(ids))

    def from_many(self, ids: Iterable[str]) -> Query:
        return replace(self, ids=tuple(ids))

    def from_type(self, types: str | Iterable[str]) -> Query:
        return replace(self, types=_listed(types))

    def edge_kind(self, kinds: str | Iterable[str]) -> Query:
        return replace(self, kinds=_listed(kinds))

    def direction(self, way: str) -> Query:
        return replace(self, way=way)

    def depth(self, n: int) -> Query:
        return replace(self, max_depth=n)

    def where(self, predicate: Column | str | Callable) -> Query:
        """A condition over nodes: a Column, SQL text, or (slowly) a Python function of a row."""
        if callable(predicate) and not isinstance(predicate, Column):
            test = F.udf(lambda row: bool(predicate(row)), T.BooleanType())
            predicate = test(F.struct(*self.graph.nodes.columns))
        return replace(self, filters=(*self.filters, F.expr(predicate) if isinstance(predicate, str) else predicate))

    def exclude_type(self, types: str | Iterable[str]) -> Query:
        return self.where(~F.col("type").isin(list(_listed(types))))

    def include_edges(self) -> Query:
        return replace(self, edges_too=True)

    def limit(self, n: int | None) -> Query:
        return replace(self, most=n or None)

    def _starts(self) -> DataFrame:
        nodes = self.graph.nodes
        if self.ids:
            return nodes.sparkSession.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(self.ids))], "node_id string, ordinal long")
        if self.types:
            nodes = nodes.filter(F.col("type").isin(list(self.types)))
        return nodes.select(F.col("id").alias("node_id")).distinct()

    def run(self, mode: str = "nearest", paths: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
        """(node_id, depth[, path]), or that and the edges among it (of the kinds, if given) after include_edges().

        nearest: depth from the nearest start; all starts walk as one. first_start: depth from the start that
        comes first (as listed, or by id) among those that reach the node; each start walks on its own. Limited
        results are the first by depth, then id (after the start's place in first_start mode).
        """
        starts = self._starts()
        if mode == "nearest":
            found = bfs(self.graph.edges, starts.select(F.lit("").alias("seed"), "node_id"), self.way, self.kinds, self.max_depth, paths=paths)
            order = ["depth", "node_id"]
        else:
            found = bfs(self.graph.edges, starts.select(F.col("node_id").alias("seed"), "node_id"), self.way, self.kinds, self.max_depth, paths=paths)
            place = starts.select(F.col("node_id").alias("seed"), (F.col("ordinal") if "ordinal" in starts.columns else F.lit(0)).alias("ordinal"))
            rest = [c for c in found.columns if c not in ("seed", "node_id")]
            first = F.min(F.struct("ordinal", "seed", *rest)).alias("first")
            found = found.join(place, "seed").groupBy("node_id").agg(first).select("node_id", "first.*")
            order = ["ordinal", "seed", "depth", "node_id"]
        for condition in self.filters:
            found = visible(found, self.graph.nodes, condition)
        if self.most is not None:
            found = found.orderBy(*order).limit(self.most)
        found = found.select("node_id", "depth", *(["path"] if paths else []))
        return (found, self.induced(found)) if self.edges_too else found

    def induced(self, found: DataFrame) -> DataFrame:
        """Edges with both ends in the result."""
        edges = self.graph.edges if self.kinds is None else self.graph.edges.filter(F.col("kind").isin(list(self.kinds)))
        ids = found.select("node_id").distinct()
        return edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select(self.graph.edges.columns)


def dependencies(g: Graph, node: str, n: int = 10) -> Query:
    return Query(g).from_(node).direction("out").depth(n)


def dependents(g: Graph, node: str, n: int = 10) -> Query:
    return Query(g).from_(node).direction("in").depth(n)


def screen_to_service_flow(g: Graph) -> Query:
    return Query(g).from_type("screen").edge_kind(["import", "call", "jsx"]).depth(5).include_edges()


def api_flow(g: Graph) -> Query:
    return Query(g).edge_kind("api_call").depth(3).include_edges()


def component_tree(g: Graph) -> Query:
    return Query(g).from_type("component").edge_kind("jsx").depth(10).include_edges()

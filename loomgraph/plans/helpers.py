"""Named questions, maps, layers and views."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.traverse import from_node, oriented
from loomgraph.sources.model import EDGE_VIEWS, LAYERS, Graph


def _others(g: Graph, node: str, direction: str, kinds: Iterable[str] | None, depth: int) -> DataFrame:
    if depth == 1:  # one join, no loop
        near = oriented(g.edges, direction, kinds).filter((F.col("here") == node) & (F.col("there") != node))
        return near.select(F.col("there").alias("node_id"), F.lit(1).alias("depth")).distinct()
    return from_node(g, node, direction, kinds, depth).filter(F.col("node_id") != node).select("node_id", "depth")


def who_imports(g: Graph, node: str) -> DataFrame:
    return _others(g, node, "in", ["import"], 1)


def who_calls(g: Graph, node: str) -> DataFrame:
    return _others(g, node, "in", ["call", "references"], 1)


def who_uses_component(g: Graph, node: str) -> DataFrame:
    return _others(g, node, "in", ["jsx"], 1)


def who_calls_api(g: Graph, node: str) -> DataFrame:
    return _others(g, node, "in", None, 5)


def what_depends_on(g: Graph, node: str, depth: int = 3) -> DataFrame:
    """What the node leads to: along out-edges, whatever the name says."""
    return _others(g, node, "out", None, depth)


def api_calls_from(g: Graph, node: str) -> DataFrame:
    return _others(g, node, "out", ["api_call"], 5)


def components_used_by(g: Graph, node: str) -> DataFrame:
    return _others(g, node, "out", ["jsx"], 3)


#: Edges of a role that role_map puts in one row at most: some tens of megabytes.
MOST_EDGES = 100_000
Roles = dict[str, tuple[str, tuple[str, ...] | None]]
SCREENS: tuple[list[str], Roles] = (["screen"], {"imports": ("in", ("import",)), "used_in": ("in", ("jsx",)), "api_calls": ("out", ("api_call",))})
COMPONENTS: tuple[list[str], Roles] = (["component"], {"children": ("out", ("jsx",)), "parents": ("in", ("jsx",))})
APIS: tuple[list[str], Roles] = (["api", "endpoint"], {"callers": ("in", None), "calls": ("out", None)})


def _ways(roles: Roles) -> list[tuple[str, dict[str, Column], Column]]:
    """(column of the node, condition of each role on that side, any of them)."""
    out = []
    for way, column in (("in", "target"), ("out", "source")):
        fits = {r: F.lit(True) if kinds is None else F.col("kind").isin(list(kinds)) for r, (w, kinds) in roles.items() if w == way}
        if fits:
            out.append((column, fits, reduce(Column.__or__, fits.values())))
    return out


def role_edges(g: Graph, types: Iterable[str], roles: Roles) -> DataFrame:
    """(id, role, source, target, kind, label, line): each edge once per role that it has for a node of the types. A role is a direction and the kinds it takes (None: all)."""
    picked = g.nodes.filter(F.col("type").isin(list(types))).select("id")
    sides = []
    for column, fits, some in _ways(roles):
        role = F.explode(F.array_compact(F.array(*[F.when(f, r) for r, f in fits.items()])))
        sides.append(g.edges.filter(some).select(F.col(column).alias("id"), role.alias("role"), "source", "target", "kind", "label", "line"))
    return reduce(DataFrame.unionAll, sides).join(picked, "id", "left_semi")


def role_counts(g: Graph, types: Iterable[str], roles: Roles) -> DataFrame:
    """Nodes of the types with the number of edges per role, counted before they meet the nodes: a hub is one row."""
    picked = g.nodes.filter(F.col("type").isin(list(types)))
    out = picked
    for column, fits, some in _ways(roles):
        counted = g.edges.filter(some).groupBy(F.col(column).alias("_end")).agg(*[F.count_if(f).alias(r) for r, f in fits.items()])
        out = out.join(counted, F.col("id") == F.col("_end"), "left").drop("_end")
    return out.select(*picked.columns, *[F.coalesce(F.col(r), F.lit(0)).alias(r) for r in roles])


def role_map(g: Graph, types: Iterable[str], roles: Roles, most: int = MOST_EDGES) -> DataFrame:
    """Nodes of the types with a sorted array of edges per role.

    Edges are counted first; where a node has more than `most` in a role, that is an error: role_edges has them as rows, role_counts their number.
    """
    types = list(types)
    widest = role_counts(g, types, roles).agg(F.greatest(F.lit(0), *[F.coalesce(F.max(r), F.lit(0)) for r in roles])).first()[0]
    if widest > most:
        raise ValueError(f"a node has {widest} edges in a role, and a row takes {most} at most; use role_edges or role_counts")
    picked = g.nodes.filter(F.col("type").isin(types))
    edge = F.struct("source", "target", "kind", "label", "line")
    out = picked
    for column, fits, some in _ways(roles):
        own = g.edges.filter(some).withColumn("_end", F.col(column)).join(picked.select(F.col("id").alias("_end")), "_end", "left_semi")
        grouped = own.groupBy("_end").agg(*[F.sort_array(F.collect_list(F.when(f, edge))).alias(r) for r, f in fits.items()])
        out = out.join(grouped, F.col("id") == F.col("_end"), "left").drop("_end")
    return out.select(*picked.columns, *[F.coalesce(F.col(r), F.array().cast("array<struct<source:string,target:string,kind:string,label:string,line:int>>")).alias(r) for r in roles])


def screen_map(g: Graph) -> DataFrame:
    """imports are the edges of importers, as the question has always been answered."""
    return role_map(g, *SCREENS)


def component_map(g: Graph) -> DataFrame:
    return role_map(g, *COMPONENTS)


def api_map(g: Graph) -> DataFrame:
    return role_map(g, *APIS)


def data_flow(g: Graph, shape: Callable[..., DataFrame] = role_map) -> tuple[DataFrame, DataFrame]:
    """(stores with consumers, hooks with the stores they call and their consumers); shape role_counts gives their numbers."""
    stores = shape(g, ["store"], {"consumers": ("in", ("import", "call"))})
    of_store = g.edges.join(g.nodes.filter("type = 'store'").select(F.col("id").alias("target")), "target", "left_semi").select(g.edges.columns)
    uses = shape(g.with_edges(of_store), ["hook"], {"stores": ("out", ("call",))}).select(F.col("id").alias("_h"), "stores")
    hooks = shape(g, ["hook"], {"consumers": ("in", ("import",))}).join(uses, F.col("id") == F.col("_h")).drop("_h")
    return stores, hooks


def edge_view(g: Graph, view: str) -> DataFrame:
    return g.edges.filter(F.col("kind").isin(list(EDGE_VIEWS[view])))


def edge_view_counts(g: Graph) -> DataFrame:
    """(view, n): edges of each view, in one pass over the edges."""
    views = F.array_compact(F.array(*[F.when(F.col("kind").isin(list(kinds)), v) for v, kinds in EDGE_VIEWS.items()]))
    return g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.explode(views).alias("view"), "n").groupBy("view").agg(F.sum("n").alias("n"))


#: Node types and edge kinds of the viewer's views (fixed values).
VIEWS = {
    "all": (None, None),
    "architecture": (("screen", "component", "store", "service", "api", "endpoint"), ("import", "external", "call", "api_call")),
    "dependency": (("file", "screen", "component", "hook", "store", "service", "api", "package"), ("import", "external")),
    "component": (("component", "screen", "hook"), ("jsx", "contains")),
    "callgraph": (("function", "hook", "class", "store", "service", "api"), ("call", "references")),
    "apiflow": (("screen", "component", "hook", "service", "api", "endpoint"), ("api_call",)),
}


def view_filter(g: Graph, types: Iterable[str] | None, kinds: Iterable[str] | None) -> Graph:
    """Nodes of the types, and edges of the kinds between them; None takes all."""
    nodes = g.nodes if types is None else g.nodes.filter(F.col("type").isin(list(types)))
    ids = nodes.select("id")
    edges = g.edges if kinds is None else g.edges.filter(F.col("kind").isin(list(kinds)))
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(g.edges.columns)
    return Graph(nodes, edges)


def view(g: Graph, name: str) -> Graph:
    return view_filter(g, *VIEWS[name])


def find(g: Graph, term: str) -> DataFrame:
    """Nodes whose name, id, qualified name, path, kind or metadata has the term, whatever its case."""
    columns = [c for c in ("name", "id", "qualified_name", "file_path", "kind", "metadata") if c in g.nodes.columns]
    return g.nodes.filter(F.lower(F.concat_ws(" ", *columns)).contains(term.lower()))


def label_of(qualified_name: Column) -> Column:
    """What stands after the last ::, less a source file's extension."""
    return F.regexp_replace(F.element_at(F.split(qualified_name, "::"), -1), r"\.(js|jsx|ts|tsx)$", "")


def node_detail(g: Graph, node: str, shape: Callable[..., DataFrame] = role_map) -> DataFrame:
    """One row: the node, its incoming and outgoing edges, api calls (shape role_counts: their numbers), and its number of lines."""
    own = g.with_nodes(g.nodes.filter(F.col("id") == node)).with_edges(g.edges.filter((F.col("source") == node) | (F.col("target") == node)))
    types = [r.type for r in own.nodes.select("type").distinct().collect()]
    out = shape(own, types, {"incoming": ("in", None), "outgoing": ("out", None), "api_calls": ("out", ("api_call",))})
    return out.withColumn("n_lines", F.col("end_line") - F.col("start_line") + 1) if "end_line" in out.columns else out


def layers(g: Graph) -> DataFrame:
    """(layer, role, source, target, kind, label, line): each edge once per layer it touches, as internal, incoming or outgoing.

    Two joins give both ends a type; the split is then a projection.
    """
    types = g.nodes.filter(F.col("type").isin(list(LAYERS))).select("id", "type")
    ends = g.edges.join(types.select(F.col("id").alias("source"), F.col("type").alias("_from")), "source", "left").join(types.select(F.col("id").alias("target"), F.col("type").alias("_to")), "target", "left")
    roles = F.when(F.col("_from").eqNullSafe(F.col("_to")), F.array(F.struct(F.col("_from").alias("layer"), F.lit("internal").alias("role")))).otherwise(
        F.array(F.struct(F.col("_from").alias("layer"), F.lit("outgoing").alias("role")), F.struct(F.col("_to").alias("layer"), F.lit("incoming").alias("role")))
    )
    return ends.withColumn("_r", F.explode(roles)).select("_r.layer", "_r.role", *g.edges.columns).filter("layer IS NOT NULL")

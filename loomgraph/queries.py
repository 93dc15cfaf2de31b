"""The registered queries over the test tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import endpoint_id, file_id, package_id, route_id, symbol_id
from loomgraph.operators import adjacency, centrality, community, meet, metrics, search, structure, through, traverse, upsert
from loomgraph.operators.live_index import LiveIndex
from loomgraph.plans import helpers, query, trace
from loomgraph.plans.trace_catalog import builtin
from loomgraph.sources import projections
from loomgraph.sources.lineage import shared_folder
from loomgraph.sources.model import Graph

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STAR = """
WITH RECURSIVE nodes AS (
 
  SELECT 'region:' || r_regionkey AS id, 'file' AS type, r_name AS name, 'src/regions/' || (r_regionkey % 10) || '.js' AS file_path, 'region' AS kind, false AS is_exported
  FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'screen', n_name, 'src/nations/' || (n_nationkey % 10) || '.js', 'nation', false FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'component', c_name, 'src/customers/' || (c_custkey % 10) || '.js', 'customer', false FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'service', s_name, 'src/suppliers/' || (s_suppkey % 10) || '.js', 'supplier', false FROM supplier
 
  UNION ALL
  SELECT 'order:' || o_orderkey, 'hook', o_orderpriority, 'src/orders/' || (o_orderkey % 10) || '.js', 'order', o_orderstatus = 'F'
  FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'endpoint', p_name, 'src/parts/' || (p_partkey % 10) || '.js', 'part', false FROM part),
edges AS (
  SELECT 'region:' || n_regionkey AS source,
  'nation:' || n_nationkey AS target, 'contains' AS kind, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS INTEGER) AS line FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'jsx', NULL, NULL FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'import', NULL, NULL FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'call', NULL, NULL FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'api_call', max(l_returnflag), l_linenumber FROM lineitem
  GROUP BY l_orderkey, l_partkey, l_linenumber
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'external', CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM lineitem)
"""
METRICS = """, tin AS (SELECT target AS id, count(*) AS n FROM edges GROUP BY 1), tout AS (SELECT source AS id, count(*) AS n FROM edges GROUP BY 1),
deg AS (SELECT nodes.id, type, coalesce(tin.n, 0) AS fan_in, coalesce(tout.n, 0) AS fan_out,
  CASE
  WHEN coalesce(tin.n, 0) + coalesce(tout.n, 0) = 0 THEN 0.0 ELSE floor(coalesce(tout.n, 0) / CAST(coalesce(tin.n, 0) + coalesce(tout.n, 0) AS DOUBLE) * 1000 + 0.5) / 1000
  END AS instability
  FROM nodes LEFT JOIN tin USING (id) LEFT JOIN tout USING (id))
"""


EVENTS = """
WITH RECURSIVE ev AS (SELECT 'u' || user_id || ':' || event_type AS id, event_type AS type, user_id, ts, event_id FROM events),
nodes AS (SELECT DISTINCT id, type FROM ev),
edges AS (
  SELECT id AS source, nxt AS target, 'navigates_to' AS kind, CAST(event_id AS INTEGER) AS line
  FROM (SELECT *, lead(id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ev) WHERE nxt IS NOT NULL),
st AS (SELECT DISTINCT source AS here, target AS there FROM edges WHERE source <> target)
"""


def walk_sql(start: str, depth: int, direction: str = "out", kinds: tuple[str, ...] | None = None) -> str:
    """CTEs st (steps), w (all walks) and b (node_id, depth)."""
    where = "" if kinds is None else " WHERE kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"
    out, back = f"SELECT source AS here, target AS there FROM edges{where}", f"SELECT target AS here, source AS there FROM edges{where}"
    steps = {"out": out, "in": back, "both": f"{out} UNION {back}"}[direction]
    return f""", st AS (SELECT DISTINCT here, there FROM ({steps})),
w(node_id, depth) AS ({start} UNION SELECT st.there, w.depth + 1 FROM w JOIN st ON st.here = w.node_id WHERE w.depth < {depth}),
b AS (SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1)
"""


def one(node: str) -> str:
    return f"SELECT '{node}', 0"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- filters, lookups, counts ---------------------------------------------------------------------------------------

EDGE_COLUMNS = "source, target, kind, label, line"


def _star_edges(name: str, condition: str) -> None:
    register(name, STAR + f"SELECT {EDGE_COLUMNS} FROM edges WHERE {condition}")(lambda spark, sf: projections.star(spark, sf).edges.filter(condition))


def _star_nodes(name: str, condition: str) -> None:
    register(name, STAR + f"SELECT * FROM nodes WHERE {condition}")(lambda spark, sf: projections.star(spark, sf).nodes.filter(condition))


_star_nodes("node_lookup", "id = 'nation:7'")
_star_nodes("nodes_by_type", "type = 'service'")
_star_nodes("nodes_by_file", "file_path = 'src/orders/3.js'")
_star_nodes("exclude_types", "type NOT IN ('hook', 'endpoint')")


@register("node_search", STAR + "SELECT * FROM nodes WHERE lower(concat_ws(' ', name, id, file_path, kind)) LIKE '%urgent%'")
def node_search(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.find(projections.star(spark, sf), "URGENT")


_star_edges("edges_by_kind", "kind = 'call'")
_star_edges("out_edges", "source = 'nation:3'")
_star_edges("in_edges", "target = 'part:5'")
_star_edges("edges_between", "source = 'order:1' AND target LIKE 'part:%'")


@register("edge_views", STAR + """SELECT view, count(*) AS n FROM edges
  JOIN (VALUES ('dependency', 'import'), ('dependency', 'external'), ('component', 'jsx'), ('component', 'contains'), ('callgraph', 'call'), ('callgraph', 'references'), ('apiflow', 'api_call')) v(view, kind) USING (kind)
  GROUP BY view""")
def edge_views(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.edge_view_counts(projections.star(spark, sf))


def _views_sql() -> str:
    """Nodes and edges of each of the viewer's views."""
    parts = []
    for view, (types, kinds) in helpers.VIEWS.items():
        listed = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
        shown = "true" if types is None else f"type IN {listed(types)}"
        kind = "true" if kinds is None else f"kind IN {listed(kinds)}"
        ids = f"(SELECT id FROM nodes WHERE {shown})"
        parts.append(f"SELECT '{view}' AS view, (SELECT count(*) FROM nodes WHERE {shown}) AS nodes, (SELECT count(*) FROM edges WHERE {kind} AND source IN {ids} AND target IN {ids}) AS edges")
    return " UNION ALL ".join(parts)


@register("views", STAR + _views_sql())
def views(spark: SparkSession, sf: str) -> DataFrame:
    g = projections.star(spark, sf)
    parts = [metrics.counts(helpers.view(g, v)).select(F.lit(v).alias("view"), "nodes", "edges") for v in helpers.VIEWS]
    return reduce(DataFrame.unionAll, parts)


LABELS = "SELECT p_partkey, regexp_replace(list_last(string_split('src/' || p_brand || '::' || p_name || '.' || ['js', 'jsx', 'ts', 'tsx', 'css'][p_partkey % 5 + 1], '::')), '\\.(js|jsx|ts|tsx)$', '') AS label FROM part"


@register("label_projection", LABELS)
def label_projection(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ("js", "jsx", "ts", "tsx", "css"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    qualified = F.concat(F.lit("src/"), "p_brand", F.lit("::"), "p_name", F.lit("."), ending)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", helpers.label_of(qualified).alias("label"))


@register("view_filter", STAR + """SELECT source, target, kind FROM edges WHERE kind IN ('jsx', 'call') AND source IN (SELECT id FROM nodes
  WHERE type IN ('component', 'hook')) AND target IN (SELECT id FROM nodes WHERE type IN ('component', 'hook'))""")
def view_filter(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.view_filter(projections.star(spark, sf), ["component", "hook"], ["jsx", "call"]).edges.select("source", "target", "kind")


@register("stats_counts", STAR + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def stats_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counts(projections.star(spark, sf))


@register("node_type_hist", STAR + "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_hist(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(projections.star(spark, sf).nodes, "type")


@register("edge_kind_hist", STAR + "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_kind_hist(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(projections.star(spark, sf).edges, "kind")


@register("degree_metrics", STAR + METRICS + "SELECT id, fan_in, fan_out, instability FROM deg")
def degree_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.degrees(projections.star(spark, sf)).select("id", "fan_in", "fan_out", "instability")


@register("degree_metrics_events", EVENTS + METRICS + "SELECT id, fan_in, fan_out, instability FROM deg")
def degree_metrics_events(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.degrees(projections.events(spark, sf)).select("id", "fan_in", "fan_out", "instability")


@register("hotspots_topk", STAR + METRICS + "SELECT id, type, fan_in, fan_out FROM deg ORDER BY fan_in + fan_out DESC, id LIMIT 10")
def hotspots_topk(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.hotspots(projections.star(spark, sf)).select("id", "type", "fan_in", "fan_out")


@register("unstable_topk", STAR + METRICS + "SELECT id, instability FROM deg ORDER BY instability, id LIMIT 10")
def unstable_topk(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.unstable(projections.star(spark, sf)).select("id", "instability")


@register("unstable_topk_desc", STAR + METRICS + "SELECT id, instability FROM deg ORDER BY instability DESC, id LIMIT 10")
def unstable_topk_desc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.unstable(projections.star(spark, sf), descending=True).select("id", "instability")


# --- traversal ------------------------------------------------------------------------------------------------------


def _walk(name: str, node: str, depth: int, direction: str = "out", kinds: tuple[str, ...] | None = None, graph: Callable = projections.star, prefix: str = STAR) -> None:
    sql = prefix + walk_sql(one(node), depth, direction, kinds) + "SELECT node_id, depth FROM b"
    register(name, sql)(lambda spark, sf: traverse.from_node(graph(spark, sf), node, direction, kinds, depth).select("node_id", "depth"))


DANGLING = STAR.replace("'part', false FROM part)", "'part', false FROM part WHERE p_size <= 25)")
_walk("bfs_out", "region:0", 10)
_walk("bfs_in", "part:5", 10, "in")
_walk("bfs_both", "nation:1", 2, "both")
_walk("bfs_kind_filtered", "region:0", 10, "out", ("contains", "jsx", "call"))
_walk("bfs_dangling", "region:1", 10, graph=projections.star_dangling, prefix=DANGLING)
_walk("impact_of", "order:7", 10, "in")
_walk("depends_on", "customer:3", 10)


@register("bfs_node_filter", STAR + walk_sql(one("region:2"), 10) + "SELECT node_id, depth FROM b WHERE node_id NOT IN (SELECT id FROM nodes WHERE type = 'component')")
def bfs_node_filter(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.from_node(projections.star(spark, sf), "region:2", keep=F.col("type") != "component").select("node_id", "depth")


@register("bfs_events", EVENTS + """, u AS (SELECT min(id) AS id FROM nodes), w(node_id, depth) AS (SELECT id, 0 FROM u UNION
  SELECT st.there, w.depth + 1 FROM w JOIN st ON st.here = w.node_id WHERE w.depth < 6)
SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def bfs_events(spark: SparkSession, sf: str) -> DataFrame:
    g = projections.events(spark, sf)
    start = g.nodes.agg(F.min("id").alias("node_id")).select(F.lit("").alias("seed"), "node_id")
    return traverse.bfs(g.edges, start, max_depth=6).select("node_id", "depth")


# Shortest ways and their number for every pair, then for each node the pairs that it lies between.
BETWEEN = STAR + """, st AS (SELECT DISTINCT source AS here, target AS there FROM edges),
w(s, t, d) AS (SELECT here, there, 1 FROM st UNION ALL SELECT w.s, st.there, w.d + 1 FROM w JOIN st ON st.here = w.t WHERE w.d < 6),
p AS MATERIALIZED (SELECT s, t, min(d) AS d FROM w GROUP BY s, t), q AS MATERIALIZED (SELECT s, t, d, count(*) AS ways FROM w JOIN p USING (s, t, d) GROUP BY s, t, d),
sums AS (SELECT a.t AS id, sum(a.ways * b.ways / q.ways::DOUBLE) AS n FROM q a JOIN q b ON b.s = a.t JOIN q ON q.s = a.s AND q.t = b.t WHERE a.d + b.d = q.d GROUP BY a.t)
SELECT nodes.id, round(coalesce(n, 0), 6) AS betweenness FROM nodes LEFT JOIN sums USING (id)"""


@register("betweenness", BETWEEN)
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return centrality.betweenness(projections.star(spark, sf, repeated=True)).select("id", F.round("betweenness", 6).alias("betweenness"))


THROUGH = EVENTS + """, w(seed, node_id, state, depth) AS (SELECT id, id, 0, 0 FROM nodes WHERE type = 'view' UNION
  SELECT seed, there, state + CASE WHEN (state = 0 AND there LIKE '%:signup') OR (state = 1 AND there LIKE '%:click') THEN 1 ELSE 0 END, depth + 1 FROM w JOIN (SELECT DISTINCT source AS here, target AS there FROM edges) ON here = node_id WHERE depth < 6)
SELECT seed, node_id AS exit_id, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE state = 2 AND node_id LIKE '%:purchase' GROUP BY ALL"""


@register("through_waypoints", THROUGH)
def through_waypoints(spark: SparkSession, sf: str) -> DataFrame:
    """How soon each user who views comes to a purchase over a sign-up and then a click."""
    g = projections.events(spark, sf)
    start = g.nodes.filter("type = 'view'").select(F.col("id").alias("seed"), F.col("id").alias("node_id"))
    return through.through(g, start, [F.col("type") == "signup", F.col("type") == "click"], F.col("type") == "purchase", max_depth=6).select("seed", "exit_id", "depth")


@register("neighbours", STAR + "SELECT DISTINCT target AS node_id FROM edges WHERE source = 'nation:2'")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.neighbours(projections.star(spark, sf).edges, "nation:2")


PATH = """, par AS (SELECT st.there AS node_id, min(st.here) AS parent FROM st JOIN b p ON p.node_id = st.here
  JOIN b c ON c.node_id = st.there AND c.depth = p.depth + 1 GROUP BY 1),
up(node_id, path) AS (SELECT 'part:11', 'part:11' UNION ALL SELECT par.parent, par.parent || '->' || up.path FROM up
  JOIN par ON par.node_id = up.node_id)
"""


@register("shortest_path", STAR + walk_sql(one("region:3"), 10) + PATH + "SELECT b.depth, up.path FROM up, b WHERE up.node_id = 'region:3' AND b.node_id = 'part:11'")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.shortest_path(projections.star(spark, sf), "region:3", "part:11").select("depth", F.array_join("path", "->").alias("path"))


@register("can_reach", STAR + walk_sql(one("region:0"), 10) + "SELECT count(*) > 0 AS reachable FROM b WHERE node_id = 'part:1'")
def can_reach(spark: SparkSession, sf: str) -> DataFrame:
    g = projections.star(spark, sf)
    return spark.createDataFrame([(traverse.can_reach(g, "region:0", "part:1"),)], "reachable boolean")


KEPT = EVENTS + """, wo(seed, node_id, depth) AS (SELECT id, id, 0 FROM nodes WHERE type = 'view' UNION
  SELECT seed, there, depth + 1 FROM wo JOIN st ON here = node_id WHERE depth < 5),
wi(seed, node_id, depth) AS (SELECT id, id, 0 FROM nodes WHERE type = 'view' UNION
  SELECT seed, here, depth + 1 FROM wi JOIN st ON there = node_id WHERE depth < 5)
SELECT 'out' AS direction, seed, node_id, CAST(min(depth) AS INTEGER) AS depth FROM wo GROUP BY ALL
UNION ALL SELECT 'in', seed, node_id, CAST(min(depth) AS INTEGER) FROM wi GROUP BY ALL"""


@register("adjacency_walks", KEPT)
def adjacency_walks(spark: SparkSession, sf: str) -> DataFrame:
    """What each user does after and before viewing, from edges kept in buckets."""
    g = projections.events(spark, sf)
    kept = adjacency.Adjacency.build(g.edges)
    start = g.nodes.filter("type = 'view'").select(F.col("id").alias("seed"), F.col("id").alias("node_id"))
    walk = lambda d: traverse.bfs(kept, start, d, max_depth=5).select(F.lit(d).alias("direction"), "seed", "node_id", "depth")
    return walk("out").unionAll(walk("in"))


@register("adjacency_path", STAR + walk_sql(one("region:1"), 10) + PATH + "SELECT b.depth, up.path FROM up, b WHERE up.node_id = 'region:1' AND b.node_id = 'part:11'")
def adjacency_path(spark: SparkSession, sf: str) -> DataFrame:
    """A shortest path from both ends, over edges kept in buckets."""
    kept = adjacency.Adjacency.build(projections.star(spark, sf).edges)
    return meet.between(kept, "region:1", "part:11").select("depth", F.array_join("path", "->").alias("path"))


DFS = """, steps AS (SELECT DISTINCT source, target FROM edges),
p(node_id, path) AS (SELECT 'customer:1', ['customer:1'] UNION ALL SELECT s.target, list_append(p.path, s.target) FROM p
  JOIN steps s ON s.source = p.node_id),
f AS (SELECT node_id, min(path) AS path FROM p GROUP BY 1)
"""


# without cycles, a node's place is that of the first way to it in order of ids
@register("dfs_order", STAR + DFS + "SELECT node_id, CAST(len(path) - 1 AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS position "
    "FROM f")
def dfs_order(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.dfs(projections.star(spark, sf), "customer:1")


# --- structure ------------------------------------------------------------------------------------------------------

TOPO = ", lv(id, level) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT target FROM edges) UNION SELECT e.target, lv.level + 1 FROM lv JOIN (SELECT DISTINCT source, target FROM edges) e ON e.source = lv.id)\n"


@register("topo_levels", STAR + TOPO + "SELECT id, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY id")
def topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    return structure.topological_levels(projections.star(spark, sf))[0]


IS_ACYCLIC = f"""SELECT ({STAR} {TOPO} SELECT (SELECT count(DISTINCT lv.id) FROM lv JOIN nodes ON nodes.id = lv.id) = (SELECT count(*)
  FROM nodes)) AS star,
({EVENTS}, r(a, b) AS (SELECT here, there FROM st UNION SELECT r.a, st.there FROM r JOIN st ON st.here = r.b)
SELECT NOT EXISTS (SELECT 1 FROM r WHERE a = b) AND NOT EXISTS (SELECT 1 FROM edges WHERE source = target)) AS events"""


@register("is_acyclic", IS_ACYCLIC)
def is_acyclic(spark: SparkSession, sf: str) -> DataFrame:
    star, events = structure.topological_levels(projections.star(spark, sf))[1], structure.topological_levels(projections.events(spark, sf))[1]
    return spark.createDataFrame([(star, events)], "star boolean, events boolean")


REACH = ", r(a, b) AS (SELECT here, there FROM st UNION SELECT r.a, st.there FROM r JOIN st ON st.here = r.b)\n"


@register("scc_members", EVENTS + REACH + "SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS component FROM nodes n LEFT JOIN (SELECT r.a, r.b FROM r "
    "JOIN r q ON q.a = r.b AND q.b = r.a) x ON x.a = n.id GROUP BY n.id")
def scc_members(spark: SparkSession, sf: str) -> DataFrame:
    return structure.components(projections.events(spark, sf))


@register("cyclic_components", EVENTS + REACH + """, c AS (SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS component FROM nodes n LEFT
  JOIN (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a) x ON x.a = n.id GROUP BY n.id)
SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) > 1 OR component IN (SELECT source FROM edges WHERE source = target)""")
def cyclic_components(spark: SparkSession, sf: str) -> DataFrame:
    return structure.cyclic_sizes(projections.events(spark, sf))


@register("self_loops", EVENTS + "SELECT DISTINCT source AS id FROM edges WHERE source = target")
def self_loops(spark: SparkSession, sf: str) -> DataFrame:
    return structure.self_loops(projections.events(spark, sf))


@register("cycles_len2", EVENTS + "SELECT a.here AS n0, a.there AS n1 FROM st a JOIN st b ON a.there = b.here AND b.there = a.here WHERE a.here < a.there")
def cycles_len2(spark: SparkSession, sf: str) -> DataFrame:
    return structure.short_cycles(projections.events(spark, sf), 2)


@register("cycles_len3", EVENTS + "SELECT a.here AS n0, b.here AS n1, c.here AS n2 FROM st a JOIN st b ON a.there = b.here JOIN st c ON b.there = c.here "
    "AND c.there = a.here WHERE a.here < b.here AND a.here < c.here")
def cycles_len3(spark: SparkSession, sf: str) -> DataFrame:
    return structure.short_cycles(projections.events(spark, sf), 3)


@register("back_edge_cycles")
def back_edge_cycles(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.back_edge_cycles(projections.event_types(spark, sf))
    return spark.createDataFrame([(k, "->".join(c)) for k, c in enumerate(found)], "position int, cycle string")


@register("orphans", DANGLING + "SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges WHERE kind = 'jsx') AND id NOT IN (SELECT target "
    "FROM edges WHERE kind = 'jsx')")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    g = projections.star_dangling(spark, sf)
    return structure.orphans(g.with_edges(g.edges.filter("kind = 'jsx'"))).select("id")


@register("dead_code", STAR + "SELECT id FROM nodes WHERE type <> 'file' AND NOT is_exported AND id NOT IN (SELECT target FROM edges "
    "WHERE kind NOT IN ('call', 'jsx'))")
def dead_code(spark: SparkSession, sf: str) -> DataFrame:
    return structure.dead_code(projections.star(spark, sf), ignore_kinds=["call", "jsx"]).select("id")


# --- communities ----------------------------------------------------------------------------------------------------


def lpa_sql(rounds: int) -> str:
    sql = EVENTS + ", ties AS (SELECT here, there FROM st UNION SELECT there, here FROM st), l0 AS (SELECT id, id AS label FROM nodes)"
    for k in range(rounds):
        sql += f""", v{k} AS MATERIALIZED (SELECT t.here AS id, l.label, count(*) AS n FROM ties t JOIN l{k} l ON l.id = t.there GROUP BY 1, 2),
l{k + 1} AS MATERIALIZED (SELECT l.id, coalesce(c.label, l.label) AS label FROM l{k} l LEFT JOIN (SELECT id, label
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v{k}) WHERE r = 1) c USING (id))"""
    return sql + "\n"


@register("lpa_rounds_3", lpa_sql(3) + "SELECT id, label FROM l3")
def lpa_rounds_3(spark: SparkSession, sf: str) -> DataFrame:
    return community.label_rounds(projections.events(spark, sf), 3)


@register("community_sizes", lpa_sql(20) + "SELECT label, count(*) AS size FROM l20 GROUP BY label HAVING count(*) > 1")
def community_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return community.sizes(projections.events(spark, sf))


# --- query builder --------------------------------------------------------------------------------------------------

SCREENS = "SELECT id, 0 FROM nodes WHERE type = 'screen'"


def _induced(kinds: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"SELECT {EDGE_COLUMNS} FROM edges WHERE kind IN ({listed}) AND source IN (SELECT node_id FROM b) AND target IN (SELECT node_id FROM b)"


@register("qb_types_edges", STAR + walk_sql(SCREENS, 1, "out", ("jsx",)) + _induced(("jsx",)))
def qb_types_edges(spark: SparkSession, sf: str) -> DataFrame:
    return query.Query(projections.star(spark, sf)).from_type("screen").edge_kind("jsx").depth(1).include_edges().run()[1]


@register("qb_exclude_where_limit", STAR + walk_sql(one("nation:4"), 3) + "SELECT node_id, depth FROM b WHERE node_id NOT IN (SELECT id FROM nodes WHERE type = 'hook' OR name LIKE '%1') "
    "ORDER BY depth, node_id LIMIT 25")
def qb_exclude_where_limit(spark: SparkSession, sf: str) -> DataFrame:
    return query.Query(projections.star(spark, sf)).from_("nation:4").depth(3).exclude_type("hook").where("name NOT LIKE '%1'").limit(25).run()


@register("qb_first_start", STAR + walk_sql(one("customer:1"), 2).replace("b AS", "b1 AS") + """, w2(node_id, depth) AS (SELECT 'nation:0', 0
  UNION SELECT st.there, w2.depth + 1 FROM w2 JOIN st ON st.here = w2.node_id WHERE w2.depth < 2)
SELECT node_id, depth FROM b1 UNION ALL SELECT node_id, CAST(min(depth) AS INTEGER) FROM w2 WHERE node_id NOT IN (SELECT node_id FROM b1)
  GROUP BY 1""")
def qb_first_start(spark: SparkSession, sf: str) -> DataFrame:
    return query.Query(projections.star(spark, sf)).from_("customer:1", "nation:0").depth(2).run("first_start")


@register("qb_screen_flow", STAR + walk_sql(SCREENS, 5, "out", ("import", "call", "jsx")) + _induced(("import", "call", "jsx")))
def qb_screen_flow(spark: SparkSession, sf: str) -> DataFrame:
    return query.screen_to_service_flow(projections.star(spark, sf)).run()[1]


@register("qb_api_flow", STAR + f"SELECT {EDGE_COLUMNS} FROM edges WHERE kind = 'api_call' AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
def qb_api_flow(spark: SparkSession, sf: str) -> DataFrame:
    return query.api_flow(projections.star(spark, sf)).run()[1]


NESTED = STAR.replace("'screen', n_name", "'component', n_name")


def _nested(spark: SparkSession, sf: str) -> Graph:
    """The star with nations as components, which show those of their customers."""
    g = projections.star(spark, sf)
    return g.with_nodes(g.nodes.withColumn("type", F.when(F.col("kind") == "nation", "component").otherwise(F.col("type"))))


@register("qb_component_tree", NESTED + walk_sql("SELECT id, 0 FROM nodes WHERE type = 'component'", 10, "out", ("jsx",)) + _induced(("jsx",)))
def qb_component_tree(spark: SparkSession, sf: str) -> DataFrame:
    return query.component_tree(_nested(spark, sf)).run()[1]


def _kin(name: str, f: Callable, node: str, way: str) -> None:
    register(name, STAR + walk_sql(one(node), 10, way) + "SELECT node_id, depth FROM b")(lambda spark, sf: f(projections.star(spark, sf), node).run())


_kin("qb_dependencies", query.dependencies, "nation:9", "out")
_kin("qb_dependents", query.dependents, "part:8", "in")


# --- named questions ------------------------------------------------------------------------------------------------


def _question(name: str, f: Callable, node: str, depth: int, direction: str, kinds: tuple[str, ...] | None) -> None:
    sql = STAR + walk_sql(one(node), depth, direction, kinds) + f"SELECT node_id, depth FROM b WHERE node_id <> '{node}'"
    register(name, sql)(lambda spark, sf: f(projections.star(spark, sf), node))


_question("who_imports", helpers.who_imports, "supplier:1", 1, "in", ("import",))
_question("who_calls", helpers.who_calls, "order:5", 1, "in", ("call", "references"))
_question("who_uses_component", helpers.who_uses_component, "customer:9", 1, "in", ("jsx",))
_question("who_calls_api", helpers.who_calls_api, "part:3", 5, "in", None)
_question("what_depends_on", helpers.what_depends_on, "nation:5", 3, "out", None)
_question("api_calls_from", helpers.api_calls_from, "order:9", 5, "out", ("api_call",))
_question("components_used_by", helpers.components_used_by, "nation:6", 3, "out", ("jsx",))


def _roles_sql(types: str, roles: dict[str, str]) -> str:
    parts = ", ".join(f"(SELECT count(*) FROM edges e WHERE {c}) AS {r}" for r, c in roles.items())
    return STAR + f"SELECT n.id, {parts} FROM nodes n WHERE type IN ({types})"


@register("screen_map", _roles_sql("'screen'", {"imports": "e.target = n.id AND e.kind = 'import'", "used_in": "e.target = n.id AND e.kind = 'jsx'", "api_calls": "e.source = n.id AND e.kind = 'api_call'"}))
def screen_map(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.role_counts(projections.star(spark, sf), *helpers.SCREENS).select("id", "imports", "used_in", "api_calls")


@register("component_map", _roles_sql("'component'", {"children": "e.source = n.id AND e.kind = 'jsx'", "parents": "e.target = n.id AND e.kind = 'jsx'"}).replace(STAR, NESTED))
def component_map(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.role_counts(_nested(spark, sf), *helpers.COMPONENTS).select("id", "children", "parents")


@register("api_map", _roles_sql("'endpoint', 'api'", {"callers": "e.target = n.id", "calls": "e.source = n.id"}))
def api_map(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.role_counts(projections.star(spark, sf), *helpers.APIS).select("id", "callers", "calls")


def _stored(g: Graph) -> Graph:
    """The star with parts as stores that orders call."""
    nodes = g.nodes.withColumn("type", F.when(F.col("kind") == "part", "store").otherwise(F.col("type")))
    return Graph(nodes, g.edges.withColumn("kind", F.when(F.col("kind") == "api_call", "call").otherwise(F.col("kind"))))


@register("data_flow", STAR + """SELECT target AS id, 'store' AS part, count(*) AS n FROM edges WHERE kind = 'api_call' GROUP BY 1
UNION ALL SELECT source, 'hook', count(*) FROM edges WHERE kind = 'api_call' GROUP BY 1""")
def data_flow(spark: SparkSession, sf: str) -> DataFrame:
    stores, hooks = helpers.data_flow(_stored(projections.star(spark, sf)), helpers.role_counts)
    stores = stores.select("id", F.lit("store").alias("part"), F.col("consumers").alias("n"))
    return stores.unionAll(hooks.select("id", F.lit("hook"), "stores")).filter("n > 0")


@register("role_edges", STAR + """SELECT n.id, 'callers' AS role, e.source, e.target, e.kind FROM nodes n JOIN edges e ON e.target = n.id WHERE n.type IN ('endpoint', 'api')
UNION ALL SELECT n.id, 'calls', e.source, e.target, e.kind FROM nodes n JOIN edges e ON e.source = n.id WHERE n.type IN ('endpoint', 'api')""")
def role_edges(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.role_edges(projections.star(spark, sf), *helpers.APIS).select("id", "role", "source", "target", "kind")


@register("layers_split", STAR + """, t AS (SELECT a.type AS ft, b.type AS tt FROM edges LEFT JOIN nodes a ON a.id = source
  AND a.type <> 'file' LEFT JOIN nodes b ON b.id = target AND b.type <> 'file')
SELECT layer, role, count(*) AS n FROM (SELECT ft AS layer, 'internal' AS role FROM t WHERE ft = tt UNION ALL SELECT ft, 'outgoing' FROM t
  WHERE ft IS DISTINCT FROM tt UNION ALL SELECT tt, 'incoming' FROM t WHERE ft IS DISTINCT FROM tt) WHERE layer IS NOT NULL
  GROUP BY 1, 2""")
def layers_split(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.layers(projections.star(spark, sf)).groupBy("layer", "role").agg(F.count(F.lit(1)).alias("n"))


@register("node_detail", STAR + "SELECT id, (SELECT count(*) FROM edges WHERE target = 'order:4') AS incoming, (SELECT count(*) FROM edges "
    "WHERE source = 'order:4') AS outgoing, (SELECT count(*) FROM edges WHERE source = 'order:4' "
    "AND kind = 'api_call') AS api_calls FROM nodes WHERE id = 'order:4'")
def node_detail(spark: SparkSession, sf: str) -> DataFrame:
    return helpers.node_detail(projections.star(spark, sf), "order:4", helpers.role_counts).select("id", "incoming", "outgoing", "api_calls")


# --- search, text, ids ----------------------------------------------------------------------------------------------


def _bm25_sql(a: str, b: str) -> str:
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = '{a}')) AS f0, len(list_filter(t, lambda x: x = '{b}')) AS f1 FROM d),
s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c)
SELECT doc_id, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 0.000001) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 0.000001) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
FROM c, s WHERE f0 > 0 AND f1 > 0"""


@register("search_bm25", _bm25_sql("idiot", "the"))
def search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return search.search(docs, "idiot the", None, "doc_id", ("text",)).select("doc_id", F.round("score", 6).alias("score"))


ACCENTS = _bm25_sql("etre", "la")


@register("search_accents", ACCENTS)
def search_accents(spark: SparkSession, sf: str) -> DataFrame:
    """Accents of the query and of the texts do not count."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return search.search(docs, "être là", None, "doc_id", ("text",)).select("doc_id", F.round("score", 6).alias("score"))


def _indexed(spark: SparkSession, sf: str, query: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = search.Index.build(docs, shared_folder(spark, "index"), "doc_id", ("text",))
    return index.search(docs, query, None, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@register("search_indexed", _bm25_sql("idiot", "the"))
def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _indexed(spark, sf, "idiot the")


PHRASE = r"""SELECT doc_id FROM documents
WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the([^\p{L}\p{N}]|$)')
  AND NOT regexp_matches(strip_accents(lower(text)), '(^|[^\p{L}\p{N}])idio')"""


@register("search_phrase_not", PHRASE)
def search_phrase_not(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return search.search(docs, '"of the" NOT idio*', None, "doc_id", ("text",)).select("doc_id")


@register("search_indexed_phrase", PHRASE)
def search_indexed_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _indexed(spark, sf, '"of the" NOT idio*').select("doc_id")


@register("search_live", _bm25_sql("idiot", "the"))
def search_live(spark: SparkSession, sf: str) -> DataFrame:
    """An index that first got the languages for texts, and then the texts instead."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    index = LiveIndex(spark, shared_folder(spark, "live"), ("text",), "bigint")
    index.add(docs.select("doc_id", F.col("lang").alias("text")), "doc_id")
    index.add(docs.select("doc_id", "text"), "doc_id")
    return index.hits(spark, "idiot the", None, "bigint").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


PREFIX = r"""SELECT doc_id FROM documents WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\p{L}\p{N}])idio')"""


@register("search_indexed_prefix", PREFIX)
def search_indexed_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """A prefix, by the index's dictionary of terms."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = search.Index.build(docs, shared_folder(spark, "index"), "doc_id", ("text",))
    return index.hits(spark, "idio*", None, "bigint").select(F.col("id").alias("doc_id"))


TOP = _bm25_sql("of", "the").replace("round(greatest", "(greatest", 1).replace(", 6) AS score", ") AS raw")


@register("search_top50", f"SELECT doc_id, round(raw, 6) AS score FROM ({TOP}) ORDER BY raw DESC, doc_id LIMIT 50")
def search_top50(spark: SparkSession, sf: str) -> DataFrame:
    """A search as users ask it: the 50 best."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return search.search(docs, "of the", id_col="doc_id", columns=("text",)).select("doc_id", F.round("score", 6).alias("score"))


@register("search_like", STAR + "SELECT id FROM nodes WHERE name ILIKE '%#%7%'")
def search_like(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(projections.star(spark, sf).nodes, "#%7", None, columns=("name",)).select("id")


@register("postings", "SELECT term, doc_id, count(*) AS tf "
    "FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS term FROM documents) "
    "GROUP BY 1, 2")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", ("text",))


@register("href_extract", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def href_extract(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.col("html"), F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@register("page_graph_hist", "WITH h AS (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href "
    "FROM pages) SELECT 'external' AS kind, count(*) AS n FROM pages UNION ALL SELECT 'import', count(*) FROM h")
def page_graph_hist(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(projections.pages(spark, sf).edges, "kind")


@register("ids_md5", """SELECT p_partkey, substr(md5('src/' || p_brand || '::' || p_name), 1, 12) AS symbol,
  'f:' || substr(md5('src/' || p_brand), 1, 10) AS file, 'ep:' || substr(md5('GET:' || p_name), 1, 10) AS endpoint,
  'route:' || substr(md5(p_name), 1, 10) AS route, 'pkg:' || split_part('@' || p_type || '/x', '/', 1) AS package FROM part""")
def ids_md5(spark: SparkSession, sf: str) -> DataFrame:
    path, name = F.concat(F.lit("src/"), "p_brand"), F.col("p_name")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        "p_partkey", symbol_id(path, name).alias("symbol"), file_id(path).alias("file"), endpoint_id(F.lit("GET"), name).alias("endpoint"), route_id(name).alias("route"), package_id(F.concat(F.lit("@"), "p_type", F.lit("/x"))).alias("package")
    )


@register("pattern_select", STAR + "SELECT id FROM nodes WHERE type IN ('hook', 'component') "
    "AND regexp_matches(lower(concat_ws(' ', name, id, file_path, kind)), 'urgent|customer#0+1')")
def pattern_select(spark: SparkSession, sf: str) -> DataFrame:
    nodes = projections.star(spark, sf).nodes
    return nodes.filter(trace.matches(["URGENT", "customer#0+1"], [], ["hook", "component"], nodes.columns)).select("id")


# --- merges ---------------------------------------------------------------------------------------------------------


@register("upsert_edges_dedupe", "SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, max_by(l_returnflag, l_suppkey * 1000000 + l_quantity) AS label, l_linenumber AS line "
    "FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber")
def upsert_edges_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    edges = items.select(F.concat(F.lit("order:"), "l_orderkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target"), F.lit("api_call").alias("kind"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("line"), "l_suppkey", "l_quantity")
    return upsert.unique_edges(edges, F.col("l_suppkey") * 1000000 + F.col("l_quantity")).select("source", "target", "label", "line")


@register("upsert_last_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    return upsert.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@register("merge_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")
def merge_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    return upsert.merge(c, c.filter("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


REINDEX = "SELECT 'doc' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0"


@register("reindex_diff", REINDEX)
def reindex_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("doc"), "doc_id").alias("path"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    edited = F.when(F.col("doc_id") % 11 == 0, F.sha2("path", 256)).otherwise(F.col("content_hash"))
    return upsert.reindex_plan(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 7 <> 0").withColumn("content_hash", edited))


@register("delete_files", STAR + f", gone AS (SELECT id FROM nodes WHERE file_path = 'src/customers/4.js') SELECT {EDGE_COLUMNS} FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)")
def delete_files(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.without_files(projections.star(spark, sf), spark.createDataFrame([("src/customers/4.js",)], "path string")).edges


REPLACED = f"""{STAR}, gone AS (SELECT id FROM nodes WHERE file_path = 'src/customers/4.js')
SELECT {EDGE_COLUMNS} FROM edges WHERE source NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references', c_name, CAST(c_custkey AS INTEGER) FROM customer
  WHERE c_custkey % 20 = 4"""


@register("replace_file_edges", REPLACED)
def replace_file_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A file is indexed anew: half of its nodes are left, with other edges."""
    g = projections.star(spark, sf)
    again = spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 20 = 4")
    node = F.concat(F.lit("customer:"), "c_custkey")
    edges = again.select(
        node.alias("source"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"), F.lit("references").alias("kind"), F.col("c_name").alias("label"), F.col("c_custkey").cast("int").alias("line")
    )
    nodes = g.nodes.join(again.select(node.alias("id")), "id", "left_semi").select(g.nodes.columns)
    return upsert.replaced_files(g, spark.createDataFrame([("src/customers/4.js",)], "path string"), nodes, edges).edges


EDGES_ANEW = """SELECT source, target, label, line, count(*) AS n FROM (
  SELECT 'order:' || l_orderkey AS source,
  'part:' || l_partkey AS target, max_by(l_returnflag, l_suppkey * 1000000 + l_quantity) AS label, l_linenumber AS line
  FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_partkey, l_linenumber
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, l_returnflag, NULL FROM lineitem WHERE l_linenumber > 2) GROUP BY ALL"""


@register("upsert_edges_without_lines", EDGES_ANEW)
def upsert_edges_without_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Edges without a line never meet each other; those with one are the last of their key."""
    line = F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber"))
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    edges = items.select(
        F.concat(F.lit("order:"), "l_orderkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target"), F.lit("api_call").alias("kind"), F.col("l_returnflag").alias("label"),
        line.alias("line"), "l_suppkey", "l_quantity",
    )
    return upsert.unique_edges(edges, F.col("l_suppkey") * 1000000 + F.col("l_quantity")).groupBy("source", "target", "label", "line").agg(F.count(F.lit(1)).alias("n"))


# --- traces ---------------------------------------------------------------------------------------------------------

FLOW = trace.Trace("star", "Star", (trace.SubFlow("buy", "Buy", entry_patterns=("nation:[1-4]$", "nation:[1-4] "), exit_patterns=("1-urgent",), edge_kinds=("jsx", "call"), types=("screen", "hook"), max_depth=4),))
TRACE = STAR + """, en AS (SELECT id AS entry_id FROM nodes WHERE type = 'screen'
  AND id IN ('nation:1', 'nation:2', 'nation:3', 'nation:4')), ex AS (SELECT id FROM nodes WHERE type = 'hook'
  AND lower(name) LIKE '%1-urgent%'),
st AS (SELECT DISTINCT source AS here, target AS there FROM edges WHERE kind IN ('jsx', 'call')),
w(entry_id, node_id, depth) AS (SELECT entry_id, entry_id, 0 FROM en UNION SELECT w.entry_id, st.there, w.depth + 1 FROM w
  JOIN st ON st.here = w.node_id WHERE w.depth < 4),
b AS (SELECT entry_id, node_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2),
sp AS (SELECT b.*, n.type, n.file_path, b.node_id IN (SELECT id FROM ex) AS is_exit FROM b JOIN nodes n ON n.id = b.node_id)
"""


@register("trace_spans", TRACE + "SELECT entry_id, node_id, depth, CASE depth WHEN 0 THEN 'entry' WHEN 1 THEN 'jsx' ELSE 'call' END AS edge_kind, depth = 0 AS is_entry, is_exit "
    "FROM sp")
def trace_spans(spark: SparkSession, sf: str) -> DataFrame:
    return trace.run(projections.star(spark, sf), [FLOW]).spans.select("entry_id", "node_id", "depth", "edge_kind", "is_entry", "is_exit")


@register("trace_paths", TRACE + "SELECT entry_id, count(*) AS steps, bool_or(is_exit) AS reached_exit FROM sp GROUP BY entry_id")
def trace_paths(spark: SparkSession, sf: str) -> DataFrame:
    return trace.run(projections.star(spark, sf), [FLOW]).path_ends().select("entry_id", "steps", "reached_exit")


@register("trace_stats", TRACE + """SELECT count(*) AS total_steps, count(DISTINCT node_id) AS unique_nodes,
  count(DISTINCT file_path) AS files_touched, count(DISTINCT entry_id) AS path_count,
  count(DISTINCT entry_id) FILTER (is_exit) AS complete_paths,
(SELECT count(*) FROM sp JOIN edges ON source = node_id AND edges.kind = 'api_call') AS api_calls FROM sp""")
def trace_stats(spark: SparkSession, sf: str) -> DataFrame:
    return trace.run(projections.star(spark, sf), [FLOW]).stats().select("total_steps", "unique_nodes", "files_touched", "path_count", "complete_paths", "api_calls")


@register("trace_side_lists", TRACE + "SELECT sp.entry_id, sp.node_id, 'api' AS role, target, edges.line FROM sp JOIN edges ON source = node_id "
    "AND edges.kind = 'api_call'")
def trace_side_lists(spark: SparkSession, sf: str) -> DataFrame:
    return trace.run(projections.star(spark, sf), [FLOW]).side.select("entry_id", "node_id", "role", "target", "line")


@register("trace_narrative", TRACE + "SELECT node_id, "
    "CASE WHEN depth = 0 THEN 'START ' ELSE '' END || sp.type || ':' || nodes.name || ' (' || sp.file_path || ')' || CASE depth WHEN 0 THEN '' WHEN 1 THEN ' via jsx' ELSE ' via call' END || "
    "CASE WHEN is_exit THEN ' → END' ELSE '' END AS line FROM (SELECT *, row_number() OVER (PARTITION BY node_id "
    "ORDER BY depth, entry_id) AS r FROM sp) sp JOIN nodes ON nodes.id = node_id WHERE r = 1")
def trace_narrative(spark: SparkSession, sf: str) -> DataFrame:
    return trace.run(projections.star(spark, sf), [FLOW]).narrative().select("node_id", "line")


@register("trace_roll_up", TRACE + "SELECT 'star' AS trace_id, CAST(1 AS BIGINT) AS sub_flows, count(*) AS total_steps, count(DISTINCT file_path) AS files_touched "
    "FROM sp")
def trace_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    return trace.run(projections.star(spark, sf), [FLOW]).roll_up([FLOW]).select("trace_id", "sub_flows", "total_steps", "files_touched")


# orders lead to parts, which are stores here: calls of them count as store accesses
STORED = STAR.replace("'endpoint', p_name", "'store', p_name").replace("'api_call', max(l_returnflag)", "'call', max(l_returnflag)")
BUYS = trace.SubFlow("buys", "Buys", entry_patterns=("nation:[1-4]$", "nation:[1-4] "), exit_patterns=("1-urgent",), edge_kinds=("jsx", "call"), types=("screen", "hook"), max_depth=2)
SIDES = TRACE.replace(STAR, STORED).replace("w.depth < 4", "w.depth < 2")


@register("trace_store_accesses", SIDES + "SELECT sp.entry_id, sp.node_id, 'store' AS role, target, edges.line FROM sp JOIN edges ON source = node_id "
    "JOIN nodes n ON n.id = target AND n.type = 'store' WHERE edges.kind = 'call'")
def trace_store_accesses(spark: SparkSession, sf: str) -> DataFrame:
    found = trace.run(_stored(projections.star(spark, sf)), [trace.Trace("star", "Star", (BUYS,))])
    return found.side.select("entry_id", "node_id", "role", "target", "line")


CATALOG = """WITH n AS (SELECT 'part:' || p_partkey AS id, lower(p_name || ' part:' || p_partkey || ' src/parts/' || (p_partkey % 10) || '.js part') AS text
  FROM part)
SELECT flow, count(*) AS entries FROM (VALUES {values}) f(flow, pattern) JOIN n ON regexp_matches(text, pattern) GROUP BY flow"""


def _catalog_sql() -> str:
    """Entries of the built-in sub-flows among parts, whose names stand for code by their words."""
    rows = []
    for t in builtin():
        for f in t.sub_flows:
            if "endpoint" in f.types:
                pattern = "|".join(f"(?:{p.lower()})" for p in f.entry_patterns)
                rows.append(f"('{t.id}/{f.id}', '{pattern}')")
    return CATALOG.format(values=", ".join(rows)).replace("lower(p_name ||", f"lower({SPOKEN_SQL} ||")


WORDS = ("loginForm", "signOut", "useQuery", "payment", "forgotPassword", "useMutation", "tokenRefresh", "createAccount", "getData", "plain")
SPOKEN_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "][p_partkey % 10 + 1]"


@register("trace_catalog_entries", _catalog_sql())
def trace_catalog_entries(spark: SparkSession, sf: str) -> DataFrame:
    g = projections.star(spark, sf)
    parts = g.nodes.filter("kind = 'part'")
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.element_at(F.split("id", ":"), 2).cast("int") % 10 + 1))
    found = trace.run(Graph(parts.withColumn("name", word), g.edges.limit(0)), builtin())
    return found.spans.filter("is_entry").groupBy(F.col("subflow_id").alias("flow")).agg(F.count(F.lit(1)).alias("entries"))

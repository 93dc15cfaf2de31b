"""Counts and flat rows say what the arrays say, and arrays have a bound."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import community, structure
from loomgraph.plans import helpers, trace
from loomgraph.sources.model import Graph

TYPES = ("screen", "component", "api", "hook", "store")


def some_graph(spark, seed=1, n=20, m=60):
    rng = random.Random(seed)
    nodes = [(f"n{k}", rng.choice(TYPES), f"f{k}.js") for k in range(n)]
    edges = [(f"n{rng.randrange(n + 2)}", f"n{rng.randrange(n + 2)}", rng.choice(("import", "call", "jsx", "api_call")), None, k) for k in range(m)]
    return Graph(
        spark.createDataFrame([(i, t, i, f, i, "k") for i, t, f in nodes], "id string, type string, name string, file_path string, qualified_name string, kind string"),
        spark.createDataFrame(edges, "source string, target string, kind string, label string, line int"),
    )


@pytest.mark.parametrize("types, roles", [helpers.SCREENS, helpers.COMPONENTS, helpers.APIS])
def test_counts_and_rows_equal_arrays(spark, types, roles):
    g = some_graph(spark)
    arrays = {r.id: {k: [tuple(e) for e in r[k]] for k in roles} for r in helpers.role_map(g, types, roles).collect()}
    assert arrays and {r.id: {k: r[k] for k in roles} for r in helpers.role_counts(g, types, roles).collect()} == {i: {k: len(v) for k, v in a.items()} for i, a in arrays.items()}
    flat = sorted((r.id, r.role, r.line) for r in helpers.role_edges(g, types, roles).collect())
    assert flat == sorted((i, k, e[4]) for i, a in arrays.items() for k, v in a.items() for e in v)
    widest = max(len(v) for a in arrays.values() for v in a.values())
    helpers.role_map(g, types, roles, most=widest)
    with pytest.raises(ValueError, match="role_counts"):
        helpers.role_map(g, types, roles, most=widest - 1)


def test_other_nodes_may_be_wide(spark):
    g = some_graph(spark)
    hub = spark.createDataFrame([("n0", "hub", "call", None, k) for k in range(200)], g.edges.schema)
    g = g.with_edges(g.edges.unionAll(hub))
    assert helpers.role_map(g, *helpers.SCREENS, most=50).count() == g.nodes.filter("type = 'screen'").count()


def test_data_flow_and_details_in_numbers(spark):
    g = some_graph(spark, 2)
    number = lambda df, *c: {r.id: tuple(r[k] if isinstance(r[k], int) else len(r[k]) for k in c) for r in df.collect()}
    for whole, counted, columns in zip(helpers.data_flow(g), helpers.data_flow(g, helpers.role_counts), (("consumers",), ("stores", "consumers")), strict=True):
        assert number(whole, *columns) == number(counted, *columns)
    columns = ("incoming", "outgoing", "api_calls")
    assert number(helpers.node_detail(g, "n3"), *columns) == number(helpers.node_detail(g, "n3", helpers.role_counts), *columns)


def test_sizes_of_communities_and_cycles(spark):
    g = some_graph(spark, 3, 18, 24)
    assert {(r.label, r["size"]) for r in community.communities(g).collect()} == {(r.label, r["size"]) for r in community.sizes(g).collect()}
    assert {(r.component, len(r.members)) for r in structure.cyclic_components(g).collect()} == {(r.component, r["size"]) for r in structure.cyclic_sizes(g).collect()}


def test_ends_of_paths(spark):
    rows = [("s", "e1", 0, "a", False), ("s", "e1", 1, "c", True), ("s", "e1", 1, "b", True), ("s", "e1", 2, "d", False), ("s", "e2", 0, "x", False)]
    spans = spark.createDataFrame([(s, e, d, n, n, "t", x) for s, e, d, n, x in rows], "subflow_id string, entry_id string, depth int, node_id string, name string, type string, is_exit boolean")
    traced = trace.Traced(spans, spans, spans)
    assert sorted((r.entry_id, r.steps, r.reached_exit, r.last_id, r.exit_id) for r in traced.path_ends().collect()) == [("e1", 4, True, "d", "b"), ("e2", 1, False, None, None)]
    assert {r.entry_id: ([s.node_id for s in r.steps], r.last_id, r.exit_id) for r in traced.paths().collect()} == {"e1": (["a", "b", "c", "d"], "d", "b"), "e2": (["x"], None, None)}
    with pytest.raises(ValueError, match="spans"):
        traced.paths(3)
    assert traced.paths(4).agg(F.count(F.lit(1))).first()[0] == 2

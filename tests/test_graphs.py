"""Operators on tiny graphs, and against a plain model on random ones."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import community, metrics, search, structure, traverse, upsert
from loomgraph.plans import helpers, query
from loomgraph.sources.model import Graph


def graph(spark, edges, nodes=None, types=None):
    """edges: (source, target[, kind[, line]]); nodes default to all ends."""
    rows = [(e[0], e[1], e[2] if len(e) > 2 else "k", None, e[3] if len(e) > 3 else None) for e in edges]
    names = sorted({x for e in edges for x in e[:2]}) if nodes is None else nodes
    types = types or {}
    return Graph(
        spark.createDataFrame([(n, types.get(n, "function"), n, f"{n}.js", "k", False) for n in names], "id string, type string, name string, file_path string, kind string, is_exported boolean"),
        spark.createDataFrame(rows, "source string, target string, kind string, label string, line int"),
    )


def depths(df):
    return {r.node_id: r.depth for r in df.collect()}


def test_diamond(spark):
    g = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert depths(traverse.from_node(g, "a")) == {"a": 0, "b": 1, "c": 1, "d": 2}
    levels, acyclic = structure.topological_levels(g)
    assert acyclic and {r.id: r.level for r in levels.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert traverse.shortest_path(g, "a", "d").first().path == ["a", "b", "d"]
    assert traverse.shortest_path(g, "a", "a").first().path == ["a"]
    assert traverse.shortest_path(g, "d", "a").isEmpty() and not traverse.can_reach(g, "d", "a")
    assert [tuple(r) for r in traverse.dfs(g, "a").orderBy("position").collect()] == [("a", 0, 0), ("b", 1, 1), ("d", 2, 2), ("c", 1, 3)]


def test_cycle_with_tail(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert {r.id: r.component for r in structure.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert not structure.topological_levels(g)[1]
    assert structure.back_edge_cycles(g) == [["a", "b", "c"]]
    assert [r.members for r in structure.cyclic_components(g).collect()] == [["a", "b", "c"]]
    assert [tuple(r) for r in structure.short_cycles(g, 3).collect()] == [("a", "b", "c")]


def test_self_loop(spark):
    g = graph(spark, [("a", "a")], ["a", "b"])
    assert structure.back_edge_cycles(g) == [["a"]]
    assert [r.id for r in structure.orphans(g).collect()] == ["b"]
    assert [r.id for r in structure.self_loops(g).collect()] == ["a"]


def test_parallel_edges_and_degrees(spark):
    g = graph(spark, [("a", "b", "k", 1), ("a", "b", "k", 2), ("a", "b", "m", 1)])
    assert [r.node_id for r in traverse.neighbours(g.edges, "a", kinds=["m"]).collect()] == ["b"]
    assert {r.id: (r.fan_in, r.fan_out, r.instability) for r in metrics.degrees(g).collect()} == {"a": (0, 3, 1.0), "b": (3, 0, 0.0)}
    h = graph(spark, [(f"x{i}", "n") for i in range(15)] + [("n", "y")])
    assert metrics.degrees(h).filter("id = 'n'").first().instability == 0.063
    assert metrics.hotspots(h, 1).first().id == "n"


def test_unique_edges(spark):
    e = spark.createDataFrame([("a", "b", "k", "x", 7, 1), ("a", "b", "k", "y", 7, 2), ("a", "b", "k", "p", None, 3), ("a", "b", "k", "q", None, 4)], "source string, target string, kind string, label string, line int, seq int")
    assert sorted(r.label for r in upsert.unique_edges(e, F.col("seq")).collect()) == ["p", "q", "y"]


def test_dangling_and_filters(spark):
    g = graph(spark, [("a", "b"), ("a", "zz"), ("b", "c")], ["a", "b", "c"])
    assert depths(traverse.from_node(g, "a"))["zz"] == 1
    assert structure.topological_levels(g)[1]
    hidden = traverse.from_node(g, "a", keep=F.col("id") != "b")
    assert depths(hidden) == {"a": 0, "zz": 1, "c": 2}
    assert depths(traverse.from_node(g, "a", max_depth=1)) == {"a": 0, "b": 1, "zz": 1}
    assert depths(traverse.from_node(g, "nowhere")) == {"nowhere": 0}


def test_islands(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], ["a", "b", "c", "d", "e"])
    found = community.label_rounds(g)
    assert {r.id: r.label for r in found.collect()}["e"] == "e"
    assert {r.id for r in structure.orphans(g).collect()} == {"e"}


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert metrics.degrees(g).isEmpty() and structure.components(g).isEmpty() and community.communities(g).isEmpty()
    assert structure.topological_levels(g)[1] and structure.back_edge_cycles(g) == []


def test_query_is_immutable(spark):
    g = graph(spark, [("a", "b"), ("b", "c")], types={"a": "screen"})
    q = query.Query(g).from_type("screen")
    assert depths(q.depth(1).run()) == {"a": 0, "b": 1}
    assert depths(q.run()) == {"a": 0, "b": 1, "c": 2}
    assert depths(q.where(lambda row: row.name != "b").run()) == {"a": 0, "c": 2}
    found, edges = q.include_edges().run()
    assert edges.count() == 2
    with pytest.raises(ValueError):
        q.direction("sideways").run()


def test_helpers(spark):
    g = graph(spark, [("s", "h", "import"), ("p", "s", "import"), ("h", "st", "call"), ("p", "st", "import"), ("p", "s", "jsx")], types={"s": "screen", "h": "hook", "st": "store", "p": "component"})
    stores, hooks = helpers.data_flow(g)
    assert len(stores.first().consumers) == 2 and hooks.first().stores[0].target == "st"
    assert [r.node_id for r in helpers.who_imports(g, "s").collect()] == ["p"]
    assert {(r.layer, r.role) for r in helpers.layers(g).filter("kind = 'jsx'").collect()} == {("component", "outgoing"), ("screen", "incoming")}


def test_search(spark):
    rows = spark.createDataFrame([("1", "login screen", "a::login"), ("2", "screen", None), ("3", "Login_form login", "x")], "id string, name string, qualified_name string")
    ids = lambda q: [r.id for r in search.search(rows, q, columns=("name", "qualified_name")).collect()]
    assert set(ids("login")) == {"1", "3"}
    assert ids("login screen") == ["1"] and ids('"screen login"') == []
    assert set(ids("log* NOT screen")) == {"3"} and set(ids("form OR screen")) == {"1", "2", "3"}
    assert ids("qualified_name:login") == ["1"]
    assert ids("n_f%") == ["3"]  # no match expression: LIKE, where _ is any character
    assert ids("((") == []


def model_depths(edges, start, direction):
    near = {}
    for s, t, *_ in edges:
        if direction in ("out", "both"):
            near.setdefault(s, set()).add(t)
        if direction in ("in", "both"):
            near.setdefault(t, set()).add(s)
    found, todo = {start: 0}, deque([start])
    while todo:
        at = todo.popleft()
        for n in near.get(at, ()):
            if n not in found:
                found[n] = found[at] + 1
                todo.append(n)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_random_multigraphs(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    edges = [(r.choice(names), r.choice([*names, "gone"]), r.choice("km"), r.randrange(3)) for _ in range(14)]
    g = graph(spark, edges, names)
    way = ("out", "in", "both")[seed]
    assert depths(traverse.from_node(g, "n0", way)) == model_depths(edges, "n0", way)
    reach = {n: set(model_depths([e for e in edges if e[1] != "gone"], n, "out")) for n in names}
    expected = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}
    assert {x.id: x.component for x in structure.components(g).collect()} == expected
    levels, acyclic = structure.topological_levels(g)
    assert acyclic == all(len({m for m in names if m in reach[n] and n in reach[m]}) == 1 for n in names if True) or any(e[0] == e[1] for e in edges)
    place = {x.id: x.level for x in levels.collect()}
    assert all(place[s] < place[t] for s, t, *_ in edges if s in place and t in place)

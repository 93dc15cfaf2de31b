"""Betweenness, walks over waypoints, levels gathered in between, and bounded cycles against brute force."""

from __future__ import annotations

import collections
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import centrality, structure, through, traverse
from loomgraph.plans import trace
from loomgraph.sources.model import Graph


def graph(spark, edges, names=()):
    ids = sorted({n for e in edges for n in e[:2]} | set(names))
    nodes = spark.createDataFrame([(i, "function", i, "f.js", i, "function") for i in ids], "id string, type string, name string, file_path string, qualified_name string, kind string")
    rows = [(a, b, "call", None, 1, None) for a, b in edges]
    return Graph(nodes, spark.createDataFrame(rows, "source string, target string, kind string, label string, line int, metadata string"))


def some_edges(seed, n=14, m=30):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]


def ways(edges):
    """{(s, t): (length, number of shortest ways)} by breadth-first search."""
    ahead = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            ahead[a].add(b)
    out = {}
    for s in {n for e in edges for n in e}:
        level, seen, d = {s: 1}, {s}, 0
        while level:
            d += 1
            new = collections.Counter()
            for a, k in level.items():
                for b in ahead[a] - seen:
                    new[b] += k
            out |= {(s, b): (d, k) for b, k in new.items()}
            seen |= new.keys()
            level = new
    return out


def between(edges):
    w = ways(edges)
    out = collections.Counter({n: 0.0 for e in edges for n in e})
    for (s, t), (d, k) in w.items():
        for v in out:
            if v not in (s, t) and (s, v) in w and (v, t) in w and w[s, v][0] + w[v, t][0] == d:
                out[v] += w[s, v][1] * w[v, t][1] / k
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_equals_brute_force(spark, seed):
    edges = some_edges(seed) + [("n00", "n00"), ("n00", "n01"), ("n00", "n01")]
    g = graph(spark, edges, ["alone"])
    found = {r.id: r.betweenness for r in centrality.betweenness(g).collect()}
    expected = between(edges) | {"alone": 0.0}
    assert found == pytest.approx(expected)
    assert {r.id: r.betweenness for r in centrality.betweenness(g, sample=99).collect()} == pytest.approx(expected)
    n, k = len(expected), 6
    sampled = {r.id: r.betweenness for r in centrality.betweenness(g, sample=k).collect()}
    assert max(abs(sampled[i] - expected[i]) for i in expected) <= centrality.sample_error(n, k)


def test_betweenness_of_nothing(spark):
    g = graph(spark, [("a", "b")])
    assert {r.betweenness for r in centrality.betweenness(g).collect()} == {0.0}
    assert centrality.betweenness(g.with_nodes(g.nodes.limit(0))).isEmpty()


def walks(edges, starts, tests, is_exit, most):
    """{(seed, exit): (depth, smallest path)} over all walks."""
    ahead = collections.defaultdict(set)
    for a, b in edges:
        ahead[a].add(b)
    best, level = {}, [(s, 0, (s,)) for s in starts]
    for d in range(1, most + 1):
        states = {}
        for at, k, path in level:
            for b in ahead[at]:
                key = (path[0], b, k + (k < len(tests) and tests[k](b)))
                states[key] = min(states.get(key, path + (b,)), path + (b,))
        for (s, b, k), path in states.items():
            if k == len(tests) and is_exit(b) and (s, b) not in best:
                best[s, b] = (d, list(path))
        level = [(b, k, path) for (s, b, k), path in states.items()]
    return best


@pytest.mark.parametrize("seed", [3, 4])
def test_waypoints_equal_all_walks(spark, seed):
    edges = some_edges(seed, 10, 22)
    g = graph(spark, edges)
    starts = ["n00", "n01", "n02"]
    start = spark.createDataFrame([(s, s) for s in starts], "seed string, node_id string")
    ends = lambda *k: F.substring("id", 3, 1).isin(*map(str, k))
    tests = [lambda b: b[-1] in "34", lambda b: b[-1] in "356"]
    found = {(r.seed, r.exit_id): (r.depth, r.path) for r in through.through(g, start, [ends(3, 4), ends(3, 5, 6)], ends(5, 7, 8), max_depth=7).collect()}
    assert found == walks(edges, starts, tests, lambda b: b[-1] in "578", 7)
    none = {(r.seed, r.exit_id): r.depth for r in through.through(g, start, [], ends(7), max_depth=7).collect()}
    assert none == {k: d for k, (d, _) in walks(edges, starts, [], lambda b: b[-1] == "7", 7).items()}


def test_flows_pass_their_waypoints(spark, tmp_path):
    """throughPatterns of a user's definition; the short way around a waypoint is no way."""
    g = graph(spark, [("loginScreen", "home"), ("loginScreen", "authCheck"), ("authCheck", "storeToken"), ("storeToken", "home"), ("loginScreen", "storeToken")])
    (tmp_path / "t.json").write_text(json.dumps([{"id": "t", "entryPatterns": ["login"], "exitPatterns": ["^home"], "throughPatterns": ["auth", "token"], "edgeKinds": ["call"]}, {"id": "u", "entryPatterns": ["login"], "exitPatterns": ["home"]}]))
    traces = trace.load_traces(str(tmp_path / "t.json"))
    assert traces[0].sub_flows[0].through == ("auth", "token") and traces[1].sub_flows[0].through == ()
    found = trace.through_flows(g, traces).collect()
    assert [(r.subflow_id, r.entry_id, r.exit_id, r.depth, r.path) for r in found] == [("t/t", "loginScreen", "home", 3, ["loginScreen", "authCheck", "storeToken", "home"])]
    assert trace.through_flows(g, traces[1:]).isEmpty()


def test_long_chains_gather_levels(spark, monkeypatch):
    monkeypatch.setattr(traverse, "GATHER_AFTER", 2)
    monkeypatch.setattr(structure, "GATHER_AFTER", 2)
    chain = [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(11)] + [("c00", "c05"), ("c03", "c09"), ("c11", "c02")]
    g = graph(spark, chain)
    for most in (traverse.BROADCAST_ROWS, 0):
        monkeypatch.setattr(traverse, "BROADCAST_ROWS", most)
        found = {r.node_id: r.depth for r in traverse.bfs(g.edges, traverse.seeds(spark, ["c00"])).collect()}
        assert found == {"c00": 0} | {t: d for (s, t), (d, _) in ways(chain).items() if s == "c00"}
    acyclic = graph(spark, chain[:-1])
    levels, whole = structure.topological_levels(acyclic)
    longest = {}
    for k in range(12):
        name = f"c{k:02d}"
        longest[name] = max([longest[a] + 1 for a, b in chain[:-1] if b == name], default=0)
    assert whole and {r.id: r.level for r in levels.collect()} == longest
    levels, whole = structure.topological_levels(g)
    assert not whole and {r.id for r in levels.collect()} == {"c00", "c01"}


def test_cycles_are_bounded(spark):
    rings = [[f"r{k}{j}" for j in range(k + 2)] for k in range(4)]
    edges = [(r[j], r[(j + 1) % len(r)]) for r in rings for j in range(len(r))] + [("self", "self"), ("r00", "tail")]
    g = graph(spark, edges)
    some, n = structure.cycles(g, most=2)
    assert n == 5 and len(some) == 2
    assert {r.component: r["size"] for r in structure.cyclic_sizes(g).collect()} == {"r00": 2, "r10": 3, "r20": 4, "r30": 5, "self": 1}
    some, n = structure.cycles(g, most=3, most_edges=4)  # too many for the serial search
    assert n == 5 and some == [["r30", "r31", "r32"], ["r20", "r21", "r22"], ["r10", "r11", "r12"]]
    assert list(itertools.chain(*structure.cycles(graph(spark, [("a", "b")]))[0])) == []


def test_betweenness_keeps_only_pairs_that_lead_on(spark, monkeypatch):
    """Every (source, node) pair was written and met again on each level. Ends, most of a wide graph, make no pair now, and ids are written but once."""
    edges = [("a", f"b{i}") for i in range(4)] + [(f"b{i}", f"c{j}") for i in range(4) for j in range(60)] + [(f"c{j}", "gone") for j in range(3)] + [("a", "c7"), ("a", "c7")]
    rows = []
    write = centrality.Steps.write

    def counted(self, df, **values):
        found, told = write(self, df, **values)
        rows.append((set(df.columns), told["n"]))
        return found, told

    monkeypatch.setattr(centrality.Steps, "write", counted)
    g = graph(spark, edges)
    g = g.with_nodes(g.nodes.filter("id <> 'gone'"))
    found = {r.id: r.betweenness for r in centrality.betweenness(g).collect()}
    assert found == pytest.approx(between([e for e in edges if e[1] != "gone"]))
    assert sum(n for columns, n in rows if {"source", "node"} <= columns) < 60
    # and with steps dealt over more tasks than a shuffle has by default
    monkeypatch.setattr(centrality, "WAYS_A_TASK", 7)
    assert {r.id: r.betweenness for r in centrality.betweenness(g).collect()} == pytest.approx(found)

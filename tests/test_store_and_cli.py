"""The store's versions, discovery on awkward trees, the command line, the stream, the export, SQL functions."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.functions import sql, tags
from loomgraph.operators import community, structure, traverse
from loomgraph.plans import document, helpers
from loomgraph.sources import discover
from loomgraph.sources.extract import extract
from loomgraph.sources.model import Graph
from loomgraph.sources.store import POINTER, Store, read_document
from loomgraph.streaming.reindex import watch

ONE = [("a.js", "import { b } from './b';\nexport function go() { b() }"), ("b.js", "export function b() { go() }")]


def files(spark, rows=ONE):
    return spark.createDataFrame(rows, "path string, content string")


def write_tree(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_a_writer_that_stops_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    store.reindex(files(spark))
    before = sorted(r.id for r in store.graph().nodes.collect())
    more = files(spark, [*ONE, ("c.js", "function c() {}")])

    def stops(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # all tables are written, the new version is not named yet
        m.setattr(Store, "_publish", stops)
        with pytest.raises(KeyboardInterrupt):
            store.reindex(more)
    again = Store(spark, f"file://{tmp_path}/store")
    assert sorted(r.id for r in again.graph().nodes.collect()) == before
    assert again.reindex(more) == {"same": 2, "new": 1}
    assert {r.name for r in again.graph().nodes.filter("kind = 'function'").collect()} == {"go", "b", "c"}


def test_two_writers_cannot_both_win(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.reindex(files(spark))
    pointers = store._pointers()
    (tmp_path / "store" / f"{POINTER}{pointers[-1][0] + 1:012d}").write_text(json.dumps({"version": "v-other", "schema_version": 2}))
    late = Store(spark, f"file://{tmp_path}/store")
    late._pointers = lambda: pointers  # it began before the other had finished
    with pytest.raises(RuntimeError, match="another writer"):
        late._publish("v-late")


def test_old_versions_go_and_newer_schemas_are_refused(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for k in range(4):
        store.reindex(files(spark, [("a.js", f"function f{k}() {{}}")]))
    names = sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.endswith(".crc"))
    assert sum(n.startswith("v-") for n in names) == 2 and sum(n.startswith(POINTER) for n in names) == 2
    (tmp_path / "store" / f"{POINTER}{10**9:012d}").write_text(json.dumps({"version": "v-x", "schema_version": 99}))
    with pytest.raises(ValueError, match="schema version 99"):
        store.current()
    assert Store(spark, f"file://{tmp_path}/none").table("nodes").isEmpty()


def test_files_that_rules_leave_out_are_never_read(spark, tmp_path):
    root = tmp_path / "tree"
    write_tree(root, {"src/a.js": "a()", "src/[id].tsx": "b()", "src/{x}*?.js": "c()", "node_modules/m.js": "x()", "src/skip.test.js": "y()", "src/big.js": "z" * 500, ".hidden.js": "h()", "src/assets": "", "bad.js": b"ok(); // \xff\xfe\n"})
    os.chmod(root / "node_modules/m.js", 0)
    by = discover.Rules(exclude=("*.test.js",), max_file_size=400)
    found = discover.discover(spark, f"file://{root}", by)
    opened = {os.path.basename(p).replace("%5B", "[").replace("%5D", "]").replace("%7B", "{").replace("%7D", "}").replace("%3F", "?") for p in found.inputFiles()}
    assert opened == {"a.js", "[id].tsx", "{x}*?.js", ".hidden.js", "bad.js"} or opened == {"a.js", "[id].tsx", "{x}*?.js", "bad.js"}
    content = {r.path: r.content for r in found.collect()}
    assert content["bad.js"] == "ok(); // ��\n" and content["src/[id].tsx"] == "b()" and content["src/{x}*?.js"] == "c()"
    assert extract(found).nodes.filter("kind = 'file'").count() == len(content)
    counts = {r.reason: r.n for r in discover.exclusion_counts(spark, f"file://{root}", by).collect()}
    assert (counts["directory"], counts["rule"], counts["size"]) == (1, 1, 1)
    plain = {r.path for r in discover.discover(spark, f"file://{root}", discover.PLAIN).collect()}
    assert ".hidden.js" not in plain and "src/skip.test.js" in plain and "src/big.js" in plain
    assert discover.discover(spark, f"file://{root}", discover.Rules(only=("nothing",))).isEmpty()


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "project"
    write_tree(root, {
        "src/screens/Login.jsx": "import { send } from '../api/auth';\nexport const LoginScreen = () => { send(); nav.navigate('Home'); return <Form/> }",
        "src/api/auth.js": "export function send() { fetch('/login', { method: 'post' }); setToken() }\nfunction setToken() { localStorage.setItem('token', 1); send() }",
        "src/x.test.js": "nope()",
    })
    for name in ("ignore", "config", "traces"):
        assert cli.main([str(root), f"--init-{name}"], spark) == 0
    assert {discover.IGNORE_FILE, discover.CONFIG_FILE, discover.TRACES_FILE} <= {p.name for p in root.iterdir()}
    assert json.loads((root / discover.CONFIG_FILE).read_text())["onlyDirs"] == []
    capsys.readouterr()
    assert cli.main([str(root)], spark) == 0
    told = capsys.readouterr().out
    assert "2 files" in told and "Cycles: 1" in told and "Hotspots:" in told and "Orphans:" in told
    found = read_document(str(root / ".loomgraph" / "graph.json"))
    assert {n["name"] for n in found["nodes"]} >= {"LoginScreen", "send", "setToken", "Storage:token"} and found["stats"]["files"] == 2
    assert set(found) >= {"version", "generated_at", "views", "layers", "cycles", "communities", "hotspots", "traces"} and len(found["cycles"]) == 1
    assert {t["trace_id"] for t in found["traces"]} >= {"auth"}
    assert cli.main([str(root), "--stats-only", "--exclude", "*.jsx"], spark) == 0
    assert "1 files" in capsys.readouterr().out
    assert cli.main([str(root), "--only-dirs", "src", "--only", "src/**"], spark) == 0
    capsys.readouterr()
    assert cli.main([str(root), "--traces"], spark) == 0 and "auth:" in capsys.readouterr().out
    assert cli.main([str(root), "--trace", "auth"], spark) == 0
    told = capsys.readouterr().out
    assert "auth/auth-login" in told and "START" in told
    assert cli.main([str(root), "--trace", "none"], spark) == 1
    assert cli.main([str(tmp_path / "project/.loomgraph")], spark) == 1


def test_stream(spark, tmp_path):
    """Files arrive, change and go in batches; a restart continues."""
    source, store = str(tmp_path / "in"), Store(spark, f"file://{tmp_path}/store")

    def put(rows):
        spark.createDataFrame(rows, "path string, content string, seq long").coalesce(1).write.mode("append").parquet(source)
        query = watch(spark, source, store, str(tmp_path / "check"))
        assert query.awaitTermination(120) and query.exception() is None

    put([("a.js", "function a() { b() }", 1), ("b.js", "function old() {}", 2), ("b.js", "function b() {}", 3)])
    names = lambda: {r.name for r in store.graph().nodes.filter("kind = 'function'").collect()}
    assert names() == {"a", "b"}
    put([("a.js", None, 4), ("c.js", "function c() {}", 5)])
    assert names() == {"b", "c"} and {r.path for r in store.table("files").collect()} == {"b.js", "c.js"}
    put([("b.js", "function b2() {}", 6)])
    assert names() == {"b2", "c"}


def test_export_holds_stats(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.reindex(files(spark))
    store.export(f"file://{tmp_path}/out")
    rows = [(r.part, json.loads(r.row)) for r in spark.read.json(f"file://{tmp_path}/out").collect()]
    stats = next(r for part, r in rows if part == "stats")
    assert stats["files"] == 2 and stats["nodes"] == sum(p == "node" for p, _ in rows) and stats["edges"] == sum(p == "edge" for p, _ in rows)
    assert stats["by_type"]["function"] == 2 and stats["by_kind"]["call"] == 1 and stats["version"] == 2 and stats["exported_at"][:2] == "20"
    assert isinstance(next(r for p, r in rows if p == "node" and r["kind"] == "file")["metadata"], dict)


def test_documents_are_bounded(spark, monkeypatch):
    g = extract(files(spark))
    whole = document.build(g)
    assert {n["community"] for n in whole["nodes"]} >= {0} and whole["views"]["callgraph"]
    monkeypatch.setattr(document, "MOST_ROWS", 2)
    with pytest.raises(ValueError, match="Store.export"):
        document.build(g)


def graph(spark, edges, nodes):
    n = spark.createDataFrame([(i, "function", i, "f.js", "function", False) for i in nodes], "id string, type string, name string, file_path string, kind string, is_exported boolean")
    e = spark.createDataFrame([(a, b, "call", None, k) for k, (a, b) in enumerate(edges)], "source string, target string, kind string, label string, line int")
    return Graph(n, e)


def test_cycles_without_a_serial_search(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a")], "abcd")
    assert sorted(structure.back_edge_cycles(g)) == [["a", "b"], ["c"]]
    with pytest.raises(structure.TooManyEdges):
        structure.back_edge_cycles(g, most_edges=1)
    with pytest.raises(ValueError, match="more than 1 edges"):
        traverse.dfs(g, "d", most_edges=1)


@pytest.mark.parametrize("rows", [0, 50_000])
def test_walks_with_and_without_broadcasts(spark, monkeypatch, rows):
    import random

    monkeypatch.setattr(traverse, "BROADCAST_ROWS", rows)
    rng = random.Random(rows)
    names = [f"n{k}" for k in range(40)]
    edges = [(rng.choice(names), rng.choice([*names, "lost"])) for _ in range(90)]
    g = graph(spark, edges, names)
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    depth, level, todo = {"n0": 0}, 0, {"n0"}
    while todo:
        level += 1
        todo = {b for a in todo for b in ahead.get(a, ())} - set(depth)
        depth |= dict.fromkeys(todo, level)
    found = {r.node_id: r.depth for r in traverse.from_node(g, "n0").collect()}
    assert found == depth
    far = max(depth, key=lambda n: (depth[n], n))
    path = traverse.shortest_path(g, "n0", far).first().path
    assert len(path) == depth[far] + 1 and all(b in ahead[a] for a, b in zip(path, path[1:], strict=False))
    # levels of an acyclic graph with parallel edges and a dangling end
    acyclic = graph(spark, [(a, b) for a, b in edges if b != "lost" and int(a[1:]) < int(b[1:])] + [("n3", "lost")], names)
    into = {n: [] for n in names}
    for r in acyclic.edges.collect():
        if r.target != "lost":
            into[r.target].append(r.source)
    longest = {}
    for n in names:
        longest[n] = max((longest[a] + 1 for a in into[n]), default=0)
    levels, whole = structure.topological_levels(acyclic)
    assert whole and {r.id: r.level for r in levels.collect()} == longest
    assert not structure.topological_levels(g.with_edges(g.edges.unionByName(graph(spark, [("n1", "n2"), ("n2", "n1")], names).edges)))[1]


def test_components_of_chains_and_rings(spark):
    """A chain is all components of one; rings of different sizes and a figure of eight are one each."""
    chain = [(f"c{(k * 7) % 20:02d}", f"c{((k + 1) * 7) % 20:02d}") for k in range(19)]
    ring = [(f"r{k}", f"r{(k + 1) % 9}") for k in range(9)]
    eight = [("e1", "e2"), ("e2", "e1"), ("e2", "e3"), ("e3", "e2"), ("e3", "out")]
    nodes = [f"c{k:02d}" for k in range(20)] + [f"r{k}" for k in range(9)] + ["e1", "e2", "e3", "alone"]
    found = {r.id: r.component for r in structure.components(graph(spark, chain + ring + eight + [("c00", "r3"), ("r5", "e2")], nodes)).collect()}
    assert found == {n: n for n in nodes if n[0] in "ca"} | {f"r{k}": "r0" for k in range(9)} | {"e1": "e1", "e2": "e1", "e3": "e1"}
    assert {r.id: r.component for r in structure.components(graph(spark, [], ["x", "y"])).collect()} == {"x": "x", "y": "y"}


def test_label_rounds_are_those_asked_for(spark):
    """On two nodes the labels swap in every round, however early the loop may stop."""
    g = graph(spark, [("a", "b")], "ab")
    for rounds in (0, 1, 2, 3, 6, 7):
        found = {r.id: r.label for r in community.label_rounds(g, rounds).collect()}
        assert found == ({"a": "b", "b": "a"} if rounds % 2 else {"a": "a", "b": "b"})
    assert community.label_rounds(graph(spark, [], []), 5).isEmpty()


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    names = [n for _, _, listed in tags.ROLES for n in listed] + ["isAuthenticated", "setName", "myToken", "Zed", ""]
    df = spark.createDataFrame([(n, f"src/x/{n}.js", [n]) for n in names], "name string, path string, exports array<string>")
    rows = df.select(tags.roles(F.col("name")).alias("a"), F.expr("semantic_roles(name)").alias("b"), tags.file_type(F.col("path"), F.col("exports")).alias("c"), F.expr("node_type(path, exports)").alias("d"), helpers.label_of(F.col("path")).alias("e"), F.expr("label_of(path)").alias("g")).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.g for r in rows)
    assert spark.sql("SELECT glob_matches('a/b.test.js', '*.test.js') AS x").first().x

"""Source snippets, one per rule; discovery; the store."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import trace
from loomgraph.plans.trace_catalog import builtin
from loomgraph.sources import discover
from loomgraph.sources.extract import extract
from loomgraph.sources.jsfacts import facts
from loomgraph.sources.store import Store


def only(source, what, path="a.tsx"):
    return [f for f in facts(source, path) if f.what == what]


def test_imports_and_exports():
    found = only("import a, { b as c, d } from './x';\nimport * as n from '@s/p/q';\nimport 'side';\nimport type { T } from 't';\nimport('dyn');", "import")
    assert [(f.name, f.names) for f in found] == [("./x", ["default", "b", "d"]), ("@s/p/q", ["default"]), ("side", []), ("t", ["T"])]
    late = only("function f() {}\nexport { f };\nexport function g() {}\nexport default f", "function")
    assert [(f.name, f.exported) for f in late] == [("f", False), ("g", True)]


def test_functions_and_scopes():
    source = "export async function useX(a: number): Promise<{ y: number }> {\n  const go = async () => { inner(a) };\n  outer()\n}\nclass K { m() { lost() } }\nconst o = { m() { alsoLost() } }\ntop()"
    assert [(f.what, f.name, f.line, f.end_line, f.is_async) for f in facts(source, "a.ts") if f.what in ("function", "arrow")] == [("function", "useX", 1, 4, True), ("arrow", "go", 2, 2, True)]
    assert {f.name: f.caller for f in only(source, "call", "a.ts")} == {"inner": "go", "outer": "useX", "lost": None, "alsoLost": None, "top": None}


@pytest.mark.parametrize(
    "source",
    [
        "const a = 'f()'; const b = \"g()\"; // h()\n/* i() */",
        "const t = `no() ${1} no()`",
        "const r = /x() \"/g, s = 1 / 2 / 3",
        "const e = <p title=\"no()\">it's no() \"quoted\" {/* no() */}</p>",
        "new Made(1); if (x) {} for (;;) {} while (x) {}",
        "obj?.maybe()",
    ],
)
def test_no_spurious_calls(source):
    assert only(source, "call", "a.jsx") == []


def test_calls():
    f = {c.name: c for c in only("function f() { fetch('/x', { method: 'post' }); api.get(`/u/${id}/z`, { method: 'x' }); q({ type: 'ADD' }); w('k', 's') }", "call")}
    assert (f["fetch"].url, f["fetch"].method) == ("/x", "POST")
    assert f["get"].url == "/u/${…}/z" and f["get"].object == "api"
    assert f["q"].action == "ADD" and f["w"].arg == "k"


def test_broken_sources_end():
    for source in ("function (", "const a = `x ${", "<A b={", "class {", "export", "import {", "a = b => ", "}}}))", "/* x", "'abc", "const"):
        facts(source, "a.jsx")


SOURCES = [
    ("src/a.tsx", "import { b } from './x';\nimport S from '@scope/pkg/sub';\nimport * as z from './none';\nexport const Card = () => { b(); run(); nav.navigate('Home'); return <Stack.Screen name=\"Home\"><Row/></Stack.Screen> }\nclass E extends React.Component { componentDidCatch() {} }\nlet n = process.env.KEY"),
    ("src/x/index.js", "export function b() { localStorage.setItem('token', 1); useAuth(); socket.emit('m'); d.dispatch({ type: 'GO' }) }\nexport function b() { second() }"),
]


def source_files(spark, rows=SOURCES):
    return spark.createDataFrame(rows, "path string, content string")


def test_extract(spark):
    g = extract(source_files(spark))
    nodes = {(r.kind, r.name): r for r in g.nodes.collect()}
    assert nodes["component", "Card"].is_exported and nodes["variable", "n"].metadata == '{"tags":["env-var"],"envKey":"KEY"}'
    assert json.loads(nodes["class", "E"].metadata)["tags"] == ["react-component", "error"]
    assert nodes["function", "b"].start_line == 2  # the last of a file's equal names
    assert {"package", "route", "storage-key", "event"} <= {k for k, _ in nodes}
    edges = [(r.kind, r.label) for r in g.edges.collect()]
    assert ("import", "b") in edges and ("external", "default") in edges and ("jsx", "<Row />") in edges
    kinds = {k for k, _ in edges}
    assert {"navigates_to", "defines_route", "storage_access", "emits_event", "dispatches", "extends", "contains", "call"} <= kinds
    across = extract(source_files(spark, [("a.js", "import { help } from './b';\nfunction f() { help() }"), ("b.js", "export function help() {}")]), resolve=True)
    ids = {r.id for r in across.nodes.collect()}
    assert across.edges.filter("kind = 'call'").first().target in ids


def test_globs():
    import re

    hit = lambda glob, path, **k: bool(re.search(discover.glob_regex(glob, **k), path))
    assert hit("*.test.js", "a/b.test.js") and not hit("*.test.js", "a/b.test.jsx")
    assert hit("/lib/", "lib/a.js") and not hit("/lib/", "x/lib/a.js") and hit("lib/", "x/lib/a.js")
    assert hit("src/**/x.js", "src/x.js") and hit("src/**/x.js", "src/a/b/x.js") and not hit("src/*.js", "src/a/x.js")
    assert hit("a?c.js", "abc.js") and hit("ABC.js", "abc.js") and hit("*.test.js", "a.test.jsx", loose=True)
    assert discover.ignore_lines("# c\n\n*.x\n!keep.x\n") == (["*.x"], ["keep.x"])


def test_discovery_and_store(spark, tmp_path):
    root = tmp_path / "project"
    for name, text in {**dict(SOURCES), "node_modules/m.js": "x()", "src/skip.test.js": "", "src/.hid/h.js": "", "big.js": "x" * 300, "types.d.ts": "", "a.txt": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / discover.IGNORE_FILE).write_text("*.test.js\n")
    (root / discover.CONFIG_FILE).write_text(json.dumps({"excludeExtensions": [".d.ts"], "maxFileSize": 5000}))
    by = discover.rules(str(root), max_file_size=299 + 300)
    found = discover.discover(spark, f"file://{root}", discover.rules(str(root), max_file_size=299))
    names = sorted(r.path for r in found.collect())
    assert "node_modules/m.js" not in names and "src/skip.test.js" not in names and "types.d.ts" not in names and "big.js" not in names
    found = discover.discover(spark, f"file://{root}", by).cache()
    assert sorted(r.path for r in found.collect()) == ["big.js", "src/a.tsx", "src/x/index.js"]
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.reindex(found) == {"new": 3}
    before = sorted(map(str, store.graph().edges.collect()))
    assert store.reindex(found) == {"same": 3} and sorted(map(str, store.graph().edges.collect())) == before
    (root / "src/x/index.js").write_text("export function other() {}")
    (root / "big.js").unlink()
    found.unpersist()
    changed = discover.discover(spark, f"file://{root}", by)
    assert store.reindex(changed) == {"same": 1, "changed": 1, "removed": 1}
    fresh = extract(changed)
    assert sorted(r.id for r in store.graph().nodes.collect()) == sorted(r.id for r in fresh.nodes.collect())
    assert sorted((r.source, r.target, r.kind) for r in store.graph().edges.collect()) == sorted((r.source, r.target, r.kind) for r in fresh.edges.collect())


def test_traces(spark, tmp_path):
    traces = builtin()
    assert len(traces) == 15 and sum(len(t.sub_flows) for t in traces) == 24
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"id": "auth", "entryPatterns": ["card"], "exitPatterns": ["route"], "edgeKinds": ["navigates_to"]}, 3]))
    merged = trace.merged(traces, trace.load_traces(str(path)))
    own = next(t for t in merged if t.id == "auth")
    assert len(merged) == 15 and own.sub_flows[0].edge_kinds == ("navigates_to",)
    assert trace.load_traces(str(tmp_path / "none")) == []
    found = trace.run(extract(source_files(spark)), [own])
    assert found.stats().first().complete_paths == 1
    assert any("→ END" in r.line for r in found.narrative().collect())
    assert trace.run(extract(source_files(spark)), []).spans.isEmpty()


def test_only_what_is_asked_is_read(spark):
    """Edges and nodes asked for alone equal those of the whole graph; facts of other kinds are not read."""
    from loomgraph.sources import extract as e

    text = """import a, { b as c } from './m';
export const Login = async (p) => { fetch('/login'); nav.navigate('Home'); c(p); return <Stack.Screen name="S"/>; };
function helper() { useAuth(); } function helper() { useForm(); }
class Box extends React.Component { componentDidCatch() {} }
const env = process.env.KEY; socket.emit('x');"""
    files = spark.createDataFrame([("src/a.tsx", text), ("src/m.js", "export const b = () => helper();"), ("src/empty.js", ""), ("src/none.js", None)], "path string, content string")
    whole = e.extract(files)
    rows = lambda df: sorted(map(repr, df.collect()))
    declared = (*e.DECLARED, "component", "hook")
    assert rows(e.file_nodes(files)) == rows(whole.nodes.filter("kind = 'file'"))
    assert rows(e.symbol_nodes(files)) == rows(whole.nodes.filter(F.col("kind").isin(*declared)))
    assert rows(e.made_nodes(files)) == rows(whole.nodes.filter(F.col("kind").isin(*e.MADE_KINDS)))
    for kinds in (("contains",), ("extends", "import"), ("call", "jsx"), ("navigates_to", "defines_route"), ("external", "api_call")):
        assert rows(e.file_edges(files, kinds)) == rows(whole.edges.filter(F.col("kind").isin(*kinds)))
    read = e.read_facts(files, ("import",))
    assert {r.what for r in read.collect()} == {"import"} and "url" not in read.columns


def test_rows_in_few_partitions_are_spread(spark):
    from loomgraph.sources.extract import spread

    few = spark.range(100, numPartitions=1)
    assert spread(few, "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(few, "id").count() == 100


def test_stems_change_no_tag(spark):
    """Stems only tell where no expression can match: names and texts in and beyond ASCII."""
    from loomgraph.functions import tags

    words = ["login", "LOGIN", "login\n", "toKen", "token", "Ktoken", "setx", "set", "action", "actions", "socket.io", "socketxio", "createContext (", "t(", "ſso", "plain", "", None, "process.env", "processXenv", "updateé"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    whole = F.coalesce("w", F.lit(""))
    plain = lambda patterns: F.array_compact(F.array(*[F.when(whole.rlike(p), t) for t, p in patterns]))
    text = [(t, "(?i)" + "|".join(p)) for t, p in tags.FILE_TEXT.items()]
    found = df.select(tags.roles(F.col("w")), plain(tags.role_patterns().items()), tags.found(F.col("w"), tags.FILE_TEXT), plain(text)).collect()
    assert all(a == b and c == d for a, b, c, d in found)

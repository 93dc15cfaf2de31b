"""What the fact reader reads for a question, and that it tells the same as when it reads all."""

import re

from loomgraph.functions import tags
from loomgraph.sources import extract
from loomgraph.sources.jsfacts import IMPORTS, facts, tokenize

REST = "\n".join(f"export const f{i} = async (a) => {{ call{i}(`x${{a}}`, 'y'); return <Row name=\"{i}\"/>; }};" for i in range(200))
SOURCES = [
    'import a, { b as c } from "./m";\nimport * as ns from "p/q";\n' + REST,
    "import a from './m'\nimport './side'\n" + REST,
    REST + '\nimport late from "late";\n' + REST,
    'import a from "m"; // unimportant\nconst s = "import x from \'y\'; "; ' + REST,
    "declare module 'x' { import { y } from \"z\"; interface A { b: import('c').D; e(): void } }\nfunction f() { const { g } = h; import('k'); }\nimport after from 'after' with { type: 'json' };\n" + REST,
    "import { type T, default as d } from 'a'; import type { U } from 'b'; import q = r.s; const w = <div>import no from 'no'; {import('l')}</div>;" + REST,
    "const x = `import ${import('y')} from 'no'`; import { \"a b\" as c } from 'z'",
    "import a from 'it\\'s'; " + REST,
    "f(import.meta.url); { import b from 'b'; ",
    REST,
    "",
]


def test_imports_end_the_reading():
    for source in SOURCES:
        told = lambda whole: [(f.name, f.line, f.names, f.imported, f.locals, f.exported) for f in whole if f.what == "import"]
        assert told(facts(source, "m.ts", IMPORTS)) == told(facts(source, "m.ts"))
    read = [len(tokenize(s, imports=True)) for s in SOURCES]
    assert all(n < 100 for n in (read[0], read[1], read[3], read[9])) and read[2] < len(tokenize(SOURCES[2])) * 0.6


def test_environment(spark):
    files = spark.createDataFrame(
        [("a.js", "const a = process.env.A; const b = 1; function c() { const d = process.env.D }"), ("b.js", "const a = process.env.A;\nconst a = 2; let e = process.env.E; const a2 = process.env.A"), ("c.js", None)], "path string, content string"
    )
    found = extract.environment(files)
    nodes = extract.symbol_nodes(files).selectExpr("name", "file_path", "get_json_object(metadata, '$.envKey') AS env_key").filter("env_key IS NOT NULL")
    assert sorted(found.collect()) == sorted(nodes.collect())
    assert {(r.name, r.env_key) for r in found.collect()} == {("a", "A"), ("d", "D"), ("e", "E"), ("a2", "A")}


def test_imports_meet_two_rows_a_file(spark):
    """An import was exploded into nine candidates; now files answer to what they may be called, with the same result."""
    paths = ["a/m.ts", "a/m.js", "a/n/index.tsx", "a/n/index.js", "a/index.jsx", "b.tsx", "index.js", "/index.js", "a/o.css", "a/o.css.ts", "a/.js", "index", "a/n.d.ts"]
    files = spark.createDataFrame([(p, "") for p in paths], "path string, content string")
    names = ["./m", "./m.ts", "./n", "./n/", ".", "..", "../b", "../index", "./o.css", "./nothing", "./n/index", "./", "../..", "pkg", "./n.d", "../a/n/../m", "./index.jsx"]
    facts = spark.createDataFrame([("a/m.ts", "import", n, k) for k, n in enumerate(names)], "path string, what string, name string, seq int")
    endings = ["", *extract.EXTENSIONS, *(f"/index{e}" for e in extract.EXTENSIONS)]

    def base(name):
        out = []
        for part in ("a/" + name).split("/"):
            out = out[:-1] if part == ".." else out + [part] * (part not in ("", "."))
        return "/".join(out)

    wanted = {n: next((base(n) + e for e in endings if base(n) + e in paths), None) if n.startswith(".") else None for n in names}
    found = extract.resolved_imports(facts, files)
    assert {r.name: r.resolved for r in found.collect()} == wanted
    made = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in made


def test_edges_are_made_by_compiled_code(spark):
    """Each fact went through the tree of some hundred expressions row by row: a lambda inside the generator kept it from being compiled. Nor may a method be too long for the JVM to compile."""
    facts = spark.createDataFrame([], extract.FACTS)
    package = spark._jvm.org.apache.spark.sql.execution.debug
    for made in (extract._call_edges(facts), extract._declaring_edges(facts), extract._consumer_tags(facts)):
        plan = made._jdf.queryExecution().sparkPlan()
        generators = [line for line in plan.toString().splitlines() if "Generate " in line]
        assert generators and not any("lambda" in line or "CASE" in line for line in generators)
        code = package.package.codegenString(made._jdf.queryExecution().executedPlan())
        assert max([int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)], default=0) < 8000


def test_present_texts(spark):
    rows = spark.createDataFrame([("b", None, "a", "b"), (None, None, None, None)], "w string, x string, y string, z string")
    assert [r[0] for r in rows.select(tags.present("w", "x", "y", "z")).collect()] == [["b", "a"], []]

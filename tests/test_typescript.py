"""Types, scopes and bindings: what the reader takes out, what names mean, and where imported names lead."""

from __future__ import annotations

import pytest

from loomgraph.sources.extract import extract, project_edges
from loomgraph.sources.jsfacts import facts, tokenize
from loomgraph.sources.outline import Outline


def left(source):
    """The source without its types, as tokens."""
    o = Outline(tokenize(source))
    return " ".join(repr(t.text) if t.kind == "string" else t.text for i, t in enumerate(o.t) if not o.dropped[i])


def plain(source):
    return " ".join(repr(t.text) if t.kind == "string" else t.text for t in tokenize(source))


@pytest.mark.parametrize(
    "typed, script",
    [
        # generics
        ("f<A>(x); g<A, B[]>('y'); new C<D>(z); h<{ a: string }>``;", "f(x); g('y'); new C(z); h``;"),
        ("a?.b<T>(c); d[e]<F>(g); (h)<I>(j);", "a?.b(c); d[e](g); (h)(j);"),
        ("const f = <T,>(x: T): T => x; const g = <T extends U = V>(x: T) => x; const h = async <const T,>(x: T) => x;", "const f = (x) => x; const g = (x) => x; const h = async (x) => x;"),
        ("x = f<A<B<C>>>(d); let y: A<B<C>>= z;", "x = f(d); let y = z;"),
        ("const m = new Map<string, Array<() => void>>();", "const m = new Map();"),
        # comparisons stay
        ("a < b && c > (d); if (i < n && n > (i)) {} f(a < b, c); x = a < b ? c : d; y = a < b > c;", "a < b && c > (d); if (i < n && n > (i)) {} f(a < b, c); x = a < b ? c : d; y = a < b > c;"),
        ("for (let i = 0; i < a.length; i++) {}", "for (let i = 0; i < a.length; i++) {}"),
        # annotations, but neither objects, questions, labels nor cases
        ("let a: string, b: { c: d }[] = [], e!: F; const { g: h = 1, i }: J = k; const [l, m]: [n: o, p?: q] = r;", "let a, b = [], e; const { g: h = 1, i } = k; const [l, m] = r;"),
        ("const o = { a: b, c(d: e): f { }, get g(): h { return i }, async *j<K>(l?: m) { }, [n]: o };", "const o = { a: b, c(d) { }, get g() { return i }, async *j(l) { }, [n]: o };"),
        ("a ? b : c; a ? (b) : c => d; a ? (b: c): d => e : f; l: for (;;) {} switch (a) { case b: c(); default: d() }", "a ? b : c; a ? (b) : c => d; a ? (b) => e : f; l: for (;;) {} switch (a) { case b: c(); default: d() }"),
        ("function f(this: A, b?: C, ...d: E[]): asserts b is C { } function g(a = b as C, { d, e: f }: G = {}): (h: i) => j { }", "function f(this, b, ...d) { } function g(a = b, { d, e: f } = {}) { }"),
        ("try { } catch (e: unknown) { } for (const x of y as Z[]) { }", "try { } catch (e) { } for (const x of y) { }"),
        ("let f: (a: b, c: (d: e) => void) => Promise<g> = async (a, c) => { };", "let f = async (a, c) => { };"),
        ("let a: typeof import('x').y, b: keyof typeof c, d: new () => e, f: `a${g}`, h: -1 | 'x', i: A extends B ? C : D, j: unique symbol;", "let a, b, d, f, h, i, j;"),
        # casts
        ("a = b as unknown as C<D>; e = f satisfies G; h = i as const; j(k as L, m!); n = <O>p; q = <R<S>>t;", "a = b; e = f; h = i; j(k, m); n = p; q = t;"),
        ("const as = 1; f(as, type); type = 2; interface_(); declare = 3; let of = namespace.x(); abstract();", "const as = 1; f(as, type); type = 2; interface_(); declare = 3; let of = namespace.x(); abstract();"),
        # classes
        (
            "abstract class A<B> extends C<D> implements E, F<{ g: h }> { private readonly i: J = k; static l?: m; declare n: o; [p: string]: q; abstract r(): s; t(u: v): w; t(u: any) { } constructor(private x: y, public z = 1) { super() } get a(): b { return c } #d: e = 1; static { f() } }",
            "class A extends C { i = k; static l; n; ; ; ; t(u) { } constructor(x, z = 1) { super() } get a() { return c } #d = 1; static { f() } }",
        ),
        ("@A() class B { @C('d') e!: f; @G h(@I() j: k): l { } }", "@A() class B { @C('d') e; @G h(@I() j) { } }"),
        # statements of types
        ("interface A extends B<C> { d(): e; f: { g: h } } i();", "i();"),
        ("export type A<B> = B extends (infer C)[] ? { d: C } : never; export interface E { } type F = string\nG()", "G()"),
        ("declare function a(b: c): d; declare const e: f; declare module 'g' { const h: i } declare global { interface J { } }", "const e; { const h } { }"),
        ("function a(b: string): c; function a(b: number): c\nfunction a(b: any) { }", "function a(b) { }"),
        ("import a = require('b'); import c = d.e; import type { F } from 'g'; import { type H, i } from 'j'; export type { K } from 'l'; export as namespace M;", "import type { F } from 'g'; import { type H, i } from 'j'; export { K } from 'l';"),
        ("enum A { B = c(), D } const enum E { F } namespace G.H { export const i: j = 1 }", "{ B = c(), D } { F } { export const i = 1 }"),
        ("import a from 'b' with { type: 'json' };", "import a from 'b';"),
    ],
)
def test_types_are_taken_out(typed, script):
    assert left(typed) == plain(script)
    assert left(script) == plain(script)


def called(source, path="a.tsx"):
    return {(f.what, f.name, f.caller) for f in facts(source, path) if f.what in ("call", "jsx")}


@pytest.mark.parametrize("path", ["a.ts", "a.tsx", "a.js", "a.jsx"])
def test_types_and_elements_in_files_of_any_name(path):
    found = called("const f = <T,>(x: T) => g<T>(x);\nconst C = () => <A<B> c={d<E>()}><F.G/>{h as I}</A>;\nconst j = <T>(x: T) => k(x);\nconst l = <M>n(o);\nconst p = a < b;", path)
    assert found == {("call", "g", "f"), ("jsx", "A", "C"), ("call", "d", "C"), ("jsx", "F.G", "C"), ("call", "k", "j"), ("call", "n", None)}


def test_text_of_elements_is_no_code():
    assert called("const C = () => <A>it's 5 > 3, call(x) <b>{d()}</b></A>;\nfunction g() { e(); }") == {("jsx", "A", "C"), ("call", "d", "C"), ("call", "e", "g")}


def test_broken_sources_end():
    for source in ("<", "f<", "<A", "class", "class A {", "function", "const", "import", "export", "type A =", "interface A {", "a ? (b): c", "({", "`${", "enum A {", "x as", "@", "<A>{", "import {", "for (", "(" * 3000 + "a" + "<B>" * 200):
        assert facts(source) is not None


def used(source):
    return [(f.name, f.line, f.caller) for f in facts(source) if f.what == "use"]


@pytest.mark.parametrize(
    "source, lines",
    [
        ("const a = 1;\nfunction f(a) {\n return a;\n}\nfunction g() {\n return a;\n}", [6]),
        ("const a = 1;\nfunction f() {\n x = a;\n var a;\n}\nx = a;", [6]),  # var is hoisted over its function
        ("const a = 1;\nfunction f() {\n { let a = 2;\n x = a; }\n x = a;\n}", [5]),
        ("const a = 1;\nfunction f() {\n if (x) { var a = 2; }\n return a;\n}", []),
        ("const a = 1;\nfunction f() {\n x = a;\n function a() {}\n}", []),
        ("x = a;\nfunction a() {}", [1]),
        ("const a = 1;\ntry {} catch (a) {\n x = a;\n}\ntry {} catch {\n x = a;\n}", [6]),
        ("const a = 1;\nfor (const a of b) {\n x = a;\n}\nx = a;", [5]),
        ("const a = 1;\nx = (a) =>\n a;\nx = a => {\n x = a; };\nx = ({ b: a }) =>\n a;\nx = ({ a: b }) =>\n a;", [9]),
        ("const a = 1;\nx = { a: 1,\n a,\n b: a,\n [a]: 1,\n a() {} };\nx.a = y?.a;", [3, 4, 5]),
        ("const a = 1;\nconst { b = a,\n a: c } = x;\nconst [d = a] = x;", [2, 4]),
        ("const a = 1;\nclass B { a = 1; get a() { return a; } static a() {}\n c = a; }", [2, 3]),
        ("const a = 1;\nconst b = function a() {\n return a; };\nconst c = class a { d() {\n return a; } };", []),
        ("const a = 1;\na: for (;;) { break a; }\nlet b: a = c as a;\ntype D = typeof a;", []),
        ("const a = 1;\nx = `${a}`;\ny = <B c={a}>{a}</B>;", [2, 3, 3]),
        ("import { a as b, c } from 'x';\nexport { c };\nb; a;", [2, 3]),
        ("const a = 1;\na(1);\nnew a();\na.b();", [3, 4]),  # a call is a call edge
    ],
)
def test_uses_are_bound_by_scopes(source, lines):
    assert [line for name, line, _ in used(source) if name in ("a", "b", "c") and (name == "a" or "import" in source)] == lines


def test_uses_stand_in_functions():
    assert used("const a = 1;\nfunction f() { return () => a; }\nconst g = () => { a; };\na;") == [("a", 2, "f"), ("a", 3, "g"), ("a", 4, None)]


def project(spark, **files):
    df = spark.createDataFrame([(p.replace("__", ".").replace("_S_", "/"), c) for p, c in files.items()], "path string, content string")
    names = {r.id: r.qualified_name for r in extract(df).nodes.collect()}
    return {(r.kind, names[r.source], names[r.target]) for r in project_edges(df).collect()}


def test_imports_are_followed(spark):
    found = project(
        spark,
        core__ts="export function f() {}\nexport default function g() {}\nfunction h() {}\nexport { h as i };\nexport class default_ {}\nexport const v = 1;",
        mid__ts="export * from './core';\nexport * from './loop';\nexport { f as renamed, default as g2 } from './core';\nexport * as core from './core';",
        loop__ts="export * from './mid';\nexport const own = () => 1;",
        own__ts="export * from './core';\nexport function f() {}",  # its own f hides the other
        two__ts="export * from './core';\nexport * from './own';",  # two different f: none
        app__ts="import d, { i } from './core';\nimport { renamed, g2, own, core, v } from './mid';\nimport { f as f1 } from './own';\nimport { f as f2, i as i2 } from './two';\nimport { f as f3 } from './nothing';\nimport pkg from 'pkg';\n"
        "function a() { d(); i(); renamed(); g2(); own(); core.f(); f1(); f2(); i2(); f3(); pkg(); v.x(); }\nfunction b(own) { own(); core.missing(); core(); }",
    )
    calls = {t for k, s, t in found if k == "call" and s == "app.ts::a"}
    assert calls == {"core.ts::g", "core.ts::h", "core.ts::f", "loop.ts::own", "own.ts::f"}
    assert ("references", "app.ts::a", "core.ts::v") in found and not {t for k, s, t in found if s == "app.ts::b"}


def test_extract_with_references_has_both(spark):
    df = spark.createDataFrame([("a.ts", "import { f, g } from './b';\nexport const c = () => { f(g); keep(); };"), ("b.ts", "export function f() {}\nexport const g = 1;")], "path string, content string")
    g = extract(df, resolve=True, references=True)
    names = {r.id: r.name for r in g.nodes.collect()}
    found = {(r.kind, names[r.source], names.get(r.target)) for r in g.edges.collect() if r.kind in ("call", "references")}
    assert found == {("call", "c", "f"), ("call", "c", None), ("references", "c", "g")}
    assert project_edges(df.limit(0)).isEmpty()

"""The store's layers: what is written, what readers see, merges, and numbers that come out of order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import store as store_module
from loomgraph.sources.extract import extract
from loomgraph.sources.model import EDGES, NODES
from loomgraph.sources.store import Store
from loomgraph.streaming.reindex import watch


def module(k, text=""):
    return (f"src/m{k}.js", f"import {{ f{k + 1} }} from './m{k + 1}';\nimport x from 'pkg{k % 3}';\nexport function f{k}() {{ f{k + 1}(); fetch('/e{k % 4}'); {text} }}")


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def written(root):
    return {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in root.iterdir() if p.name.startswith("v-")}


def test_a_change_writes_what_it_changes(spark, tmp_path):
    store, root = Store(spark, f"file://{tmp_path}/s"), tmp_path / "s"
    rows = [module(k) for k in range(400)]
    store.reindex(frame(spark, rows).coalesce(1))
    (whole,) = written(root).items()
    rows[7] = module(7, "fetch('/new')")
    assert store.reindex(frame(spark, rows)) == {"same": 399, "changed": 1}
    sizes = written(root)
    assert len(sizes) == 2 and sizes[whole[0]] == whole[1] and sum(sizes.values()) - whole[1] < whole[1]
    layer = store.state().layers[-1]
    read = lambda name: spark.read.parquet(f"{store.folder}/{layer}/{name}")
    assert [r.path for r in read("files").collect()] == ["src/m7.js"] and {r.owner for r in read("edges").collect()} == {"src/m7.js"} and read("gone").count() == 1
    assert store.reindex(frame(spark, rows)) == {"same": 400} and len(written(root)) == 2


def test_layers_read_as_one(spark, tmp_path, monkeypatch):
    """Changes, removals and returns; small merges and whole ones on the way."""
    monkeypatch.setattr(store_module, "MOST_LAYERS", 3)
    rng, store = random.Random(3), Store(spark, f"file://{tmp_path}/s")
    rows = {k: module(k) for k in range(60)}
    store.reindex(frame(spark, list(rows.values())))
    most = 0
    for step in range(5):
        for k in rng.sample(range(60), 4):
            if k in rows and rng.random() < 0.3:
                del rows[k]
            else:
                rows[k] = module(k, f"localStorage.getItem('k{step}')")
        store.reindex(frame(spark, list(rows.values())))
        most = max(most, len(store.state().layers))
    # an import's path is found among the files read with it, so those of other files are compared without
    g = extract(frame(spark, list(rows.values())))
    own = lambda e: sorted(tuple(str(v) for v in r) for r in e.filter("kind <> 'import'").select(EDGES.fieldNames()).collect())
    assert own(store.table("edges")) == own(g.edges) and 1 < most <= 3
    assert sorted(map(str, store.table("nodes").select(NODES.fieldNames()).collect())) == sorted(map(str, g.nodes.select(NODES.fieldNames()).collect()))
    before = own(store.table("edges"))
    store.compact()
    assert len(store.state().layers) == 1 and own(store.table("edges")) == before and {r.path for r in store.table("files").collect()} == {p for p, _ in rows.values()}


def test_keyed_changes_and_removed_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.reindex(frame(spark, [("a.js", "export function aa() { bb() }"), ("b.js", "import { aa } from './a';\nexport function bb() { aa() }"), ("c.js", "fetch('/x')")]))
    node = store.table("nodes").filter("name = 'aa'").withColumn("metadata", F.lit("{}"))
    store.upsert_nodes(node)
    edge = store.table("edges").filter("kind = 'call' AND label = 'aa → bb'").withColumn("label", F.lit("new"))
    store.upsert_edges(edge.unionByName(edge.withColumn("line", F.lit(None).cast("int"))))
    store.upsert_edges(edge.withColumn("line", F.lit(None).cast("int")))
    assert [r.metadata for r in store.table("nodes").filter("name = 'aa'").collect()] == ["{}"]
    found = [(r.label, r.line) for r in store.table("edges").filter(F.col("source") == node.first().id).filter("kind = 'call'").collect()]
    assert sorted(found, key=str) == [("new", 1), ("new", None), ("new", None)]
    ids = {r.id for r in store.table("nodes").filter("file_path = 'a.js'").collect()}
    store.delete_files(spark.createDataFrame([("a.js",)], "path string"))
    assert not [r for r in store.table("edges").collect() if {r.source, r.target} & ids]
    assert store.table("nodes").filter("file_path = 'a.js'").isEmpty() and {r.path for r in store.table("files").collect()} == {"b.js", "c.js"}
    store.compact()
    assert not [r for r in store.table("edges").collect() if {r.source, r.target} & ids] and store.table("nodes").filter("name = 'bb'").count() == 1


def test_a_version_of_before_is_read_and_written_anew(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [module(k) for k in range(12)]
    g = extract(frame(spark, rows))
    for name, df in (("files", frame(spark, rows).select("path", F.sha2("content", 256).alias("content_hash"))), ("nodes", g.nodes), ("edges", g.edges)):
        df.write.parquet(f"{store.folder}/v-old/{name}")
    (tmp_path / "s" / "CURRENT-000000000004").write_text('{"version": "v-old", "schema_version": 2}')
    assert store.table("nodes").count() == g.nodes.count()
    rows[3] = module(3, "fetch('/more')")
    assert store.reindex(frame(spark, rows)) == {"same": 11, "changed": 1}
    same_names = {r.name for r in store.table("nodes").collect()}
    assert "GET /more" in same_names and store.table("nodes").count() == g.nodes.count() + 1


def test_a_writer_on_an_older_version_fails(spark, tmp_path):
    one, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    one.reindex(frame(spark, [module(k) for k in range(9)]))
    begun = other.state()
    one.reindex(frame(spark, [module(k) for k in range(10)]))
    with pytest.raises(RuntimeError, match="another writer"):
        other._append(begun, {}, {})
    assert one.table("files").count() == 10


def test_numbers_out_of_order(spark, tmp_path):
    """An older row that comes in a later batch is dropped, also for a file that has gone."""
    source, store = str(tmp_path / "in"), Store(spark, f"file://{tmp_path}/s")

    def put(rows):
        spark.createDataFrame(rows, "path string, content string, seq long").coalesce(1).write.mode("append").parquet(source)
        query = watch(spark, source, store, str(tmp_path / "check"))
        assert query.awaitTermination(300) and query.exception() is None

    names = lambda: {r.name for r in store.table("nodes").filter("kind = 'function'").collect()}
    put([("a.js", "function a5() {}", 5), ("b.js", None, 7), ("c.js", "function c1() {}", 1), ("d.js", "function d() {}", 1)])
    assert names() == {"a5", "c1", "d"}
    put([("a.js", "function a4() {}", 4), ("b.js", "function b6() {}", 6), ("c.js", "function c2() {}", 2)])
    assert names() == {"a5", "c2", "d"}
    changes = spark.createDataFrame([("a.js", None, 5), ("b.js", "function b8() {}", 8), ("c.js", "function c2() {}", 3)], "path string, content string, seq long")
    assert store.apply(changes) == {"late": 1, "new": 1, "same": 1} and store.apply(changes) == {"late": 3}
    store.compact()
    assert store.apply(changes) == {"late": 3} and names() == {"a5", "b8", "c2", "d"}
    assert {r.path: r.seq for r in store.seqs().collect()} == {"a.js": 5, "b.js": 8, "c.js": 3, "d.js": 1}

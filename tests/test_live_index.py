"""An index after insertions, replacements, deletions and merges gives what a fresh search gives."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import live_index, search
from loomgraph.operators.live_index import LiveIndex

COLUMNS = ("name", "body")
QUERIES = ("cafe", "w1*", '"w1 w2"', "w3 NOT w4", "w5 OR name:w6", "w7 w8", "zzz", '"w1 w*"')


def same(index, rows, queries=QUERIES):
    for q in queries:
        plain = [(r.id, round(r.score, 9)) for r in search.search(rows, q, 5, columns=COLUMNS).collect()]
        assert [(r.id, round(r.score, 9)) for r in index.search(rows, q, 5).collect()] == plain, q


def test_changes_equal_a_fresh_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_index, "MOST_SEGMENTS", 3)
    rng = random.Random(1)
    index = LiveIndex(spark, f"file://{tmp_path}/i", COLUMNS, buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "id string, name string, body string")
    text = lambda n: " ".join(rng.choice(["Café", *(f"w{k}" for k in range(30))]) for _ in range(n))
    held = {}
    same(index, frame([]), QUERIES[:2])
    for step in range(3):
        new = {f"d{rng.randrange(25)}": (text(3), text(rng.randrange(12))) for _ in range(10)}
        index.add(frame([(k, *v) for k, v in new.items()]))
        held |= new
        if step:
            gone = rng.sample(sorted(held), 3)
            index.delete(spark.createDataFrame([(g,) for g in [*gone, "never"]], "id string"))
            held = {k: v for k, v in held.items() if k not in gone}
        rows = frame([(k, *v) for k, v in held.items()])
        same(index, rows, QUERIES if step == 2 else QUERIES[:3])
    assert index._state()["n"] == len(held) and len(index._state()["layers"]) <= 3
    index.merge()
    assert len(index._state()["layers"]) == 1 and not index._state()["gone"]
    same(index, rows, QUERIES[:4])


def test_two_writers_of_an_index(spark, tmp_path):
    index = LiveIndex(spark, f"file://{tmp_path}/i", COLUMNS, buckets=2)
    index.add(spark.createDataFrame([("a", "x", "y")], "id string, name string, body string"))
    late = LiveIndex(spark, f"file://{tmp_path}/i", COLUMNS)
    state = late._state()
    index.delete(spark.createDataFrame([("a",)], "id string"))
    late._state = lambda: state
    with pytest.raises(RuntimeError, match="another writer"):
        late.delete(spark.createDataFrame([("a",)], "id string"))


def test_prefixes_beyond_the_dictionary(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"d{k}", f"w{k}", "x") for k in range(20)], "id string, name string, body string")
    index = search.Index.build(rows, f"file://{tmp_path}/i", columns=COLUMNS)
    assert index.buckets == 1
    for most in (1000, 3):
        monkeypatch.setattr(search, "MOST_TERMS", most)
        assert {r.id for r in index.hits(spark, "w1*", None).collect()} == {"d1", *(f"d{k}" for k in range(10, 20))}

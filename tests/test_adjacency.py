"""Edges kept in buckets, and paths searched from both ends, against plain searches."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import adjacency, meet, traverse
from loomgraph.operators.adjacency import Adjacency
from loomgraph.sources.lineage import Steps


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, k) for a, b, k in rows], "source string, target string, kind string")


def some(seed, n=16, m=36):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}", rng.choice("xyz")) for _ in range(m)]


def best_path(rows, a, b, kinds=None):
    """The shortest path whose nodes, read from the end, are smallest."""
    ahead = collections.defaultdict(set)
    for s, t, k in rows:
        if kinds is None or k in kinds:
            ahead[s].add(t)
    level, seen = {a: [a]}, {a}
    while level:
        if b in level:
            return level[b]
        new = {}
        for s in sorted(level):
            for t in ahead[s] - seen:
                new.setdefault(t, level[s] + [t])
        seen |= new.keys()
        level = new
    return None


@pytest.mark.parametrize("most", [traverse.BROADCAST_ROWS, 0])
def test_paths_from_both_ends_are_those_from_one(spark, monkeypatch, most):
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", most)
    monkeypatch.setattr(meet, "BROADCAST_ROWS", most)
    monkeypatch.setattr(meet, "GATHER_AFTER", 1)
    rows = some(5) + [(f"c{k}", f"c{k + 1}", "x") for k in range(5)] + [("n03", "c0", "x")]
    edges = edges_of(spark, rows)
    kept = Adjacency.build(edges, buckets=3)
    for a, b, kinds in [("n00", "n07", None), ("n01", "c5", None), ("n02", "n09", ("x", "y")), ("c5", "n00", None), ("n04", "n04", None), ("never", "n00", None)]:
        expected = best_path(rows, a, b, kinds)
        for over in (edges, kept):
            found = meet.between(over, a, b, kinds).collect()
            assert [(r.node_id, r.depth, r.path) for r in found] == ([] if expected is None else [(b, len(expected) - 1, expected)]), (a, b, over)
    kept.close()


def test_both_ends_write_less(spark, monkeypatch):
    """A tree that widens from the start: from its end, there is one way back."""
    rows = [(f"t{k}", f"t{3 * k + j}", "x") for k in range(1, 120) for j in (0, 1, 2) if 3 * k + j != k]
    written = []
    plain = Steps.write
    monkeypatch.setattr(Steps, "write", lambda self, df, **v: (lambda found: (written.append(found[1]["n"]), found)[1])(plain(self, df, **v)))
    edges = edges_of(spark, rows)
    alone = traverse.bfs(edges, traverse.seeds(spark, ["t1"]), target="t350", paths=True).filter("node_id = 't350'").first()
    from_one, written[:] = sum(written) - len(rows), []
    both = meet.between(edges, "t1", "t350").first()
    assert both.path == alone.path and both.depth == alone.depth
    assert (sum(written) - len(rows)) * 5 < from_one


@pytest.mark.parametrize("few", [200, 0])
@pytest.mark.parametrize("most", [traverse.BROADCAST_ROWS, 0])
def test_kept_walks_equal_plain_ones(spark, monkeypatch, few, most):
    monkeypatch.setattr(adjacency, "FEW_NODES", few)
    monkeypatch.setattr(adjacency, "BUCKET_EDGES", 4)  # hubs
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", most)
    nul = [("hub\0" + "1", "n01", "x"), ("hub", "hub\0" + "1", "x"), ("n00", "hub", "x")]
    rows = some(7) + [("hub", f"n{k:02d}", "y") for k in range(2, 14)] + [(f"n{k:02d}", "hub", "z") for k in range(4, 9)] + nul
    edges = edges_of(spark, rows + rows[:3])
    kept = Adjacency.build(edges, buckets=4)
    assert kept._hubs["out"] is not None and kept._hubs["in"] is not None
    start = traverse.seeds(spark, ["n00", "n05", "never"])
    for direction, kinds, depth in [("out", None, None), ("in", ("x", "z"), 4), ("both", ("y", "x"), 2)]:
        result = lambda over: sorted((r.seed, r.node_id, r.depth, r.parent_id or "") for r in traverse.bfs(over, start, direction, iter(kinds) if kinds else None, depth).collect())  # noqa: E731, B023
        assert result(kept) == result(edges)
    kept.close()


def test_plans_leave_edges_where_they_are(spark, tmp_path):
    rows = [(f"n{k}", f"n{(7 * k + 1) % 400}", "x") for k in range(400)]
    folder = f"file://{tmp_path}/kept"
    Adjacency.build(edges_of(spark, rows), folder, buckets=8).close()
    kept = Adjacency.open(spark, folder)
    assert kept.buckets == 8
    level = spark.createDataFrame([(f"n{k}",) for k in range(0, 400, 3)], "_here string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wide = kept.beyond(level, traverse.BROADCAST_ROWS + 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(wide.select("_here", "there"))
        assert text.count("Exchange") == 1 and "Bucketed: true" in text, text
        assert {(r[0], r[1]) for r in wide.select("_here", "there").collect()} == {(a, b) for a, b, _ in rows if int(a[1:]) % 3 == 0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one = level.limit(1)
    read = kept.beyond(one, 1).select(F.input_file_name().alias("f")).first().f
    for file in (tmp_path / "kept" / "out").glob("*.parquet"):
        if file.name not in read:  # whatever opens another bucket fails
            file.write_bytes(b"no parquet")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert len(kept.beyond(one, 1).collect()) == 1
    with pytest.raises(Exception, match="(?i)parquet"):
        kept.beyond(level, traverse.BROADCAST_ROWS + 1).collect()
    kept.close()


def test_no_edges(spark):
    kept = Adjacency.build(edges_of(spark, [(None, "a", "x"), ("a", None, "x")]))
    assert [(r.node_id, r.depth) for r in traverse.bfs(kept, traverse.seeds(spark, ["a"])).collect()] == [("a", 0)]
    assert meet.between(kept, "a", "b").isEmpty() and meet.between(kept, "a", "a").first().path == ["a"]
    kept.close()

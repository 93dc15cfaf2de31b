"""Top-k search, source divergence and filter interactions against brute force, SQL and awkward tables."""

from __future__ import annotations

import collections
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import divergence, entry, interactions, topk

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def nearest(rows, k=5, by=256):
    """{(query, rank): (id, score)} with Python's integers."""
    ends = np.iinfo(np.int64)
    held = lambda x: min(max(int(x), ends.min), ends.max)
    one = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        w = [held(math.floor(by * x)) for x in v]
        one[i] = min(one.get(i, w), w)
    found = {}
    for q in (i for i in one if i % 50 == 0):
        scores = sorted((-held(sum(a * b for a, b in zip(one[q], v, strict=False))), i) for i, v in one.items() if i != q)
        found |= {(q, n): (i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return found


def searched(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, score string, g int")
    out = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out}
    assert len(found) == len(out)
    return found


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    # few distinct values: many equal scores
    rows = [(int(k), [float(x) for x in rng.integers(-3, 4, 7) / 4]) for k in rng.permutation(700)]
    assert searched(spark, rows) == nearest(rows)


def test_top_k_cuts_blocks_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.normal(size=5).astype(np.float32).tolist()) for k in range(900)]
    monkeypatch.setattr(topk, "BLOCKS", 2)
    monkeypatch.setattr(topk, "CHUNKS", 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)
    # workers import the module anew, so the grid is what changes here
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert found == nearest(rows)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, None), (2, [1.0, None]), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, -2.0]), (None, [5.0, 5.0]), (100, [1.0, 1.0, 1.0]), (50, None), (9, [0.001, -0.001])]
    assert searched(spark, rows) == nearest(rows)
    big = [(0, [1e30, -1e18]), (1, [1e20, 1e17]), (2, [-1e30, 3.0]), (3, [7.0, 1e12])]
    assert searched(spark, big, "double") == nearest(big)
    assert searched(spark, [(0, [1.0])]) == {} and searched(spark, []) == {} and searched(spark, [(1, [1.0]), (2, [2.0])]) == {}


def block(x):
    order = np.argsort(-x.T, axis=1, kind="stable")
    return topk.Block(np.arange(len(x)), order.astype(np.int32), np.take_along_axis(x.T, order, 1))


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-200, 200, (60, 6)), rng.integers(-200, 200, (4, 6)).astype(float)
    exact = x @ q.T
    down, up = topk.Read(block(x), q, True), topk.Read(block(x), q, False)
    gaps = []
    for depth in (1, 5, 20, 59, 60):
        down.to(depth), up.to(depth)
        p, m = np.maximum(q, 0), np.minimum(q, 0)
        lower = down.at_least(p) + up.at_least(m)
        upper = lower + down.open(p) + up.open(m)
        assert (lower <= exact).all() and (exact <= upper).all()
        gaps.append((upper - lower).sum())
    assert gaps == sorted(gaps, reverse=True) and (lower == exact).all()


def test_reading_ends_early_where_few_can_qualify():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 50, (1000, 4))
    x[:5] = 5000
    read = []
    before = topk.Read.to
    topk.Read.to = lambda self, depth: read.append(depth) or before(self, depth)
    try:
        found = list(topk.nra(block(x), np.full((1, 4), 7), np.array([-1]), 5, np.array([-np.inf])))
    finally:
        topk.Read.to = before
    assert max(read) == 250 and sorted(found[0][1].tolist()) == [0, 1, 2, 3, 4] and set(found[0][2].tolist()) == {140_000}


def audited(rows, least):
    """The contract's rows by plain Python."""
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    found = [(lang or "", source or "", terms(t)) for lang, source, t in rows]
    out = []
    for lang in {f[0] for f in found}:
        docs = collections.Counter(t for f in found if f[0] == lang for t in set(f[2]))
        kept = {t for t, n in docs.items() if n >= least}
        groups = collections.defaultdict(collections.Counter)
        for f in found:
            if f[0] == lang:
                groups[f[1]].update(t for t in f[2] if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept}
        whole = share(sum(groups.values(), collections.Counter()))
        of = {s: share(c) for s, c in groups.items()}
        for s, p in of.items():
            pairs = sorted((-sum(abs(p[t] - q[t]) for t in kept), o.encode(), o) for o, q in of.items() if o != s)
            top = sorted((whole[t] - p[t], t.encode(), t) for t in kept if groups[s][t] and p[t] > whole[t])[:50]
            out += [(lang, s, "pair", o, -v, n) for n, (v, _, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, -v, n) for n, (v, _, t) in enumerate(top, 1)]
    return sorted(out)


@pytest.mark.parametrize("sources", [1, 2, 5, 70])
def test_divergence_equals_brute_force(spark, sources):
    """Beyond 32 sources a seat holds several."""
    rng = random.Random(sources)
    vocabulary = [f"{a}{b}" for a in ("Wort", "été", "x", "日本", "Ünder") for b in ("a", "B", "ccc", "é", "ß", "ZZ")] * 2 + ["\U0001f600", "￮", "zz", "a b"]
    rows = [(rng.choice(["en", None, "de"]), rng.choice([f"s{k}" for k in range(sources)]), rng.choice([" ", "\x00", "1_"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for _ in range(400)]
    rows += [("en", None, None), ("en", "silent", "123 ..."), ("fr", "a", "seldom"), ("fr", "b", ""), ("it", "", "x" * 200_000)] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(5)
    out = divergence.divergence(df, least_documents=8)
    found = sorted(tuple(r) for r in out.collect())
    assert found == audited(rows, 8) and (len(found) > 100 or sources == 1)
    assert divergence.divergence(df.limit(0)).isEmpty()


def test_shares_stay_exact_beyond_longs():
    counts, total, kept = np.array([0, 3, 10**13]), 10**13 + 3, 4_000_000
    assert divergence.shares(counts, total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts.tolist()]


@pytest.mark.parametrize("n", range(2, 12))
def test_every_pair_of_seats_meets_once_and_nobody_twice_a_round(spark, n):
    seats = spark.range(n).select(F.col("id").cast("int").alias("a"))
    pairs = seats.crossJoin(seats.toDF("b")).filter("a < b").withColumn("r", divergence._round(F.col("a"), F.col("b"), F.lit(n))).collect()
    rounds = collections.defaultdict(list)
    for p in pairs:
        rounds[p.r] += [p.a, p.b]
        assert divergence._round(F.lit(p.b), F.lit(p.a), F.lit(n)) is not None
    assert set(rounds) == set(range(1, n if n % 2 == 0 else n + 1)) and all(len(set(r)) == len(r) for r in rounds.values())


def test_removal_polynomials_equal_all_orders():
    rng = random.Random(7)
    counts = [{m: rng.randrange(9) for m in range(32)} for _ in range(3)]
    mean = collections.Counter()
    rows = {(r[1], r[2]): r[3:] for r in interactions.audit("p", *counts)}
    assert len(rows) == 600
    for order in itertools.permutations("ABCDE"):
        left = dict(enumerate(map(list, zip(*(c.values() for c in counts), strict=True))))
        for step, name in enumerate(order, 1):
            bit = 1 << "ABCDE".index(name)
            gone = [m for m in left if m & bit]
            removed = [sum(left[m][k] for m in gone) for k in range(3)]
            fails = sum(n for m, n in counts[0].items() if m & bit)
            for m in gone:
                del left[m]
            mean[name] += removed[0]
            assert rows["".join(order), step][:-1] == (sum(v[0] for v in left.values()), removed[0], fails - removed[0], counts[0][bit], removed[1], removed[2])
    assert all(r[-1] == mean[o[s - 1]] for (o, s), r in rows.items())


def test_masks_of_odd_texts(spark):
    rng = random.Random(8)
    texts = ["", " \n", "A" * 300, " ".join(map(str, range(200))), " ".join(map(str, range(199))), " ".join(["a b"] * 150), " ".join(f"w{k % 100}" for k in range(200)), " ".join(f"w{k % 99}" for k in range(200)), "é" * 97 + "AAA", "é" * 96 + "AAAA", "x|y", "x_y", "x y \x1f z", "same", "Same", "same ", " ".join(f"é{k} and" for k in range(300_000))]
    rows = [(k, rng.choice(["en", None, ""]), rng.choice(texts) if k > len(texts) else texts[k % len(texts)]) for k in range(60)] + [(3, "en", "same"), (13, "en", "same"), (13, "de", "same"), (None, "en", "same"), (None, "en", None)]

    def mask(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows))
        return sum(f << k for k, f in enumerate(fails))

    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, lang string, text string, sha string, mask int, least int").repartition(3)
    found = sorted((str(r.id), r.part, r.mask) for r in interactions.masks(df).collect())
    assert found == sorted((str(i), p or "", mask(i, t or "")) for i, p, t in rows)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (2, None, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    out = interactions.filter_interactions(df, labels).collect()
    parts = {p or "" for _, p, _ in rows}
    assert len(out) == 600 * len(parts) and {r.part for r in out} == parts
    # ids 0 and 2 fail A, so whatever goes at A's first place includes the labelled rows
    first = [r for r in out if r.step == 1 and r.filter_order == "ABCDE"]
    assert (sum(r.good_lost for r in first), sum(r.toxic_lost for r in first)) == (1, 2)
    assert interactions.filter_interactions(df.limit(0), labels).isEmpty() and interactions.filter_interactions(df, labels.limit(0)).count() == len(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_source_divergence", "op13_filter_interactions"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_signatures_meet_documents_once(spark):
    """A document in many unsettled buckets is one row of the join with its signature, and each of its places comes out with it."""
    from loomgraph.llm.near_dedup import _signed

    members = spark.createDataFrame([(b, 0, i, 9, i) for i in range(3) for b in range(25)], "band long, t int, id long, size long, label long")
    reps = spark.createDataFrame([(i, bytes([i])) for i in range(4)], "_id long, signature binary")
    signed = _signed(members, reps)
    rows = sorted((r.id, r.band, r.label, bytes(r.signature)) for r in signed.collect())
    assert rows == [(i, b, i, bytes([i])) for i in range(3) for b in range(25)]
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")

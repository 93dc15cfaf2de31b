"""The toxicity query against a plain classifier chain, written out document by document."""

from __future__ import annotations

import math
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import entry, toxicity

SF = "/root/testdata/sf0.001"
LANGS = ("en", "fr", "de", "es")


def bucket_of(word, known={}):  # noqa: B006
    if word not in known:
        ((_, _, _, bucket),) = toxicity.word_buckets(pa.array([word]))
        known[word] = int(bucket[0])
    return known[word]


def words_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {bucket_of(w) for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", small)}


def selected(bags, y, rows):
    """The buckets with the highest chi-squared; equal ones in order."""
    n, positives = float(len(rows)), float(sum(y[i] for i in rows))
    have, both = {}, {}
    for i in rows:
        for b in bags[i]:
            have[b] = have.get(b, 0) + 1
            both[b] = both.get(b, 0) + y[i]
    chi = {}
    for b, h in have.items():
        under = positives * (n - positives) * max(h, 1) * max(n - h, 1) / n
        if h >= toxicity.LEAST_DOCUMENTS and under:
            chi[b] = (both[b] - h * positives / max(n, 1)) ** 2 * n**2 / under / n
    best = sorted((-c, b) for b, c in chi.items() if c > 0)[: toxicity.SELECTED]
    return sorted(b for _, b in best)


def fitted(bags, y, rows, earlier):
    """Log-odds of any (words, earlier probabilities): ridge logistic regression, by Newton steps until nothing moves."""
    if not any(y[i] for i in rows):
        return lambda bag, p: toxicity.NEVER
    found = selected(bags, y, rows)
    k = len(earlier[0]) if earlier else 0
    x = np.array([[*(float(b in bags[i]) for b in found), *earlier[i], 1.0] for i in rows])
    t = np.array([y[i] for i in rows], float)
    ridge = np.array([toxicity.L2] * (len(found) + k) + [1e-3])
    w = np.zeros(len(ridge))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (t - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-10:
            break
    place = {b: j for j, b in enumerate(found)}
    return lambda bag, p: sum(w[place[b]] for b in bag if b in place) + sum(w[len(found) + j] * v for j, v in enumerate(p)) + w[-1]


def sigmoid(z):
    return 1 / (1 + math.exp(-min(max(z, -40), 40)))


def plain_chain(bags, labels):
    """Models in order; each learns from probabilities that models of other folds gave."""
    n, held, models = len(bags), [[] for _ in bags], []
    for y in labels:
        out = [0.0] * n
        for f in range(toxicity.FOLDS):
            m = fitted(bags, y, [i for i in range(n) if i % toxicity.FOLDS != f], held)
            for i in range(f, n, toxicity.FOLDS):
                out[i] = sigmoid(m(bags[i], held[i]))
        models.append(fitted(bags, y, list(range(n)), held))
        held = [[*h, p] for h, p in zip(held, out, strict=True)]
    return models


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_query_equals_a_plain_chain(spark):
    docs = duckdb.sql(f"SELECT doc_id, lang, text FROM '{SF}/documents.parquet'").fetchall()
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    rows = sorted(((str(d), lang, text) for d, lang, text in docs if d in toxic))
    bags = [words_of(text) for _, _, text in rows]
    truth = [float(toxic[int(d)] or 0) for d, _, _ in rows]
    labels = [[t if lang == mine else 0.0 for t, (_, mine, _) in zip(truth, rows, strict=True)] for lang in LANGS] + [truth]
    models = plain_chain(bags, labels)
    found = {r.doc_id: r for r in entry.op5_toxicity(spark, SF).collect()}
    assert set(found) == {d for d, _, _ in docs} and sum(truth) > 3
    for d, _, text in docs:
        bag, p = words_of(text), []
        for m in models:
            p.append(sigmoid(m(bag, p)))
        r = found[d]
        assert [r[f"p_toxic_{lang}"] for lang in LANGS] + [r.p_toxic] == pytest.approx(p, abs=5e-3)
        assert abs(p[-1] - toxicity.THRESHOLD) < 5e-3 or r.toxic == (p[-1] >= toxicity.THRESHOLD)


def test_models_learn_from_probabilities_of_other_folds():
    """A category that repeats the one before it leans on its out-of-fold probabilities, not on its labels."""
    rng = np.random.default_rng(1)
    n = 90
    y = (np.arange(n) % 2).astype(float)
    bags = [sorted({int(b) for b in rng.integers(0, 40, 6)} | ({1000} if y[i] and rng.random() < 0.8 else set())) for i in range(n)]
    row, bucket = np.repeat(np.arange(n), [len(b) for b in bags]), np.concatenate(bags)
    chain = toxicity.fit_chain({"a": y, "b": y}, row, bucket)
    models = plain_chain([set(b) for b in bags], [y.tolist(), y.tolist()])
    p = chain.probabilities(n, row, bucket)
    for i in range(n):
        first = sigmoid(models[0](set(bags[i]), []))
        assert p[i].tolist() == pytest.approx([first, sigmoid(models[1](set(bags[i]), [first]))], abs=5e-3)

"""Toxicity by a classifier chain of linear models over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks

#: Hashed words.
BUCKETS = 1 << 18
#: Words a model may use: those with the highest chi-squared against its category.
SELECTED = 128
LEAST_DOCUMENTS = 4
FOLDS = 3
L2 = 0.2
MAX_TRAINING_ROWS = 12_000
#: Probability from which a document is toxic: clean ones keep well below it.
THRESHOLD = 0.2
#: Log-odds of a category without examples.
NEVER = -10.0

# letters, digits and all bytes of other scripts make words; ASCII capitals count as small letters
_OUTSIDE = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_buckets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, end row, row of each word, its bucket)."""
    for a, b, data, offsets in blocks(text):
        w = Words(_LOWER[data], offsets, _OUTSIDE)
        yield a, b, w.row, (w.hashes() % np.uint64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class Linear:
    """Log-odds = bias + weights of the distinct words a document has + weights of the chain's earlier probabilities."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    models: tuple[Linear, ...]

    def probabilities(self, rows: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """(rows, categories); each model sees the probabilities of the models before it."""
        used = np.zeros(BUCKETS, bool)
        for m in self.models:
            used[m.buckets] = True
        hit = used[bucket]
        key = np.unique(row[hit] * BUCKETS + bucket[hit])
        row, bucket = key // BUCKETS, key % BUCKETS
        p = np.zeros((rows, len(self.models)))
        for k, m in enumerate(self.models):
            weight = np.zeros(BUCKETS)
            weight[m.buckets] = m.weights
            z = np.bincount(row, weight[bucket], rows) + p[:, :k] @ m.earlier + m.bias
            p[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p


def _select(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Buckets with the highest chi-squared among the chosen documents."""
    on = chosen[row]
    n, positives = chosen.sum(), y[chosen].sum()
    have = np.bincount(bucket[on], minlength=BUCKETS).astype(float)
    with_y = np.bincount(bucket[on], y[row[on]], BUCKETS)
    expected = have * positives / max(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (with_y - expected) ** 2 * n**2 / (positives * (n - positives) * np.maximum(have, 1) * np.maximum(n - have, 1) / n) / n
    chi = np.where((have >= LEAST_DOCUMENTS) & np.isfinite(chi), chi, 0)
    best = np.argsort(-chi, kind="stable")[:SELECTED]
    return np.sort(best[chi[best] > 0])


def _fit(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, chosen: np.ndarray, earlier: np.ndarray) -> Linear:
    """L2-regularised logistic regression by Newton steps on the chosen documents; without a positive one, never."""
    if not y[chosen].any():
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), NEVER)
    found = _select(row, bucket, y, chosen)
    place = np.full(BUCKETS, -1)
    place[found] = np.arange(len(found))
    x = np.zeros((len(y), len(found) + earlier.shape[1] + 1))
    on = place[bucket] >= 0
    x[row[on], place[bucket[on]]] = 1
    x[:, len(found) : -1] = earlier
    x[:, -1] = 1
    x, y = x[chosen], y[chosen]
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], L2)
    ridge[-1] = 1e-3
    for _ in range(12 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        scaled = (x * np.sqrt(np.maximum(p * (1 - p), 1e-6))[:, None]).astype(np.float32)
        step = np.linalg.solve((scaled.T @ scaled).astype(float) + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return Linear(found, w[: len(found)], w[len(found) : -1], float(w[-1]))


def fit_chain(categories: dict[str, np.ndarray], row: np.ndarray, bucket: np.ndarray) -> Chain:
    """A chain over 0/1 labels in the order given. row and bucket: the distinct words of each document.

    A model is trained with the earlier categories' out-of-fold probabilities, which err as those of new
    documents do; the chain keeps models fitted on all rows.
    """
    n = len(next(iter(categories.values())))
    fold = np.arange(n) % FOLDS
    held = np.zeros((n, 0))
    models = []
    for y in categories.values():
        out = np.zeros(n)
        for f in range(FOLDS):
            m = _fit(row, bucket, y, fold != f, held)
            weight = np.zeros(BUCKETS)
            weight[m.buckets] = m.weights
            z = np.bincount(row, weight[bucket], n) + held @ m.earlier + m.bias
            out[fold == f] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[fold == f]
        models.append(_fit(row, bucket, y, np.ones(n, bool), held))
        held = np.column_stack([held, out])
    return Chain(tuple(categories), tuple(models))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING_ROWS) -> Chain:
    """A chain fitted on at most `most` labelled rows, those whose ids hash lowest.

    categories: 0/1 columns, in the chain's order, over docs and the labels' columns, which are called label_<name>
    there; null counts as 0. The driver gets each chosen document's distinct hashed words; an id that repeats, in either
    table, counts once, with the least of its rows' labels and words.
    """
    named = [F.col(f"`{c}`").alias("_id" if c == id_col else f"label_{c}") for c in labels.columns]
    chosen = labels.filter(F.col(id_col).isNotNull()).select(*named).orderBy(F.xxhash64("_id"), "_id").limit(most)
    ys = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"y{k}") for k, c in enumerate(categories.values())]
    docs = docs.drop("_id", *(f"label_{c}" for c in labels.columns))
    # at most `most` rows: small enough to send to every executor
    rows = docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).select(F.col("_id").cast("string").alias("id"), F.array(*ys).alias("y"), F.col(text_col).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, bucket in word_buckets(batch.column(2)):
                key = np.unique(row * BUCKETS + bucket)
                edges = np.searchsorted(key, np.arange(b - a + 1) * BUCKETS)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((key % BUCKETS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["id", "y", "buckets"])

    found = rows.mapInArrow(measured, "id string, y array<double>, buckets array<int>").groupBy("id").agg(F.min(F.struct("y", "buckets")).alias("least"))
    found = found.select("id", "least.y", "least.buckets").toArrow().combine_chunks().sort_by("id")
    n = found.num_rows
    y = found.column("y").combine_chunks().flatten().to_numpy().reshape(n, len(categories)) if n else np.zeros((0, len(categories)))
    lists = found.column("buckets").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    bucket = lists.flatten().to_numpy().astype(np.int64) if n else np.zeros(0, np.int64)
    return fit_chain({c: y[:, k] for k, c in enumerate(categories)}, np.repeat(np.arange(n), counts), bucket)


def toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, a probability per category, and toxic: whether the chain's last one reaches the threshold.

    Defined cases: null and empty texts have no words and get the models' biases; ids may be null or
    repeat; a category without examples has a low probability for all; very long texts are one block of
    their own. No shuffle; the models (a few thousand numbers) travel with the tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"p_{c}" for c in chain.categories), "toxic"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, bucket in word_buckets(batch.column(1)):
                p = chain.probabilities(b - a, row, bucket)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{n}` double" for n in names[1:-1]) + ", toxic boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scored, schema)

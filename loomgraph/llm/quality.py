"""Quality rules: exact base statistics of whole texts, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import Words, blocks, salted

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, with the direction in which each may move the odds of good quality (0: free).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_char": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "mark_share": 0,
    "bar_share": -1,
    "bang_share": -1,
    "line_words": 0,
    "distinct_share": 0,
}
MAX_TRAINING_ROWS = 20_000
#: Probability of good quality from which a document stays; below one half, so that clean documents stay.
THRESHOLD = 0.3

_COUNTED = {"symbols": SYMBOLS, "upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": b".,;:?'\"-", "bar": b"|", "bang": b"!"}
_TABLES = {name: np.isin(np.arange(256), list(found)) for name, found in _COUNTED.items()}


def _dup_lines(w: Words) -> np.ndarray:
    """Per row, the \\n-split lines with a word that equal an earlier line of the row."""
    ends = np.flatnonzero(w.data == 10)
    starts = np.union1d(w.offsets[:-1], ends + 1)
    starts = starts[starts < len(w.data)]
    bounds = np.union1d(ends, w.offsets[1:])
    stops = bounds[np.searchsorted(bounds, starts, "right")] if len(starts) else starts
    worded = (np.searchsorted(w.starts, starts) < np.searchsorted(w.starts, stops)) & (w.data[starts] != 10)
    starts, stops = starts[worded], stops[worded]
    row = np.searchsorted(w.offsets, starts, "right") - 1
    h = salted(w.hashed(starts, stops), row)
    order = np.argsort(h)
    return np.bincount(row[order[1:]][h[order[1:]] == h[order[:-1]]], minlength=w.rows)


def _repeat_words(w: Words) -> np.ndarray:
    """Per row, the words that lie in a window of five words found twice or more in the row."""
    first, h = w.windows(WINDOW)
    if len(first) < 2:
        return np.zeros(w.rows, np.int64)
    h = salted(h, w.row[first])
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    found = np.zeros(len(h), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    steps = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(steps, first[found], 1)
    np.add.at(steps, first[found] + WINDOW, -1)
    return np.bincount(w.row[np.cumsum(steps[:-1]) > 0], minlength=w.rows)


def statistics(text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts (int64) and the feature matrix of a column of whole texts."""
    base: dict[str, list[np.ndarray]] = {name: [] for name in BASE}
    features = []
    for _, _, data, offsets in blocks(text):
        w = Words(data, offsets)
        whole = np.diff(offsets) - w.per_row((data & 0xC0) == 0x80)
        counts = {name: w.per_row(found[data]) for name, found in _TABLES.items()}
        lines = w.per_row(data == 10) + 1
        # 40 bits of a word's hash under its row's number: enough for a share
        h = np.sort((w.row.astype(np.uint64) << np.uint64(40)) | (w.hashes() >> np.uint64(24)))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        distinct = np.bincount((h[new] >> np.uint64(40)).astype(np.int64), minlength=w.rows)
        one = {
            "n_words": w.counts,
            "word_chars": whole - w.per_row(~w.inside),
            "n_symbols": counts["symbols"],
            "n_dup_lines": _dup_lines(w),
            "n_repeat_words": _repeat_words(w),
        }
        for name in BASE:
            base[name].append(one[name].astype(np.int64))
        words, chars = np.maximum(one["n_words"], 1), np.maximum(whole, 1)
        features.append(
            np.stack(
                [
                    np.log1p(one["n_words"]),
                    one["word_chars"] / words,
                    one["n_symbols"] / chars,
                    one["n_dup_lines"] / lines,
                    one["n_repeat_words"] / words,
                    counts["upper"] / chars,
                    counts["digit"] / chars,
                    counts["mark"] / words,
                    counts["bar"] / words,
                    counts["bang"] / words,
                    one["n_words"] / lines,
                    distinct / words,
                ],
                1,
            )
        )
    if not features:
        return {name: np.zeros(0, np.int64) for name in BASE}, np.zeros((0, len(FEATURES)))
    return {name: np.concatenate(parts) for name, parts in base.items()}, np.concatenate(features)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAINING_ROWS) -> boosting.Trees:
    """Trees fitted on at most `most` labelled rows, those whose ids hash lowest.

    Only their statistics reach the driver (12 doubles a row). Labels that are null are left out; an id that repeats,
    in either table, counts once, with the least of its rows' labels and statistics.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(most)
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # at most `most` ids: small enough to send to every executor
    texts = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_of") == F.col("_id")).select(F.col("_id").alias("id"), F.col("_y").alias("y"), "text")
    kind = labels.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(measured, f"id {kind}, y double, x array<double>").groupBy("id").agg(F.min(F.struct("y", "x")).alias("least")).select("least.y", "least.x").toArrow()
    if not found.num_rows:
        return boosting.fit(np.zeros((0, len(FEATURES))), np.zeros(0), tuple(FEATURES.values()))
    y = found.column("y").to_numpy()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T, y))
    return boosting.fit(x[order], y[order], tuple(FEATURES.values()))


def quality_rules(docs: DataFrame, trees: boosting.Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, the base counts, base_failed, kept and the probability of good quality.

    kept is false where a base rule fails, else true where the trees give `threshold` or more.

    Defined cases: null and empty texts have no words and fail the base rules; ids may be null or
    repeat; very long texts are one block of their own; other columns of docs are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = statistics(batch.column(1))
            failed, p = base_failed(base), trees.probability(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[name]) for name in BASE), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)],
                names=[id_col, *BASE, "base_failed", "kept", "quality"],
            )

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{name} long" for name in BASE) + ", base_failed boolean, kept boolean, quality double"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scored, schema)


def good_documents(docs: DataFrame, trees: boosting.Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, in one pass without a join."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = statistics(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(~base_failed(base) & (trees.probability(x) >= threshold)))

    return docs.mapInArrow(filtered, docs.schema)

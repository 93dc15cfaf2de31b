"""How filters interact: what each order of five filters keeps, and each filter's Shapley share, from counts of failure masks."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, checkpoint, forget, met

#: The filters by bit: few words, few distinct words, many capitals, symbols, a text of a smaller id.
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
ORDERS = tuple("".join(p) for p in permutations(FILTERS))

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _distinct(w: Words) -> np.ndarray:
    """Distinct words of each row, compared as bytes."""
    places = np.zeros(len(w.starts) + 1, np.int32)
    np.cumsum(w.ends - w.starts, out=places[1:])
    # bytes of words in a row: white space is left out
    words = pa.BinaryArray.from_buffers(pa.binary(), len(w.starts), [None, pa.py_buffer(places), pa.py_buffer(w.data[w.inside])])
    coded = words.dictionary_encode()
    pairs = np.unique(w.row.astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
    return np.bincount(pairs // max(1, len(coded.dictionary)), minlength=w.rows)


def text_masks(text: pa.Array) -> np.ndarray:
    """Which of the filters A to D whole texts fail, as bits."""
    out = [np.zeros(0, np.int32)]
    for _, _, data, offsets in blocks(text):
        w = Words(data, offsets)
        points = np.diff(offsets) - w.per_row((data & 0xC0) == 0x80)
        fails = (
            w.counts < LEAST_WORDS,
            100 * _distinct(w) < LEAST_DISTINCT * w.counts,
            100 * w.per_row((data >= 65) & (data <= 90)) > MOST_CAPITALS * points,
            w.per_row(_SYMBOL[data]) > 0,
        )
        out.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
    return np.concatenate(out)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("sha"), pa.array(text_masks(batch.column("text")), pa.int32())], names=["id", "part", "sha", "mask"])


def masks(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row (id, part, mask) per document; bit k of the mask says that it fails filter FILTERS[k].

    Texts are read once and judged where they lie; what moves between tasks is 32 bytes a document: texts are
    identical where their SHA-256 is. Smallest ids are aggregated by it before the exchange, groups of one row are
    not joined, and hot groups are met by broadcast or in parts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    judged = checkpoint(rows.mapInArrow(_judge, "id long, part string, sha binary, mask int"))
    copies = checkpoint(judged.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1))
    with_least = met(judged.withColumn("row", F.monotonically_increasing_id()), ["sha"], copies, "copies", how="left")
    is_copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    found = checkpoint(with_least.select("id", "part", F.when(is_copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask")))
    forget(judged, copies)
    return found


class RemovalPolynomial:
    """The multilinear extension of the number of documents that a set of filters removes.

    With each filter applied with probability x_k, a document that fails the filters m is removed with probability
    1 - prod over m of (1 - x_k); the polynomial sums this over the counts of masks.
    """

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {m: n for m, n in counts.items() if n}

    def at(self, corner: int) -> int:
        """Its value where the filters of `corner` have x = 1 and the others 0: documents removed."""
        return sum(n for m, n in self.counts.items() if m & corner)

    def shapley(self, k: int) -> Fraction:
        """The integral over t from 0 to 1 of the derivative by x_k on the diagonal x = (t, ..., t).

        The derivative of a mask's term with k is prod over its other filters of (1 - x), so (1 - t) ** (size - 1).
        """
        by_size: dict[int, int] = {}
        for m, n in self.counts.items():
            if m >> k & 1:
                by_size[m.bit_count()] = by_size.get(m.bit_count(), 0) + n
        return sum((n * _integral(size - 1) for size, n in by_size.items()), Fraction(0))


def _integral(power: int) -> Fraction:
    """Of (1 - t) ** power over 0 to 1, term by term."""
    choose = [factorial(power) // (factorial(j) * factorial(power - j)) for j in range(power + 1)]
    return sum((Fraction((-1) ** j * c, j + 1) for j, c in enumerate(choose)), Fraction(0))


def audit(part: str, every: dict[int, int], good: dict[int, int], toxic: dict[int, int]) -> list[tuple]:
    """The rows of one part: for each order of the filters and each step what is kept, removed and lost there."""
    polynomials = [RemovalPolynomial(c) for c in (every, good, toxic)]
    total = sum(every.values())
    corners = {c: [p.at(c) for p in polynomials] for c in range(1 << len(FILTERS))}
    shapley = [factorial(len(FILTERS)) * polynomials[0].shapley(k) for k in range(len(FILTERS))]
    rows = []
    for order in ORDERS:
        corner = 0
        for step, name in enumerate(order, 1):
            k = FILTERS.index(name)
            before, after = corners[corner], corners[corner | 1 << k]
            removed = after[0] - before[0]
            fails = polynomials[0].at(1 << k)
            rows.append((part, order, step, total - after[0], removed, fails - removed, every.get(1 << k, 0), after[1] - before[1], after[2] - before[2], int(shapley[k])))
            corner |= 1 << k
    return rows


def _audit(counts: pd.DataFrame) -> pd.DataFrame:
    found = [dict(zip(counts["mask"].tolist(), counts[c].tolist(), strict=True)) for c in ("n", "good", "toxic")]
    return pd.DataFrame(audit(counts["part"].iloc[0], *found), columns=[c.split(" ")[0] for c in _RESULT.split(", ")])


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per part, filter order and step; see audit().

    Plan: one narrow pass over texts gives masks; they meet the labels by id, are counted by (part, mask) with partial
    sums, and at most 32 counts a part become its removal polynomials. From there on nothing depends on the
    number of documents: survivors are corner values, Shapley shares exact integrals, scaled by 120.

    Defined cases: null text and part count as empty; a text is a copy if a row with a smaller id has it, so rows
    that repeat the smallest id, and rows without an id, are none, and a null id is smaller than none; an id with several label
    rows is good (toxic) if one of them is; labels without an id or a document count for nothing; an empty table
    gives no rows. Other columns may have any names.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("id IS NOT NULL AND (good OR toxic)")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counts = (
        masks(docs, id_col, part_col, text_col).join(marks, "id", "left")
        .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    )
    return counts.groupBy("part").applyInPandas(_audit, _RESULT)

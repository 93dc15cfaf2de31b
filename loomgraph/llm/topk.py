"""Exact top-k inner products by no-random-access aggregation over sorted lists (Fagin, Lotem, Naor 2001)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, forget

#: Components of a block's vectors, and of a chunk's queries: rows of tables, about 1.5 MB and 0.1 MB.
BLOCK_VALUES, CHUNK_VALUES = 1 << 17, 1 << 14
#: Blocks that stay in a task, and chunks that pass by them there.
BLOCKS, CHUNKS = 4, 32
#: Shares of each list that have been read when bounds are compared.
DEPTHS = (0.25, 0.5, 0.75, 1.0)
#: A query's reading ends when at most this share of a block's vectors can still qualify.
OPEN_SHARE = 1 / 16
#: Whole numbers up to here are exact in a double.
EXACT = 1 << 53

_BLOCKS = "block string, n int, dims int, ids binary, list_order binary, list_values binary"
_CHUNKS = "block string, n int, dims int, ids binary, list_values binary"


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of each component x as a double; what lies beyond a long is held at its ends."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(by))).cast("long"))


def _sound(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def _matrices(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of rows (id, vector) in pieces of about `values` components; shorter vectors end in zeros."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    size = 0

    def piece() -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(rows), max(map(len, rows))), np.int64)
        for k, row in enumerate(rows):
            out[k, : len(row)] = row
        return np.array(ids, np.int64), out

    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        for one, end, length in zip(batch.column(0).to_numpy(), ends, np.diff(ends, prepend=0), strict=True):
            if rows and size + length > values:
                yield piece()
                ids, rows, size = [], [], 0
            ids.append(one)
            rows.append(flat[end - length : end])
            size += max(1, length)
    if rows:
        yield piece()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: for each component a list of all vectors of the block, largest value first."""
    for k, (ids, x) in enumerate(_matrices(batches, BLOCK_VALUES)):
        order = np.argsort(-x.T, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(x.T, order, 1)
        yield pa.RecordBatch.from_pydict(
            {"block": [f"{TaskContext.get().partitionId()}-{k}"], "n": pa.array([len(ids)], pa.int32()), "dims": pa.array([x.shape[1]], pa.int32()), "ids": [ids.tobytes()], "list_order": [order.tobytes()], "list_values": [values.tobytes()]}
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, (ids, x) in enumerate(_matrices(batches, CHUNK_VALUES)):
        yield pa.RecordBatch.from_pydict({"block": [f"{TaskContext.get().partitionId()}-{k}"], "n": pa.array([len(ids)], pa.int32()), "dims": pa.array([x.shape[1]], pa.int32()), "ids": [ids.tobytes()], "list_values": [x.tobytes()]})


@dataclass
class Block:
    """Sorted lists of one block: order[d] are its vectors by falling component d, values[d] these components."""

    ids: np.ndarray
    order: np.ndarray
    values: np.ndarray
    _whole: np.ndarray | None = field(default=None, repr=False)

    def whole(self) -> np.ndarray:
        """The vectors, as reading all lists to their ends gives them."""
        if self._whole is None:
            self._whole = np.zeros((len(self.ids), len(self.order)), np.int64)
            np.put_along_axis(self._whole, self.order.T.astype(np.int64), self.values.T, 0)
        return self._whole


class Read:
    """What the lists have told so far, read from one end: the gain of each seen entry over the list's far end."""

    def __init__(self, block: Block, q: np.ndarray, falling: bool) -> None:
        step = 1 if falling else -1
        self.order, self.values = block.order[:, ::step], block.values[:, ::step].astype(np.float64)
        self.q = q
        self.least = self.values[:, -1]
        self.gain = np.zeros((len(block.ids), len(self.order)))
        self.unseen = np.ones_like(self.gain)
        self.depth = 0

    def to(self, depth: int) -> None:
        """Reads on in all lists, in their order."""
        rows, part = self.order[:, self.depth : depth], slice(self.depth, depth)
        lists = np.arange(len(rows))[:, None]
        self.gain[rows, lists] = self.values[:, part] - self.least[:, None]
        self.unseen[rows, lists] = 0
        self.depth = depth

    def at_least(self, q: np.ndarray) -> np.ndarray:
        return self.gain @ q.T + q @ self.least

    def open(self, q: np.ndarray) -> np.ndarray:
        """What unread entries can add at most: each is no better than the last one read in its list."""
        return self.unseen @ (q * (self.values[:, self.depth - 1] - self.least)).T


def nra(block: Block, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows of the block, their exact scores): all rows that can be among the query's k best.

    A query reads the list of a component from its largest value where the query's component is positive, else from
    its smallest. After each depth every vector has a lower bound (unread components at their list's far end) and
    an upper bound (unread components at the last value read). The k-th lower bound, or the floor that earlier blocks
    have set, is what outsiders must reach; when few vectors reach it, the reading ends and their scores are
    resolved. Rows with an equal bound stay, as ties go by id. own: the row of the query itself, or -1.
    """
    n, dims = len(block.ids), len(block.order)
    q = q[:, :dims] if q.shape[1] > dims else np.pad(q, ((0, 0), (0, dims - q.shape[1])))
    largest = int(np.abs(block.values.astype(np.float64)).max(initial=0)) * int(np.abs(q.astype(np.float64)).max(initial=0))
    if largest * max(1, dims) * 4 >= EXACT:  # beyond doubles: Python's integers, without bounds
        scores = block.whole().astype(object) @ q.astype(object).T if dims else np.zeros((n, len(q)), object)
        ends = np.iinfo(np.int64)
        for i in range(len(q)):
            rows = np.delete(np.arange(n), own[i]) if own[i] >= 0 else np.arange(n)
            yield i, rows, np.array([min(max(int(s), ends.min), ends.max) for s in scores[rows, i]], np.int64)
        return
    at = np.arange(len(q))
    exact = q.astype(np.float64)
    whole = block.whole().astype(np.float64)
    down, up = Read(block, exact, True) if dims else None, Read(block, exact, False) if dims else None
    for share in DEPTHS:
        if not len(at):
            return
        depth = n if share == 1 or not dims else max(1, int(n * share))
        if dims:
            positive, negative = np.maximum(exact[at], 0), np.minimum(exact[at], 0)
            down.to(depth), up.to(depth)
            lower = down.at_least(positive) + up.at_least(negative)
            upper = lower + down.open(positive) + up.open(negative) if depth < n else lower.copy()
        else:
            lower, upper = np.zeros((n, len(at))), np.zeros((n, len(at)))
        mine = np.flatnonzero(own[at] >= 0)
        lower[own[at][mine], mine] = upper[own[at][mine], mine] = -np.inf
        reach = floor[at]
        if n >= k:
            reach = np.maximum(reach, np.partition(lower, n - k, axis=0)[n - k])
        can = (upper >= reach) & (upper > -np.inf)
        ends_here = np.ones(len(at), bool) if depth == n else can.sum(0) <= max(k, n * OPEN_SHARE)
        for j in np.flatnonzero(ends_here):
            rows = np.flatnonzero(can[:, j])
            yield int(at[j]), rows, (whole[rows] @ exact[at[j]]).astype(np.int64)
        at = at[~ends_here]
        if depth == n:
            return


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a cell come first and stay; chunks pass by all of them, each block with the floor of those before."""
        cell, blocks = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["g"], r["h"]) != cell:
                    cell, blocks = (r["g"], r["h"]), []
                ids = np.frombuffer(r["ids"], np.int64)
                values = np.frombuffer(r["list_values"], np.int64)
                if not r["is_query"]:
                    blocks.append(Block(ids, np.frombuffer(r["list_order"], np.int32).reshape(r["dims"], -1) if r["dims"] else np.zeros((0, r["n"]), np.int32), values.reshape(r["dims"], -1) if r["dims"] else np.zeros((0, r["n"]), np.int64)))
                    continue
                q = values.reshape(r["n"], r["dims"])
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
                floor = np.full(len(ids), -np.inf)
                for b in blocks:
                    place = {v: i for i, v in enumerate(b.ids.tolist())}
                    own = np.array([place.get(v, -1) for v in ids.tolist()])
                    for i, rows, scores in nra(b, q, own, k, floor):
                        s, v = np.concatenate([best[i][0], scores]), np.concatenate([best[i][1], b.ids[rows]])
                        first = np.lexsort((v, ~s))[:k]  # ~s falls as s grows and never overflows
                        best[i] = s[first], v[first]
                        if len(first) == k:
                            floor[i] = float(s[first[-1]]) if abs(int(s[first[-1]])) < EXACT else -np.inf
                found = [len(s) for s, _ in best]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, found), "vec_id": np.concatenate([v for _, v in best]), "score": np.concatenate([s for s, _ in best])})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k highest scores of each query among all other rows: query_id, rank (from 1), the id, score.

    Score: the inner product of the components' floor(scale * x). is_query is a condition on the id column.

    Plan: one exchange by id makes an id one row; each task cuts its rows into blocks and writes for each block one
    sorted list a component. Queries become chunks. Blocks, four a group on average, meet all chunks in a grid of
    groups and chunk classes: each group's blocks go to its cells and stay there, chunks stream past and take the k-th
    best score on from block to block. A cell sends k rows a query and group, and the k best of these remain.
    Memory is bounded by a group's blocks and a chunk whatever the input; the work is queries times rows, as asked.

    Defined cases: vectors that are null or hold a null, NaN or infinite component, and rows without an id, take no
    part; an id that repeats is one row, with its smallest vector; shorter vectors count as ending in zeros, and
    empty ones score 0; ties go to the smaller id; components and scores beyond a long are held at its ends; fewer
    than k other rows give fewer ranks; an empty table gives none. Other columns may have any names.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), is_query.alias("q")).filter(_sound(F.col("v")) & F.col("id").isNotNull())
    one = rows.select(F.col("id").cast("long"), scaled(F.col("v"), scale).alias("v"), "q").groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    index = checkpoint(one)
    blocks = checkpoint(index.select("id", "v").mapInArrow(_lists, _BLOCKS), 8)
    asked = index.filter("q").select("id", "v")
    n_blocks, n_asked = blocks.count(), asked.count()
    chunks = checkpoint(asked.repartition(max(1, n_asked // (16 * 256)), "id").mapInArrow(_chunks, _CHUNKS), 8)
    groups, classes = -(-max(1, n_blocks) // BLOCKS), -(-max(1, chunks.count()) // CHUNKS)
    here = blocks.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("h"), F.lit(False).alias("is_query"), "*")
    passing = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("block"), F.lit(classes)).cast("int").alias("h"), F.lit(True).alias("is_query"), "*").withColumn("list_order", F.lit(None).cast("binary"))
    cells = here.unionByName(passing).repartitionById(groups * classes, F.col("g") * classes + F.col("h")).sortWithinPartitions("g", "h", "is_query", "block")
    found = checkpoint(cells.mapInArrow(_meet(k), "query_id long, vec_id long, score long"), 8)
    forget(index, blocks, chunks)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")

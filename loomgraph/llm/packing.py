"""Hierarchical multi-length packing of token streams into power-of-two windows."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Context sizes, longest first; each a power of two.
TIERS = (1024, 512, 256, 128)
#: Tokens that are packed together; bounds a task's memory.
BLOCK_TOKENS = 1 << 20
#: Tokens of a training step, over which a block's sequences are dealt evenly.
STEP_TOKENS = 1 << 16


@dataclass(slots=True)
class Piece:
    """`length` ids of a document from `start`; they stand in the block's ids from `at`."""

    doc: int
    start: int
    length: int
    at: int


class Shelf:
    """Pieces of one tier, sorted by length; equal lengths leave first in, first out."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.next = 0
        self.held: list[tuple[int, int, Piece]] = []
        for p in sorted(pieces, key=lambda p: p.length):
            self.held.append((p.length, self.next, p))
            self.next += 1

    def add(self, p: Piece) -> None:
        self.next += 1
        insort(self.held, (p.length, self.next, p))

    def longest(self) -> Piece:
        return self.held.pop()[2]

    def fitting(self, most: int) -> Piece | None:
        """The longest piece of at most `most` ids."""
        k = bisect_right(self.held, most, key=lambda h: h[0]) - 1
        return self.held.pop(k)[2] if k >= 0 else None

    def over(self, least: int) -> Piece | None:
        """The shortest piece of more than `least` ids."""
        k = bisect_right(self.held, least, key=lambda h: h[0])
        return self.held.pop(k)[2] if k < len(self.held) else None


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """Number of the smallest tier that holds `length` ids."""
    return max(k for k, t in enumerate(tiers) if t >= length)


def plan(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows (their pieces in order), and the pieces of the one window that could not be filled.

    Long pieces are cut at the longest window; what remains goes to the smallest tier that holds it.
    From the longest tier down, each tail opens a window of its tier. The gap takes the longest whole
    tails of shorter tiers that fit; what is then open takes the head of the shortest longer tail, whose
    rest is routed anew. So every window is full except the last.
    """
    windows: list[list[Piece]] = []
    tails: list[list[Piece]] = [[] for _ in tiers]
    for p in pieces:
        whole = p.length - p.length % tiers[0]
        windows += [[Piece(p.doc, p.start + k, tiers[0], p.at + k)] for k in range(0, whole, tiers[0])]
        if p.length > whole:
            tails[tier_of(p.length - whole, tiers)].append(Piece(p.doc, p.start + whole, p.length - whole, p.at + whole))
    shelves = [Shelf(t) for t in tails]
    for k, size in enumerate(tiers):
        while shelves[k].held:
            window = [shelves[k].longest()]
            gap = size - window[0].length
            while gap:
                for s in shelves[k + 1 :]:
                    if p := s.fitting(gap):
                        break
                else:
                    p = shelves[k].fitting(gap) if k + 1 == len(tiers) else None
                    if not p:
                        for s in [*reversed(shelves[k + 1 :]), shelves[k]]:
                            if p := s.over(gap):
                                break
                    if not p:
                        return windows, window
                    if p.length > gap:
                        rest = Piece(p.doc, p.start + gap, p.length - gap, p.at + gap)
                        shelves[tier_of(rest.length, tiers)].add(rest)
                        p = Piece(p.doc, p.start, gap, p.at)
                window.append(p)
                gap -= p.length
            windows.append(window)
    return windows, []


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: where it comes from, its crc32, and its place in a sequence.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's size),
    step_group. Each input partition packs its own documents
    block by block (BLOCK_TOKENS ids), without a shuffle; the one unfilled window of a block is carried
    into the next, so a partition has one padded sequence at most. sequence_id is the partition's number
    times 2**32 plus a counter, so a task that is run again gives the same numbers. Sequences of a block are
    dealt over its step groups from long to short in turn, so groups have like token counts and like
    mixtures of context sizes.

    Defined cases: null and empty texts are one end id; ids may be null or repeat (each row is a document
    of its own); an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        sequences = steps = 0
        carried: list[tuple[object, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document

        def emit(doc_ids: list, totals: list[int], starts: list[int], ids: np.ndarray, last: bool) -> pa.RecordBatch:
            nonlocal sequences, steps, carried
            places = np.cumsum([0, *starts]).tolist()  # starts: the lengths of the pieces here
            pieces = [Piece(d, first[d], n, places[d]) for d, n in enumerate(starts) if n]
            windows, rest = plan(pieces, tiers)
            if rest and last:
                windows.append(rest)
            elif rest:
                carried = [(doc_ids[p.doc], p.start, ids[p.at : p.at + p.length].copy(), totals[p.doc]) for p in rest]
            sizes = [sum(p.length for p in w) for w in windows]
            groups = max(1, -(-sum(sizes) // step_tokens))
            order = sorted(range(len(windows)), key=lambda k: -sizes[k])
            group = dict(zip(order, (min(r, 2 * groups - 1 - r) for r in (n % (2 * groups) for n in range(len(order)))), strict=True))
            out: list[list] = [[] for _ in range(9)]
            for k, window in enumerate(windows):
                offset = 0
                for p in window:
                    crc = zlib.crc32(ids[p.at : p.at + p.length].astype("<u4"))
                    for column, v in zip(out, (doc_ids[p.doc], p.start, p.length, crc, totals[p.doc], base + sequences, offset, tiers[tier_of(sizes[k], tiers)], base + steps + group[k]), strict=True):
                        column.append(v)
                    offset += p.length
                sequences += 1
            steps += groups
            return pa.RecordBatch.from_arrays([pa.array(out[0], id_type), *(pa.array(c, pa.int64()) for c in out[1:])], names=names)

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        id_type = pa.int64()
        encode = encoder(tokenizer).encode
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        first: list[int] = []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal carried, held, first
            doc_ids, totals, sizes, parts, first = [], [], [], [], []
            for d, start, ids, total in carried:
                doc_ids.append(d), totals.append(total), sizes.append(len(ids)), parts.append(ids), first.append(start)
            carried = []
            for ds, ns, ids in held:
                doc_ids += ds
                totals += ns.tolist()
                sizes += ns.tolist()
                first += [0] * len(ds)
                parts.append(ids)
            held = []
            return emit(doc_ids, totals, sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint32), last)

        tokens = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids, n = encode(part.column(1))
                held.append((part.column(0).to_pylist(), n + 1, np.insert(ids, np.cumsum(n), end_id)))
                tokens += len(ids) + len(n)
                if tokens >= BLOCK_TOKENS:
                    tokens = 0
                    yield flush(False)
        if held or carried:
            yield flush(True)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"))
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(packed, schema)

"""How far the sources of a language differ in their words: exact shares of terms, compared in tournament rounds."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, checkpoint, forget, met

#: A language keeps the terms of so many of its documents.
LEAST_DOCUMENTS = 30
#: Terms that a group's report names.
MOST_TERMS = 50
#: Shares are whole numbers of this unit; a count gets so many more occurrences.
UNIT, MORE = 10**9, 5
#: Seats of a language's tournament at most; a seat holds several sources where there are more.
SEATS = 32
#: Counts of a slice of terms, and shares that a seat holds at a time, on average.
SLICE_COUNTS, SEAT_SHARES = 1 << 16, 1 << 18
#: Distinct terms and sums that a Python worker holds before it passes them on.
HELD_TERMS, HELD_SUMS = 400_000, 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTED = "lang string, source string, term string, n long, docs long"
_ENCODED = "lang string, slice long, source string, vector binary"
_MET = "lang string, part string, source string, item string, value long"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row of each term, the terms) of a run of texts."""
    inside = _LETTER[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=places[1:])
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(_LOWER[data[inside]]))
    return np.searchsorted(offsets, starts, "right") - 1, terms


class _Sums:
    """Occurrences and documents by (group, term) of what a worker has read since it last passed them on."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, groups: np.ndarray, row: np.ndarray, terms: pa.Array) -> None:
        coded = terms.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in distinct), np.int64, len(distinct))
        key, n = np.unique(row.astype(np.int64) * max(1, len(distinct)) + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(key, max(1, len(distinct)))
        self.parts.append(self._summed(np.stack([(groups[row] << 32) | number[code], n, np.ones_like(n)])))
        self.held += self.parts[-1].shape[1]
        if self.held > HELD_SUMS:
            self.parts = [self._summed(np.concatenate(self.parts, axis=1))]
            self.held = self.parts[0].shape[1]

    @staticmethod
    def _summed(rows: np.ndarray) -> np.ndarray:
        key, at = np.unique(rows[0], return_inverse=True)
        out = np.zeros((3, len(key)), np.int64)
        out[0] = key
        np.add.at(out[1], at, rows[1])
        np.add.at(out[2], at, rows[2])
        return out

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or self.held > HELD_SUMS // 2

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            key, n, docs = self._summed(np.concatenate(self.parts, axis=1))
            langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
            terms = pa.array(list(self.terms), pa.string())
            for k in range(0, len(key), 50_000):
                group, term = pa.array(key[k : k + 50_000] >> 32), pa.array(key[k : k + 50_000] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(n[k : k + 50_000]), pa.array(docs[k : k + 50_000])], names=["lang", "source", "term", "n", "docs"])
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, source, term), and a row without a term for every (lang, source)."""
    sums, seen = _Sums(), set()
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for i, k, data, offsets in blocks(batch.column(2), 4 << 20):
            groups = np.array([sums.groups.setdefault(p, len(sums.groups)) for p in pairs[i:k]], np.int64)
            sums.add(groups, *_terms(data, offsets))
            if sums.full():
                seen |= sums.groups.keys()
                yield from sums.passed_on()
    seen |= sums.groups.keys()
    yield from sums.passed_on()
    rows = sorted(seen)
    yield pa.RecordBatch.from_pydict({"lang": pa.array([g[0] for g in rows], pa.string()), "source": pa.array([g[1] for g in rows], pa.string()), "term": pa.nulls(len(rows), pa.string()), "n": pa.array([0] * len(rows), pa.int64()), "docs": pa.array([0] * len(rows), pa.int64())})


def _packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between term numbers and counts, as compressed integers."""
    return zlib.compress(np.concatenate([np.diff(numbers, prepend=0), counts]).astype(np.int64).tobytes(), 1)


def _unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(zlib.decompress(vector), np.int64) if vector else np.zeros(0, np.int64)
    return np.cumsum(found[: len(found) // 2]), found[len(found) // 2 :]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, slice, term, source, n), sorted by the first three, become one vector a group and one row of terms (source null)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for (lang, number), found in groupby(rows(), lambda r: r[:2]):
        terms: list[str] = []
        vectors: dict[str, list[tuple[int, int]]] = {}
        totals: list[int] = []
        for _, _, term, source, n in found:
            if not terms or terms[-1] != term:
                terms.append(term)
                totals.append(0)
            totals[-1] += n
            vectors.setdefault(source, []).append((len(terms) - 1, n))
        coded = zlib.compress("\n".join(terms).encode(), 1)  # no term holds a line break
        every = _packed(np.arange(len(terms)), np.array(totals))
        yield pa.RecordBatch.from_pydict(
            {
                "lang": [lang] * (len(vectors) + 1),
                "slice": [number] * (len(vectors) + 1),
                "source": pa.array([*vectors, None], pa.string()),
                "vector": [*(_packed(*np.array(v, np.int64).T) for v in vectors.values()), len(every).to_bytes(8, "little") + every + coded],
            }
        )


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + MORE) / (total + MORE * kept)) by long division: nothing exceeds a long."""
    by = total + MORE * kept
    out, rest = np.divmod(counts + MORE, by)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + step
    return out + 1


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What meets in a seat, slice by slice: first the terms, then the seat's own groups, then its guests by round.

    The seat's shares stay; each group is compared with those that sit there already (own groups) or with all of
    them (guests), and each comparison counts for both. Each own group's heap keeps its terms above the
    language's share.
    """
    cell, seat = None, None
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if (r["lang"], r["slice"], r["host"]) != cell:
                cell, seat = (r["lang"], r["slice"], r["host"]), _Seat(r["lang"], r["kept"])
            if r["round"] < 0:
                seat.open(r["vector"], r["total"])
            else:
                out += seat.meet(r["source"], r["vector"], r["total"], stays=r["round"] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["lang", "part", "source", "item", "value"])


class _Seat:
    def __init__(self, lang: str, kept: int) -> None:
        self.lang, self.kept = lang, kept
        self.sources: list[str] = []
        self.shares: list[np.ndarray] = []
        self.terms: list[str] = []
        self.whole = np.zeros(0, np.int64)

    def open(self, vector: bytes | None, total: int) -> None:
        """The slice's terms and the language's shares of them."""
        if vector:
            size = int.from_bytes(vector[:8], "little")
            self.terms = zlib.decompress(vector[8 + size :]).decode().split("\n")
            self.whole = shares(_unpacked(vector[8 : 8 + size])[1], total, self.kept)

    def meet(self, source: str, vector: bytes | None, total: int, stays: bool) -> list[tuple]:
        numbers, found = _unpacked(vector)
        counts = np.zeros(len(self.terms), np.int64)
        counts[numbers] = found
        own = shares(counts, total, self.kept) if self.terms else counts
        out = []
        for peer, theirs in zip(self.sources, self.shares, strict=True):
            value = int(np.abs(own - theirs).sum())
            out += [(self.lang, "pair", source, peer, value), (self.lang, "pair", peer, source, value)]
        if stays:
            self.sources.append(source)
            self.shares.append(own)
            over = own[numbers] - self.whole[numbers] if self.terms else numbers
            above = np.flatnonzero(over > 0)
            first = heapq.nsmallest(MOST_TERMS, zip((-over[above]).tolist(), numbers[above].tolist(), strict=True))  # terms are numbered in UTF-8 order
            out += [(self.lang, "term", source, self.terms[k], -v) for v, k in first]
        return out


def _round(a: Column, b: Column, seats: Column) -> Column:
    """The round, from 1, in which two seats meet by the circle method: the last seat of an even number stands still."""
    turns = seats - F.when(seats % 2 == 0, 1).otherwise(0)
    fixed = F.when(seats % 2 == 0, seats - 1).otherwise(-1)
    return F.when(a == fixed, (b * 2) % turns).when(b == fixed, (a * 2) % turns).otherwise((a + b) % turns) + 1


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's shares of the language's terms lie from others'.

    part `pair`: item is each other source of the language, value the sum of |p - q| over all kept terms. part
    `term`: item is a term of the source that is more frequent there than in the language, value the difference,
    the MOST_TERMS largest. Ranks go by falling value, then by item.

    Plan: texts are read once; workers sum occurrences and documents by (lang, source, term) before one exchange by
    (lang, term), where terms of too few documents go. The rest is cut into slices of terms by a hash, and each
    (language, slice) encodes one compressed vector a source. The sources of a language take their seats, and a
    tournament by the circle method says who meets in which round and who is the host: a seat's vectors stay in its
    partition, peers' vectors come by in the order of rounds, and every meeting serves both directions, so each
    pair of seats meets once. Slices add up, as the sums are whole numbers. All rounds are one exchange: no barrier
    between them, and a lost executor's cells are made again from the written vectors. A task holds one
    seat of one slice.

    Defined cases: null text, language and source count as empty; a group without terms takes part with the share
    of no occurrence; a language that keeps no term gives pairs of value 0; a single source gives no pairs; every row
    is a document, repeated ones too; an empty table gives no rows. Other columns may have any names.
    """
    counted = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]).mapInArrow(_count, _COUNTED)
    by_term = Window.partitionBy("lang", "term")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = checkpoint(summed.withColumn("all", F.sum("docs").over(by_term)).filter(F.col("term").isNull() | (F.col("all") >= least_documents)).select("lang", "term", "source", "n"))
    kept = seen.filter("term IS NOT NULL")
    groups = checkpoint(seen.groupBy("lang", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("order", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    of_lang = kept.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("rows")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("rows").alias("rows"))
    a_seat = F.ceil(F.col("sources") / SEATS)
    langs = checkpoint(
        groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("total").alias("lang_total"))
        .join(of_lang, "lang", "left")
        .select("lang", "sources", "lang_total", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("rows", F.lit(0)).alias("rows"), a_seat.cast("int").alias("a_seat"), F.ceil(F.col("sources") / a_seat).cast("int").alias("seats"))
        .withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("rows") / SLICE_COUNTS), F.ceil(F.col("kept") * F.col("a_seat") / SEAT_SHARES)).cast("long"))
    )
    sliced = met(kept, ["lang"], langs.select("lang", "slices", F.greatest("rows", F.lit(1)).alias("met_rows")), "met_rows")
    vectors = checkpoint(
        sliced.select("lang", F.pmod(F.xxhash64("term"), "slices").alias("slice"), "term", "source", "n").repartition("lang", "slice").sortWithinPartitions("lang", "slice", "term").mapInArrow(_encode, _ENCODED)
    )
    seated = groups.join(langs, "lang").select("lang", "source", F.col("total"), "kept", "seats", (F.col("order") / F.col("a_seat")).cast("int").alias("seat"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")).join(vectors.filter("source IS NOT NULL"), ["lang", "slice", "source"], "left")
    columns = ("lang", "slice", "host", "round", "source", "total", "kept", "vector")
    own = seated.select("lang", "slice", F.col("seat").alias("host"), F.lit(0).alias("round"), "source", "total", "kept", "vector")
    hosts = F.explode(F.sequence(F.lit(0), F.col("seats") - 1)).alias("host")
    guests = (
        seated.select("*", hosts)
        # of two seats the smaller is the host where their sum is odd
        .filter(F.col("host") != F.col("seat")).filter(((F.col("host") + F.col("seat")) % 2 == 1) == (F.col("host") < F.col("seat")))
        .withColumn("round", _round(F.col("host"), F.col("seat"), F.col("seats"))).select(*columns)
    )
    opening = langs.select("lang", "lang_total", "kept", "seats", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")).join(vectors.filter("source IS NULL").select("lang", "slice", "vector"), ["lang", "slice"], "left")
    opening = opening.select("lang", "slice", hosts, F.lit(-1).alias("round"), F.lit(None).cast("string").alias("source"), F.col("lang_total").alias("total"), "kept", "vector")
    meetings = checkpoint(opening.unionByName(own).unionByName(guests).repartition("lang", "slice", "host").sortWithinPartitions("lang", "slice", "host", "round", "source").mapInArrow(_meetings, _MET), 200)
    forget(seen, groups, langs, vectors)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = meetings.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = meetings.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= MOST_TERMS)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")

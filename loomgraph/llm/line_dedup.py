"""Substring deduplication by global digests of normalised lines and of units that the words themselves delimit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, _INVERSE, Words, _power, blocks, checkpoint, met, mix, strings

#: Words from which on a passage goes that stands anywhere in the text. An equal passage of so many words always
#: holds a whole unit: 2 * SPREAD + LEAST + CUT - 2 = 45.
MIN_WORDS = 45
#: Words from which on a run of whole repeated lines goes.
MIN_LINE_WORDS = 5
#: A unit starts where the hash of CUT words is the least of SPREAD neighbours, and has LEAST words or more.
CUT, SPREAD, LEAST = 3, 19, 6
#: Words around a unit in which the end of a passage is looked for: no equal passage reaches further beyond its last unit.
AROUND = SPREAD + LEAST + CUT
#: Digests that are broadcast at most: those with a HOT-th of all repeated units.
HOT = 1024
#: Ends of passages that meet one copy of their unit's surroundings.
GROUP = 512

_SPANS = "array<struct<start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SECOND = np.uint64(0x6A09E667F3BCC909)
_LINE = np.uint64(0xBB67AE8584CAA73B)
_LOW = (1 << 20) - 1


class Ranges:
    """Hashes of ranges of words, from sums over all words of a run of texts."""

    def __init__(self, h: np.ndarray) -> None:
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power(_BASE, len(h) + 1)[: len(h)], out=self.sums[1:])
        self.back = _power(_INVERSE, len(h) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _least(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbouring keys: two running minima over blocks of n."""
    whole = -(-len(keys) // n) * n
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    parts = padded.reshape(-1, n)
    ahead = np.minimum.accumulate(parts, 1).ravel()
    behind = np.minimum.accumulate(parts[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: len(keys) - n + 1], ahead[n - 1 : len(keys)])


def cuts(w: Words, ranges: Ranges) -> np.ndarray:
    """Words before which a unit may start: the least of any SPREAD neighbouring hashes of CUT words, the last of equal ones."""
    first = np.flatnonzero(w.row[: max(len(w.row) - CUT + 1, 0)] == w.row[CUT - 1 :])
    if len(first) < SPREAD:
        return np.zeros(0, np.int64)
    at = np.arange(len(first)) & _LOW
    keys = (ranges(first, first + CUT) & ~np.uint64(_LOW)) | (_LOW - at).astype(np.uint64)
    inside = np.flatnonzero(w.row[first[: len(first) - SPREAD + 1]] == w.row[first[SPREAD - 1 :]])
    chosen = _LOW - (_least(keys, SPREAD)[inside] & np.uint64(_LOW)).astype(np.int64)
    flags = np.zeros(len(first), bool)
    flags[inside + ((chosen - inside) & _LOW)] = True
    return first[flags]


def units(w: Words) -> dict[str, np.ndarray]:
    """All units of a run of texts: row, start and length (words), line, back, and a digest of 128 bits (d1, d2).

    A line with words is a unit. Others go from a cut to the first cut LEAST words or more later, so they overlap or
    meet, and equal passages have equal units but for those at their ends. back: words from the same unit's first place in the text.
    """
    h = w.hashes()
    one, two = Ranges(h), Ranges(mix(h ^ _SECOND))
    line = np.searchsorted(np.flatnonzero(w.data == 10), w.starts)
    edges = np.append(np.flatnonzero(np.diff(line, prepend=-1) | np.diff(w.row, prepend=-1)), len(h))
    at = cuts(w, one)
    to = np.searchsorted(at, at + LEAST)
    good = to < len(at)
    good[good] = w.row[at[to[good]]] == w.row[at[good]]
    start = np.concatenate([edges[:-1], at[good]])
    end = np.concatenate([edges[1:], at[to[good]]])
    is_line = np.arange(len(start)) < len(edges) - 1
    d1 = one(start, end) ^ np.where(is_line, _LINE, np.uint64(0))
    row = w.row[start] if len(start) else start
    order = np.lexsort((start, d1, row))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(d1[order]) != 0) | (np.diff(row[order]) != 0)
    earliest = np.empty(len(order), np.int64)
    if len(order):
        earliest[order] = start[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return {"row": row, "start": start - w.bounds[row], "length": end - start, "line": is_line, "back": start - earliest, "d1": d1, "d2": two(start, end)}


def _unit_rows(keyed: DataFrame) -> DataFrame:
    """The units of (id, h, text): id, h, start, length, line, back, d1, d2."""
    kind = keyed.schema["id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in blocks(pc.utf8_lower(strings(batch.column(2)))):
                u = units(Words(data, offsets))
                rows = pa.array(u["row"] + a)
                numbers = [pa.array(u[n].astype(np.int32)) for n in ("start", "length")] + [pa.array(u["line"]), pa.array(u["back"].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *numbers, pa.array(u["d1"].view(np.int64)), pa.array(u["d2"].view(np.int64))],
                    names=["id", "h", "start", "length", "line", "back", "d1", "d2"],
                )

    return keyed.mapInArrow(cut_up, f"id {kind}, h int, start int, length int, line boolean, back int, d1 long, d2 long")


def repeated_units(keyed: DataFrame) -> DataFrame:
    """The units whose digest occurs twice or more, with n (how often) and first (the smallest id that has it); written once.

    The first document of each digest comes from a partial aggregation, so a unit that a third of all documents have
    costs a row per task. Units then meet it by a join on the digest, the hottest HOT digests at most by a broadcast.
    """
    rows = _unit_rows(keyed)
    firsts = checkpoint(rows.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return checkpoint(met(rows, ["d1", "d2"], firsts, "n", HOT))


def _ends(later: DataFrame) -> DataFrame:
    """The later units at which a passage may go on beyond the units, with left and right: on which sides."""
    w = Window.partitionBy("id", "h").orderBy("start")
    before = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("start").over(w)
    sides = later.filter("NOT line").withColumn("left", F.coalesce(F.col("start") > before, F.lit(True))).withColumn("right", F.coalesce(after > F.col("start") + F.col("length"), F.lit(True)))
    return sides.filter((F.col("left") | F.col("right")) & (F.col("first") != F.col("id")))


def _short_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), np.uint8)
    return Words(data, np.array([0, len(data)])).hashes().astype(np.uint32)


def _surroundings(rows: DataFrame, text_at: int, places: str) -> DataFrame:
    """d1, d2, n, before, after: the words around the units that `places` (the last column) lists, as 32 bits each."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            listed = batch.column(batch.num_columns - 1)
            for k in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)).tolist():
                h = _short_hashes(batch.column(text_at)[k].as_py() or "")
                for u in listed[k].as_py():
                    a, b = u["start"], u["start"] + u["length"]
                    found.append((u["d1"], u["d2"], u["n"], h[max(a - AROUND, 0) : a].tobytes(), h[b : b + AROUND].tobytes()))
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["d1", "d2", "n", "before", "after"])

    return rows.mapInArrow(told, "d1 long, d2 long, n long, before binary, after binary")


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements are equal."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _runs(flags: np.ndarray, least: int) -> np.ndarray:
    """The flags of the runs of `least` or more alone."""
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    out = np.zeros(len(flags), bool)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[a:b] = b - a >= least
    return out


def removed_words(text: str, n: int, later: list[dict], ends: list[dict], min_words: int, min_line_words: int) -> np.ndarray:
    """Which of the text's n words go."""
    lines, found = np.zeros(n, bool), np.zeros(n, bool)
    for u in later:
        (lines if u["line"] else found)[u["start"] : u["start"] + u["length"]] = True
    own = sorted((u["start"], u["length"], u["back"]) for u in later if u["back"] and not u["line"])
    if ends or own:
        h = _short_hashes(text)
        reach = found.copy()
        for u in ends:
            a, b = u["start"], u["start"] + u["length"]
            if u["before"] is not None:
                k = _agreeing(h[:a][::-1], np.frombuffer(u["before"], np.uint32)[::-1])
                reach[a - k : a] = True
            if u["after"] is not None:
                reach[b : b + _agreeing(h[b:], np.frombuffer(u["after"], np.uint32))] = True
        for a, length, back in own:  # the earlier place is in this text
            b = a + length
            if a and not found[a - 1]:
                k = _agreeing(h[:a][::-1][:AROUND], h[: a - back][::-1])
                reach[a - k : a] = True
            if b < n and not found[b]:
                reach[b : b + _agreeing(h[b : b + AROUND], h[b - back :])] = True
        found = reach
    return _runs(found | lines, min_words) | _runs(lines, min_line_words)


def cut(text: str, spans: list[tuple[int, int]], gone: np.ndarray) -> tuple[str, list[dict], list[dict]]:
    """The text without the words, and the kept and the removed spans (code points of the original); the kept ones make the text.

    White space up to the next word of the line goes too; a line of which no words are left goes with its line break.
    """
    pieces: list[tuple[int, int]] = []  # what goes
    at, k = 0, 0
    for line in text.split("\n"):
        end, first = at + len(line), k
        while k < len(spans) and spans[k][0] < end:
            k += 1
        here = gone[first:k]
        if k > first and here.all():
            pieces.append((at, min(end + 1, len(text))))
        elif here.any():
            for j in np.flatnonzero(here).tolist():
                pieces.append((spans[first + j][0], spans[first + j + 1][0] if first + j + 1 < k else end))
        at = end + 1
    joined: list[list[int]] = []
    for a, b in pieces:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    # a last line that goes takes the break before it along
    if joined and joined[-1][1] == len(text) and text[joined[-1][0] - 1 : joined[-1][0]] == "\n" and not text.endswith("\n"):
        joined[-1][0] -= 1
        if len(joined) > 1 and joined[-2][1] > joined[-1][0]:
            joined[-2][1] = joined.pop()[1]
    edges = [0, *(x for pair in joined for x in pair), len(text)]
    kept = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
    return "".join(text[s["start"] : s["end"]] for s in kept), kept, [{"start": a, "end": b} for a, b in joined if b > a]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """docs with repeated passages cut from the text, and columns kept_spans, removed_spans and removed_words added.

    Words are lower-cased runs of [^\\x20\\x09-\\x0D]. Units are whole lines, and stretches between places that a few
    words around them determine, so equal passages have equal units wherever they stand, over line ends too. Of equal
    units the earliest (smallest id, then position) stays. A passage is a run of later units, continued at both ends
    word by word for as long as it agrees with what surrounds the end unit's earliest place. It goes if it has min_words words; a run
    of whole lines goes from min_line_words on. An equal passage of MIN_WORDS words or more holds a whole unit, so it is
    found; shorter ones may be. Spans are code points of the original text.

    Plan: units travel as 128-bit digests (see repeated_units). Only the units at the ends of passages ask for the
    words around their first place, and these go to them in copies for GROUP ends each, so a passage that a
    third of all documents have fills many tasks. Texts move once: both joins on documents use one exchange.

    Defined cases: a null text stays null, and both span lists are empty; a row without an id is left whole
    and counts for nothing; rows that repeat an id are one document: they lose the same units, those that
    only they share stay; added columns replace columns of the same name, and no other name clashes; a text may be of any length.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("kept_spans", "removed_spans", "removed_words")]
    out = T.StructType(fields + T.StructType.fromDDL(f"kept_spans {_SPANS}, removed_spans {_SPANS}, removed_words long").fields)
    names = [f.name for f in fields]
    text_at = names.index(text_col)
    # inside, columns have names of their own
    h = F.hash(F.col(f"`{text_col}`"))
    whole = docs.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)], F.col(f"`{id_col}`").alias("id"), h.alias("h"))
    units_found = repeated_units(whole.filter("id IS NOT NULL").select("id", "h", F.col(f"c{text_at}").alias("text")))
    later = units_found.filter((F.col("first") != F.col("id")) | (F.col("back") > 0))
    ends = _ends(later)
    asked = ends.select("d1", "d2").distinct()
    sources = units_found.filter("first = id AND back = 0 AND NOT line").join(asked, ["d1", "d2"], "left_semi")
    listed = lambda df, name, *columns: df.groupBy("id", "h").agg(F.collect_list(F.struct(*columns)).alias(name))
    around = _surroundings(whole.join(listed(sources, "places", "start", "length", "d1", "d2", "n"), ["id", "h"], "left").select(*whole.columns, "places"), text_at, "places")
    copies = F.ceil(F.col("n") / GROUP).cast("int")
    around = around.select("d1", "d2", "before", "after", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    dealt = ends.select("id", "h", "start", "length", "left", "right", "d1", "d2", F.pmod(F.xxhash64("id", "h"), copies).cast("int").alias("part"))
    one_side = lambda side, column: F.when(F.col(side), F.col(column)).alias(column)
    continued = listed(dealt.join(around, ["d1", "d2", "part"]).select("id", "h", "start", "length", one_side("left", "before"), one_side("right", "after")), "ends", "start", "length", "before", "after")
    in_own = F.when(F.col("first") == F.col("id"), F.col("back")).otherwise(F.lit(0)).alias("back")
    rows = whole.join(listed(later, "later", "start", "length", "line", in_own), ["id", "h"], "left").join(continued, ["id", "h"], "left").select(*whole.columns, "later", "ends")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            lists = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            kept, removed, words = [], [], []
            for k, (later, ends) in enumerate(lists):
                text, spans, n = texts[k] or "", None, 0
                most = sum(u["length"] + 2 * AROUND * (not u["line"]) for u in later or ())
                if most >= min(min_words, min_line_words):
                    places = [m.span() for m in _WORD.finditer(text)]
                    gone = removed_words(text, len(places), later, ends or [], min_words, min_line_words)
                    n = int(gone.sum())
                    if n:
                        texts[k], *spans = cut(text, places, gone)
                spans = spans or ([{"start": 0, "end": len(text)}] if text else [], [])
                kept.append(spans[0]), removed.append(spans[1]), words.append(n)
            columns = [pa.array(texts, batch.column(k).type) if k == text_at else batch.column(k) for k in range(len(names))]
            columns += [pa.array(kept, _SPAN_TYPE), pa.array(removed, _SPAN_TYPE), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return rows.mapInArrow(edited, out)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What a query returns of dedup_lines: the id, the spans, counts, and the text left."""
    return df.select(id_col, F.size("removed_spans").cast("long").alias("n_removed"), "removed_words", "removed_spans", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"), text_col)

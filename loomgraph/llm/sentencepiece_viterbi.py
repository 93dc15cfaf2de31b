"""SentencePiece encoding by a streaming Viterbi search over a model's pieces and scores, and decoding."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings
from .tokens import CACHED_WORDS, MARK, PartEncoder

SPACE = "\u2581"
#: What a character without a piece of its own scores below the lowest score.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int, int, bytes | int]]:
    """(field number, start, end, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        start = at
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, start, at, value


class Model:
    """Pieces, scores and normaliser settings of a model file.

    Only models without a character map, that keep extra white space and escape it, are read: their
    normaliser is the identity but for a leading space.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            settings = {n: v for top, _, _, value in _fields(f.read()) if top == 3 for n, _, _, v in _fields(value)}
        if settings.get(2) or settings.get(4, 1) or not settings.get(5, 1):
            raise ValueError("the model's normaliser changes more than a leading space")
        self.prefix = bool(settings.get(3, 1))
        self.size = processor.get_piece_size()
        self.pieces = [processor.id_to_piece(i) for i in range(self.size)]
        #: Prefixes of all pieces: (id or -1, score).
        self.trie: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = processor.unk_id()
        scores = []
        for i, piece in enumerate(self.pieces):
            if processor.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                for k in range(1, len(piece)):
                    self.trie.setdefault(piece[:k], (-1, 0.0))
                self.trie[piece] = (i, processor.get_score(i))
                scores.append(processor.get_score(i))
        self.longest = max((len(p) for p in self.trie), default=1)
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        #: No piece goes on with a space after another character: texts can be cut before runs of spaces.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in self.trie) and "\n" not in "".join(self.trie) and len(self.bytes) == 256

    def fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()] if len(self.bytes) == 256 else [self.unknown]


class StreamingViterbi:
    """Best segmentation of a stream of characters; what is certain is handed out at once.

    State is the text since the last commit with the best score and last piece of each position. A position's
    pieces are looked up once `longest` characters are there (or the text is over). All surviving paths end
    between the next position and the furthest end of a piece: where that is one position, or their
    backpointers meet in one, everything before it is committed and forgotten. Equal scores keep the
    path found first, whose last piece is longest.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.text = ""
        self.next = self.reach = 0
        #: For each position: score, start of the last piece, its id (-1: no piece, a single character).
        self.best: list[tuple[float, int, int] | None] = [(0.0, 0, -2)]
        self.widest = 0  # longest window so far, for tests

    def feed(self, text: str) -> list[int]:
        self.text += text
        return self._advance(len(self.text) - self.model.longest)

    def finish(self) -> list[int]:
        out = self._advance(len(self.text))
        out += self._commit(len(self.text))
        return out

    def _advance(self, until: int) -> list[int]:
        out: list[int] = []
        trie, longest = self.model.trie, self.model.longest
        check = 4 * longest
        while self.next < until:
            s, text, best = self.next, self.text, self.best
            if s and self.reach == s:
                out += self._commit(s)
                until -= s
                continue
            if s >= check:
                meet = self._meeting()
                if meet:
                    out += self._commit(meet)
                    until -= meet
                    check = 4 * longest
                    continue
                check = s + longest
            score = best[s][0]
            most = min(len(text), s + longest)
            while len(best) <= most:
                best.append(None)
            single = False
            for end in range(s + 1, most + 1):
                found = trie.get(text[s:end])
                if found is None:
                    break
                piece, own = found
                if piece >= 0:
                    single = single or end == s + 1
                    if best[end] is None or score + own > best[end][0]:
                        best[end] = (score + own, s, piece)
                    if end > self.reach:
                        self.reach = end
            if not single:
                own = score + self.model.unknown_score
                if best[s + 1] is None or own > best[s + 1][0]:
                    best[s + 1] = (own, s, -1)
                self.reach = max(self.reach, s + 1)
            self.next = s + 1
            self.widest = max(self.widest, s + 1)
        return out

    def _meeting(self) -> int:
        """The last position on the path of every surviving one, 0 if there is none."""
        ends = {e for e in range(self.next, self.reach + 1) if e < len(self.best) and self.best[e] is not None}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.best[last][1])
        return ends.pop()

    def _commit(self, at: int) -> list[int]:
        """Ids of the best path to `at`, which becomes position 0."""
        parts = []
        end = at
        while end > 0:
            _, start, piece = self.best[end]
            parts.append([piece] if piece >= 0 else self.model.fallback(self.text[start:end]))
            end = start
        base = self.best[at][0]
        self.text = self.text[at:]
        self.best = [None if b is None else (b[0] - base, b[1] - at, b[2]) for b in self.best[at:]]
        self.best[0] = (0.0, 0, -2)
        self.next -= at
        self.reach = max(self.reach - at, 0)
        return [i for part in reversed(parts) for i in part]


def encode_text(model: Model, text: str, chunk: int = 1 << 12) -> list[int]:
    """Ids of a whole text, fed in chunks. An empty text has none."""
    if not text:
        return []
    search = StreamingViterbi(model)
    text = (SPACE if model.prefix else "") + text.replace(" ", SPACE)
    out: list[int] = []
    for k in range(0, len(text), chunk):
        out += search.feed(text[k : k + chunk])
    return out + search.finish()


class SentencePieceEncoder(PartEncoder):
    """encode_text for columns. Texts are cut before runs of spaces and around line breaks, where no piece goes across."""

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        self.model = Model(path)
        super().__init__(self.model.size, cached)
        # an empty pattern matches every text
        self.uncut = f"{MARK}|{SPACE}" if self.model.cuttable else ""
        of = {i: bytes([b]) for b, i in self.model.bytes.items()}
        plain = [of.get(i, p.encode()) for i, p in enumerate(self.model.pieces)]
        self.surface = [b.replace(SPACE.encode(), b" ") for b in plain]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = strings(column)
        if self.model.prefix:  # an empty text stays empty
            column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)))
        return super().encode(column)

    def _cut(self, column: pa.Array) -> pa.Array:
        column = pc.replace_substring(column, "\n", f"{MARK}\n{MARK}")
        return pc.replace_substring_regex(column, rf"([^ {MARK}]) ", rf"\1{MARK} ")

    def _encode(self, parts: list[str]) -> list[bytes]:
        out = []
        for part in parts:
            search = StreamingViterbi(self.model)
            ids: list[int] = []
            text = part.replace(" ", SPACE)
            for k in range(0, len(text), 1 << 12):
                ids += search.feed(text[k : k + (1 << 12)])
            out.append(array(self.code, ids + search.finish()).tobytes())
        return out

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """Texts of runs of n ids each: bytes of all pieces in one gather, without the leading space of each text."""
        strip = int(self.model.prefix)
        surface = self.surface + [b[strip:] if b.startswith(b" ") else b for b in self.surface]
        table = np.frombuffer(b"".join(surface), np.uint8)
        sizes = np.fromiter(map(len, surface), np.int64, len(surface))
        places = np.cumsum(sizes) - sizes
        codes = ids.astype(np.int64)
        first = (np.cumsum(n) - n)[n > 0]
        codes[first] += len(self.surface)
        each = sizes[codes]
        ends = np.cumsum(each)
        data = table[np.repeat(places[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


_encoders: dict[str, SentencePieceEncoder] = {}


def encoder(path: str) -> SentencePieceEncoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = SentencePieceEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ids array<int> of every row's whole text.

    Defined cases: null and empty texts have no ids; ids may be null or repeat; the character U+2581 of
    a text is read as a space, as the model's own escape does. No shuffle, so no skew; a worker
    remembers CACHED_WORDS parts at most.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids, n = encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encoded, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """The id and text of rows of ids; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            texts = coder.decode(np.asarray(lists.flatten()), n)
            text = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=[id_col, "text"])

    return encoded.select(F.col(id_col), F.col("ids")).mapInArrow(decoded, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What a query returns: the id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and round_trip (decoding gives the text back)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids, n = coder.encode(part.column(1))
                ends = np.cumsum(n).tolist()
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[e - m : e]) for e, m in zip(ends, n.tolist(), strict=True)]
                same = pc.equal(coder.decode(ids, n), strings(part.column(1)).cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(crc, pa.int64()), same], names=[id_col, "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(measured, f"`{id_col}` {kind}, n_ids long, ids_crc32 long, round_trip boolean")

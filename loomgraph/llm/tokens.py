"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import quiet_threads, strings

#: Distinct words whose ids a Python worker remembers (about 150 bytes each).
CACHED_WORDS = 1_000_000
#: Stands between the parts of a text while it is cut.
MARK = "\x1f"
_encoders: dict[str, "Encoder"] = {}


class PartEncoder:
    """Encodes columns of texts part by part; each distinct part once, as long as it is remembered.

    A subclass says where texts may be cut without changing their ids, which texts may not be cut (they match
    `uncut`), and how parts are encoded.
    """

    uncut = MARK
    dtype: type = np.uint16

    def __init__(self, size: int, cached: int = CACHED_WORDS) -> None:
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.cached = cached
        self.words: dict[str, bytes] = {}

    def _cut(self, column: pa.Array) -> pa.Array:
        """The texts with MARK between parts."""
        raise NotImplementedError

    def _encode(self, parts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        column = strings(column)
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        whole = np.asarray(pc.match_substring_regex(column, self.uncut))
        lists = pc.split_pattern(self._cut(pc.if_else(pa.array(whole), "", column)), MARK)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) + len(distinct) > self.cached:
            self.words = {}
        known = self.words
        new = [w for w in distinct if w not in known]
        known.update(zip(new, self._encode(new), strict=True))
        parts = [known[w] for w in distinct]
        if len(known) > self.cached:  # one batch alone has more
            self.words = {}
        codes = coded.indices.to_numpy().astype(np.int64)
        rows = np.flatnonzero(whole)
        codes[offsets[rows]] = len(parts) + np.arange(len(rows))  # these rows have one empty part so far
        parts += self._encode(column.take(pa.array(rows)).to_pylist())
        table = np.frombuffer(b"".join(parts), self.dtype)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype().itemsize
        places = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = table[np.repeat(places[codes] - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.add.reduceat(each, offsets[:-1])


class Encoder(PartEncoder):
    """Encodes columns of texts with the tokenizer file at `path`, as Tokenizer.encode(text, add_special_tokens=False).

    The file's pre-tokenizer never joins what stands on both sides of these cuts, so the parts may be encoded
    on their own: before a space that a letter, digit or printable ASCII character follows; between a letter
    and one of .,!?;:; around a single line break between such characters. A text with any other
    character after a space, with a space at its end, or with the byte that marks the cuts, is encoded whole.
    """

    uncut = r" ([^!-~\pL\pN]|$)|" + MARK

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        super().__init__(self.tokenizer.get_vocab_size(), cached)

    def _cut(self, column: pa.Array) -> pa.Array:
        column = pc.replace_substring_regex(column, r"([\pL\pN.,!?;:])\n([\pL\pN])", "\\1\x1f\n\x1f\\2")
        column = pc.replace_substring_regex(column, r"(\pL)([.,!?;:])", "\\1\x1f\\2")
        return pc.replace_substring(column, " ", "\x1f ")

    def _encode(self, parts: list[str]) -> list[bytes]:
        out = [b""] * len(parts)
        other, tokenize = [], self.tokenizer.model.tokenize
        for k, part in enumerate(parts):
            # letters of ASCII stand for themselves in the byte-level alphabet: the library's model takes them as they are
            if part.isascii() and part[part[:1] == " " :].isalpha():
                out[k] = array(self.code, [t.id for t in tokenize("\u0120" + part[1:] if part[0] == " " else part)]).tobytes()
            else:
                other.append(k)
        for k in range(0, len(other), 1000):
            few = other[k : k + 1000]
            for at, e in zip(few, self.tokenizer.encode_batch_fast([parts[n] for n in few], add_special_tokens=False), strict=True):
                out[at] = array(self.code, e.ids).tobytes()
        return out


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

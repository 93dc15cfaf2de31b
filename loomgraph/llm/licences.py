"""Licence scans: sparse TF-IDF cosine of headers and whole files to notices and licence texts, told apart by their own words, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, checkpoint, met, strings
from .toxicity import _LOWER, _OUTSIDE

#: Whole licence texts, one file each, named by the licence.
TEXTS = Path(__file__).resolve().parent / "licence_texts"
#: Notices by licence (fixed values: openings of public licence texts, usual headers and header lines).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC-BY-SA-4.0": (
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-3.0": (
        "Creative Commons Attribution 3.0 Unported",
        "Licensed under CC BY 3.0.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    ),
    "CC-BY-4.0": (
        "Creative Commons Attribution 4.0 International",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
}
#: A statement that goes along with licences too: it counts where no other notice is found.
RESERVATION = "Proprietary"
#: What tells a licence from its neighbours (fixed values): words that a text must have where the template has them, and words that it may not have.
QUALIFIERS: dict[str, tuple[str, str]] = {
    "MIT": ("mit", ""),
    "Apache-2.0": ("apache 2", ""),
    "GPL-2.0": ("general public 2", "lesser library affero"),
    "GPL-3.0": ("general public 3", "lesser library affero"),
    "LGPL-2.1": ("lesser 2 1", "affero"),
    "LGPL-3.0": ("lesser 3", "affero"),
    "AGPL-3.0": ("affero 3", "lesser library"),
    "BSD-2-Clause": ("", "neither endorse"),
    "BSD-3-Clause": ("endorse", ""),
    "MPL-2.0": ("mozilla 2", ""),
    "Unlicense": ("unencumbered", ""),
    "CC-BY-3.0": ("3", "noncommercial nc sharealike sa noderivatives nd"),
    "CC-BY-4.0": ("4", "noncommercial nc sharealike sa noderivatives nd"),
    "CC-BY-NC-4.0": ("noncommercial nc 4", "sharealike sa noderivatives nd"),
    "CC-BY-SA-4.0": ("sharealike sa 4", "noncommercial nc noderivatives nd"),
}
#: A whole text is told from its neighbours by so many words at its top.
TITLE_WORDS = 12
#: Words beside a window that may not tell another licence either.
AROUND = 6
#: A tag that names a licence outright.
SPDX = re.compile(r"SPDX-License-Identifier:\s*\(*\s*([A-Za-z0-9][A-Za-z0-9.-]*)")
#: So many of a template's anchors are asked for at most.
MOST_NEEDED = 8
#: Cosine from which a template counts, and cosine to a whole licence text from which a file without a usual name is a licence file.
LEAST_COSINE = 0.7
FILE_COSINE = 0.9
#: Directories broadcast at most: those with a HOT-th of all files.
HOT = 1024
#: Names that licence files bear.
FILE_NAME = re.compile(r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$")

_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def _hash_of(words: list[str]) -> np.ndarray:
    """Hashes of words as Words.hashes gives them in texts."""
    column = pa.array(words, pa.string())
    found = [Words(_LOWER[data], offsets, _OUTSIDE).hashes() for _, _, data, offsets in blocks(column)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


@cache
def licence_texts(folder: Path = TEXTS) -> dict[str, str]:
    """Whole texts by licence, from the files of a folder on the driver."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.txt"))}


def vocabulary() -> list[str]:
    """The words of all templates."""
    return sorted({w for notices in (*TEMPLATES.values(), licence_texts().values()) for n in notices for w in _words(n)})


def anchors(v: dict[str, float], least: float) -> tuple[set[str], int]:
    """(words, how many of them): a text whose cosine to the vector is `least` or more has so many different words of these.

    If a text has fewer than `need` of them, its product with the vector holds the need - 1 heaviest anchors and the
    words outside at most; the anchors are the fewest heaviest words for which that is too little.
    """
    ranked = sorted(v, key=lambda w: (-v[w], w))
    squares = [v[w] ** 2 for w in ranked]
    total, limit = sum(squares), least**2 * sum(squares) * (1 - 1e-9)
    need = 1
    while need < min(MOST_NEEDED, len(ranked)) and sum(squares[:need]) < 0.5 * limit:
        need += 1
    held, taken = sum(squares[: need - 1]), 0.0
    for n, x in enumerate(squares, 1):
        taken += x
        if n >= need and held + total - taken < limit:
            return set(ranked[:n]), need
    return set(ranked), 1


class Matcher:
    """Best template of a text by cosine; words outside the templates weigh as the rarest word does.

    Nothing is compared that cannot reach LEAST_COSINE: an inverted index of each template's anchors (see there) finds
    the lines, windows and texts that have enough of them. Windows have a template's length and one of its anchors in its place.
    """

    def __init__(self, idf: dict[str, float], templates: dict[str, tuple[str, ...]] = TEMPLATES, texts: dict[str, str] | None = None) -> None:
        self.idf = idf
        self.rare = max(idf.values(), default=1.0)
        self.templates = []
        #: By anchor: the templates that have it. By template: how many it needs, and the places of each of its anchors.
        self.index: dict[str, list[int]] = {}
        self.needed: list[int] = []
        self.places: list[dict[str, list[int]]] = []
        #: By template: words that a text must have, and words that it may not have.
        self.qualifiers: list[tuple[set[str], set[str]]] = []
        notices = [(name, notice) for name, listed in templates.items() for notice in listed]
        #: From here on, templates are whole licence texts, which whole files are compared with.
        self.whole = len(notices)
        for k, (name, notice) in enumerate([*notices, *(texts or {}).items()]):
            words = _words(notice)
            v = self.vector(words)
            own, need = anchors(v, LEAST_COSINE)
            places: dict[str, list[int]] = {w: [] for w in own}
            for at, w in enumerate(words):
                if w in own:
                    places[w].append(at)
            for w in own:
                self.index.setdefault(w, []).append(k)
            must, bars = (set(x.split()) for x in QUALIFIERS.get(name, ("", "")))
            self.qualifiers.append((must & set(words[:TITLE_WORDS] if k >= self.whole else words), bars))
            self.needed.append(need)
            self.places.append(places)
            self.templates.append((name, v, math.sqrt(sum(x * x for x in v.values())), len(words)))

    def vector(self, words: list[str]) -> dict[str, float]:
        return {w: (1 + math.log(n)) * self.idf.get(w, self.rare) for w, n in Counter(words).items()}

    def cosines(self, words: list[str], among: Iterable[int]) -> Iterator[tuple[int, float]]:
        v = self.vector(words)
        norm = math.sqrt(sum(x * x for x in v.values()))
        for k in among:
            _, t, size, _ = self.templates[k]
            yield k, sum(x * t[w] for w, x in v.items() if w in t) / (norm * size) if norm else 0.0

    def possible(self, words: Iterable[str]) -> list[int]:
        """Templates that have enough of their anchors among the words."""
        met: Counter[int] = Counter()
        for w in set(words):
            met.update(self.index.get(w, ()))
        return [k for k, n in met.items() if n >= self.needed[k]]

    def count(self, words: list[str], among: Iterable[int], around: Iterable[str] = ()) -> list[tuple[int, float]]:
        """(template, cosine) for those that count: near enough, with the words that tell the licence, and none that tells another there or around."""
        held, title = set(words), set(words[:TITLE_WORDS])
        fit = [k for k in among if (h := title if k >= self.whole else held) >= self.qualifiers[k][0] and not self.qualifiers[k][1] & h.union(around)]
        return [(k, c) for k, c in self.cosines(words, fit) if c >= LEAST_COSINE] if fit else []

    def line(self, words: list[str], among: set[int]) -> list[tuple[int, float]]:
        """A whole line against the templates among which it can be."""
        return self.count(words, [k for k in self.possible(words) if k in among])

    def file(self, words: list[str]) -> list[tuple[int, float]]:
        """A whole file against the licence texts."""
        return self.count(words, [k for k in self.possible(words) if k >= self.whole])

    def windows(self, words: list[str], among: set[int]) -> list[tuple[int, float]]:
        """The windows of each template's length that have one of its anchors in its place, and enough of them."""
        hits: dict[int, list[tuple[int, str]]] = {k: [] for k in among}
        for at, w in enumerate(words):
            for k in self.index.get(w, ()):
                if k in hits:
                    hits[k].append((at, w))
        found = []
        for k, held in hits.items():
            length, at = self.templates[k][3], [p for p, _ in held]
            for start in {max(p - place, -length) for p, w in held for place in self.places[k][w]}:
                a, b = bisect_left(at, start), bisect_left(at, start + length)
                if b - a >= self.needed[k] and len({w for _, w in held[a:b]}) >= self.needed[k]:
                    found += self.count(words[max(start, 0) : start + length], [k], words[max(start - AROUND, 0) : start + length + AROUND])
        return found

    def choice(self, found: Iterable[tuple[int, float]]) -> tuple[str | None, float]:
        """Licence and cosine of the nearest template, long ones before short ones they contain (else the first in order); a reservation only without others."""
        best: tuple[bool, float, int, float] | None = None
        for k, cosine in sorted(found):
            name, _, _, length = self.templates[k]
            near = cosine * (1 - 1 / (4 + length))
            if best is None or (name != RESERVATION, near - 1e-12) > best[:2]:
                best = (name != RESERVATION, near, k, cosine)
        return (None, 0.0) if best is None else (self.templates[best[2]][0], best[3])

    def best(self, text: str) -> tuple[str | None, float, float]:
        """(licence, cosine, cosine of the whole text to a licence text): the choice over the whole text, its lines and its windows.

        A file that is a licence text as a whole is that licence, whatever notices it quotes; a tag names it outright.
        """
        words = _words(text)
        whole = self.file(words)
        name, cosine = self.choice(whole)
        if cosine >= FILE_COSINE:
            return name, cosine, cosine
        if "spdx" in words and (tag := SPDX.search(text)):
            return re.sub(r"-(only|or-later)$", "", tag[1]), 1.0, cosine
        among = {k for k in self.possible(words) if k < self.whole}
        if not among:
            return *self.choice(whole), cosine
        found = self.windows(words, among) + whole
        for line in text.split("\n"):
            found += self.line(_words(line), among)
        return *self.choice(found), cosine


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """How many of all documents have each word of the templates, and how many documents there are."""
    words = vocabulary()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hash_of(words)
        order = np.argsort(hashes)
        total, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, row, place in _known_words(batch.column(0), hashes, order):
                total += np.bincount(np.unique(row * len(words) + place) % len(words), minlength=len(words))
        yield pa.record_batch({"word": [*words, ""], "n": [*total.tolist(), n]})

    found = docs.select(F.col(text_col)).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word: r.n for r in found.collect()}  # one row per word of the templates
    return {w: counts.get(w, 0) for w in words}, counts.get("", 0)


def _known_words(text: pa.Array, hashes: np.ndarray, order: np.ndarray) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray]]:
    """For runs of rows: (words, first row, row within the run, place in the vocabulary) of each word of the vocabulary."""
    ranked = hashes[order]
    for a, _, data, offsets in blocks(text):
        w = Words(_LOWER[data], offsets, _OUTSIDE)
        h = w.hashes()
        at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
        hit = ranked[at] == h
        yield w, a, w.row[hit], order[at[hit]]


def own_licences(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of docs: the id, path, own_licence and own_cosine of its best line or window (null and 0 below `least`), is_file."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts, n = document_frequencies(docs, text_col)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in counts.items()}
    texts = licence_texts()  # read on the driver; tasks get them

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(idf, texts=texts)
        known = _hash_of([*matcher.index, "spdx"])
        order = np.argsort(known)
        for batch in batches:
            text = strings(batch.column(2))
            best: list[tuple[str | None, float, float]] = [(None, 0.0, 0.0)] * batch.num_rows
            for _, a, row, _ in _known_words(text, known, order):
                for r in np.unique(row).tolist():
                    found = matcher.best(text[a + r].as_py())
                    if found[1] >= least:
                        best[a + r] = found
            paths = batch.column(1).to_pylist()
            files = [name is not None and (whole >= FILE_COSINE or bool(FILE_NAME.match((p or "").rpartition("/")[2]))) for (name, _, whole), p in zip(best, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([name for name, _, _ in best], pa.string()), pa.array([c for _, c, _ in best], pa.float64()), pa.array(files, pa.bool_())],
                names=[id_col, "path", "own_licence", "own_cosine", "is_file"],
            )

    return docs.select(F.col(id_col), path.alias("path"), F.col(text_col)).mapInArrow(matched, f"`{id_col}` {kind}, path string, own_licence string, own_cosine double, is_file boolean")


def inherited(own: DataFrame) -> DataFrame:
    """own with licence, from_directory (of the licence file, null for an own notice): a file without a notice takes the licence of the nearest directory above.

    Licence files give their directory a licence: the highest cosine, then the first path. Each distinct directory
    is joined by path to itself and its ancestors, and the deepest one with a licence wins. Files then find their
    directory by path; a directory with a HOT-th of all files (so HOT of them at most) is broadcast instead, and its files stay where they are.
    """
    directory = F.regexp_extract(F.coalesce("path", F.lit("")), r"(?s)^(.*)/[^/]*$", 1)
    columns = [F.col(f"`{c}`") for c in own.columns]
    files = own.select(F.struct(*columns).alias("row"), directory.alias("dir"))
    licensed = (
        files.filter("row.is_file")
        .groupBy(F.col("dir").alias("at"))
        .agg(F.min(F.struct((-F.col("row.own_cosine")).alias("c"), F.col("row.path").alias("p"), F.col("row.own_licence").alias("l"))).alias("first"))
        .select("at", F.col("first.l").alias("licence"))
    )
    segments = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(segments))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(segments, 1, k), "/").alias("at")))
    sizes = checkpoint(files.groupBy("dir").agg(F.count(F.lit(1)).alias("n")))
    nearest = sizes.select("dir", F.explode(ancestors).alias("a")).select("dir", "a.depth", "a.at").join(licensed, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "licence")).alias("best"))
    known = checkpoint(sizes.join(nearest, "dir", "left").select("dir", "n", F.col("best.at").alias("from"), F.col("best.licence").alias("given")))
    rows = met(files, ["dir"], known, "n", HOT)
    noted = F.col("row.own_licence").isNotNull()
    return rows.select("row.*", F.coalesce("row.own_licence", "given").alias("licence"), F.when(~noted, F.col("from")).alias("from_directory"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence of each row of docs: of its own notice, or of the nearest directory above that has a licence file.

    Notices and headers are found in whole lines, and in windows of words over line ends and comment
    marks, wherever in the file and however long it is; whole files are compared with whole licence texts. A licence file is one with
    a notice that bears a usual name, or one that is a licence text (FILE_COSINE). IDF comes from all documents.

    Defined cases: null and empty texts have no notice; a null path lies in the top directory; equal paths are
    different files; ids may be null or repeat.
    """
    # read three times below; the table spares two scans of all texts
    return inherited(checkpoint(own_licences(docs, path, id_col, text_col)))

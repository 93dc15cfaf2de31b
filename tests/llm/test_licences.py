"""Licences are told from their neighbours, nothing is left out by the anchors, and the query equals a plain search."""

from __future__ import annotations

import collections
import math
import os
import random
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import entry, licences

SF = "/root/testdata/sf0.001"
#: Notices as projects write them (fixed values), and the licence that each names.
NOTICES = {
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This file is part of foo. foo is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0": "foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0": "This work is under a Creative Commons Attribution 4.0 International.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "// SPDX-License-Identifier: Apache-2.0",
    "BSD-2-Clause": "Copyright (c) 2020, Some One\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
}
#: Notices of licences that are not among the templates.
OTHERS = (
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License.",
)


@pytest.mark.parametrize("weights", ["equal", "rare"])
@pytest.mark.parametrize("shape", ["line", "wrapped", "inside"])
def test_each_notice_is_itself_or_none(weights, shape):
    rng = random.Random(1)
    idf = {} if weights == "equal" else {w: rng.uniform(4, 9) for w in licences.vocabulary()} | dict.fromkeys("the of and to this in a or is with as for you it".split(), 1.1)
    matcher = licences.Matcher(idf, texts=licences.licence_texts())
    body = " ".join(f"word{k}" for k in range(60))
    forms = {"line": lambda t: t, "wrapped": lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 60)), "inside": lambda t: f"{body} {t} {body}"}
    for name, text in NOTICES.items():
        assert matcher.best(forms[shape](text))[0] == name, name
    for text in OTHERS:
        assert matcher.best(forms[shape](text))[0] is None, text
    for name, text in licences.licence_texts().items():
        assert matcher.best(text)[0] == name


def test_anchors_leave_nothing_out():
    """Whatever text reaches the least cosine has enough anchors."""
    rng = random.Random(2)
    for _ in range(300):
        v = {f"w{k}": rng.choice([1.0, 1.0, 2.5, 6.0]) * rng.random() for k in range(rng.randrange(1, 40))}
        own, need = licences.anchors(v, 0.7)
        for _ in range(20):
            few = set(rng.sample(sorted(own), min(need - 1, len(own))))
            best = math.sqrt(sum(x * x for w, x in v.items() if w in few or w not in own) / sum(x * x for x in v.values()))
            assert best < 0.7 and len(own) >= need  # the nearest text with fewer anchors


def plain(matcher, text):
    """All lines, windows and texts against all templates, one by one."""
    words = licences._words(text)

    def cosine(held, k):
        x, (_, y, _, _) = matcher.vector(held), matcher.templates[k]
        over = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / over if over else 0.0

    def fits(held, k):
        must, bars = matcher.qualifiers[k]
        held = set(held[: licences.TITLE_WORDS] if k >= matcher.whole else held)
        return must <= held and not held & bars

    n = len(matcher.templates)
    files = [(k, cosine(words, k)) for k in range(matcher.whole, n) if fits(words, k)]
    found = [f for f in files if f[1] >= licences.LEAST_COSINE]
    name, most = matcher.choice(found)
    if most >= licences.FILE_COSINE:
        return name, most, most
    if tag := licences.SPDX.search(text):
        return tag[1].removesuffix("-only").removesuffix("-or-later"), 1.0, most
    held = [licences._words(line) for line in text.split("\n")]
    for k in range(matcher.whole):
        starts = {p - a for w, places in matcher.places[k].items() for a in places for p, x in enumerate(words) if x == w}
        length, more = matcher.templates[k][3], licences.AROUND
        windows = [words[max(a, 0) : max(a + length, 0)] for a in starts if not matcher.qualifiers[k][1] & set(words[max(a - more, 0) : max(a + length + more, 0)])]
        found += [(k, c) for x in [*held, *windows] if x and fits(x, k) and (c := cosine(x, k)) >= licences.LEAST_COSINE]
    return *matcher.choice(found), most


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_query_equals_a_plain_search(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, text FROM '{SF}/documents.parquet'").fetchall()
    found = {r.doc_id: r for r in entry.op8_licences(spark, SF).collect()}
    assert set(found) == {r[0] for r in rows}
    texts = [r[3] or "" for r in rows]
    bags = [set(licences._words(t)) for t in texts]
    idf = {w: math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1 for w in licences.vocabulary()}
    matcher = licences.Matcher(idf, texts=licences.licence_texts())
    kinds = collections.Counter(r.licence for r in found.values())
    for (doc_id, source, lang, _), text in zip(rows, texts, strict=True):
        r = found[doc_id]
        if len(text) > 3000:
            continue  # the plain search is slow
        name, cosine, _ = plain(matcher, text)
        assert (r.own_licence, r.licence, r.path) == (name, name, f"{source}/{lang}/{doc_id}.txt") and r.own_cosine == pytest.approx(cosine)
    assert len(kinds) > 3


def test_rows_inherit_over_directories(spark):
    """The query's own paths, with a licence file put above some of them."""
    docs = spark.createDataFrame([(k, "src1", lang, "some text about nothing at all") for k, lang in enumerate(["en", "en", "de"])], "doc_id long, source string, lang string, text string")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    above = spark.createDataFrame([(9, "src1", "en", " ".join(licences.licence_texts()["LGPL-3.0"].split())), (10, "src1", "de", NOTICES["AGPL-3.0"])], docs.schema)
    found = {r.doc_id: (r.licence, r.from_directory) for r in licences.scan(docs.unionByName(above), F.when(F.col("doc_id") == 9, "src1/copy").when(F.col("doc_id") == 10, "src1/de/COPYING").otherwise(path)).collect()}
    assert found == {0: ("LGPL-3.0", "src1"), 1: ("LGPL-3.0", "src1"), 2: ("AGPL-3.0", "src1/de"), 9: ("LGPL-3.0", None), 10: ("AGPL-3.0", None)}

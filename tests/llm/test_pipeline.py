"""Each stage of the pipeline on what its predecessor kept, the whole run, and every registered query, on a small corpus."""

from __future__ import annotations

import collections
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import check_spans, classes, crc, held, plain_removals, plain_statistics
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from loomgraph.llm import entry, line_dedup, quality
from loomgraph.llm.exact_dedup import exact_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def check_pieces(rows, documents, library):
    """The pieces of each document tile its ids, and sequences hold 1,024 of them at most, without gaps."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(documents)
    for d, found in pieces.items():
        ids, at = [*library.encode(documents[d], add_special_tokens=False).ids, 0], 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def check_removals(documents, found):
    """Repeated windows of MIN_WORDS words go, but for a word or two at an end; what else goes is made of shorter repeats that meet."""
    gone = plain_removals(documents, line_dedup.MIN_WORDS, line_dedup.MIN_WORDS)
    short = plain_removals(documents, line_dedup.LEAST, line_dedup.LEAST)
    for d, r in found.items():
        own = held(documents[d], r.removed_spans)
        assert len(gone[d] - own) <= 2 and own - gone[d] <= short[d]


def test_stages(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, texts(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = texts(docs)
        if name == "quality_rules":
            trees = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            good = {r.doc_id for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), trees).filter("kept").collect()}
            assert set(after) == good and 0 < len(good) < len(before)
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d]), d)
            assert set(after) == set(first.values())
        elif name == "near_dedup":
            assert set(after) == {d for d, c in classes(before).items() if d == c}
        else:
            assert set(after) == set(before)
            spans = line_dedup.dedup_lines(spark.createDataFrame(list(before.items()), "doc_id long, text string"), min_line_words=line_dedup.MIN_WORDS)
            found = {r.doc_id: r for r in spans.collect()}
            assert after == {d: r.text for d, r in found.items()}
            check_removals(before, found)
        before = {d: after[d] for d in after}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    check_pieces(packed.collect(), before, library)
    whole = corpus_pipeline.run(spark, SF)
    check_pieces(whole.collect(), before, library)


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.isEmpty()


def test_stages_on_awkward_documents(spark):
    """Null and repeated ids, null and very long texts, ties, and columns with the operators' own names go through all stages."""
    long_text = " ".join(f"w{k * 7919 % 200_003}" for k in range(200_000))
    rows = [(None, "a few words " * 3), (1, None), (2, ""), (3, long_text), (3, long_text), (4, " ".join(f"x{k}" for k in range(80))), (5, " ".join(f"x{k}" for k in range(80))), (6, "tail " + long_text)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _kept_id string, later int")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_kept_id", "later"]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {None, 1, 3, 4} and left[3] == long_text
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(left)
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).columns == docs.columns


def test_registered():
    names = driver.queries()
    assert set(entry.queries()) | {"pipeline"} <= set(names) and len(entry.queries()) == 10


@pytest.fixture(scope="module")
def documents(spark):
    return texts(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, documents, library, name):
    """Each query over the whole of its table, against SQL or by hand."""
    df = driver.queries()[name](spark, SF)
    rows = df.collect()
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        found = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr(list(r)) for r in found.fetchall())
        return
    if name != "op7_packing":
        key = "page_id" if name == "op4_url_filter" else "doc_id"
        table = "pages" if key == "page_id" else "documents"
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    if name == "op3_token_files":
        start = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            ids = [*library.encode(documents[r.doc_id], add_special_tokens=False).ids, 2]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
            start += len(ids)
    elif name == "op4_url_filter":
        urls = {r.page_id: r.url or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
        for r in rows:
            host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r.page_id]).groups() if "://" in urls[r.page_id] else ("", "")
            assert (r.host, r.path) == (host.lower(), path) and r.verdict in ("allow", "block")
            fits = [x for x in entry.URL_RULES if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
            best = max(fits, key=lambda x: len(x.name), default=None)
            assert r.rule == (best and best.name) and (best is None or r.verdict == best.verdict)
    elif name == "op5_toxicity":
        assert {"p_toxic", "toxic"} <= set(df.columns) and all(r.toxic == (r.p_toxic >= 0.2) for r in rows)
        labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        assert np.mean([r.toxic == bool(labels[r.doc_id]) for r in rows if labels.get(r.doc_id) is not None]) > 0.9
    elif name == "op6_line_dedup":
        found = {r.doc_id: r for r in rows}
        check_removals(documents, found)
        assert all(r.n_removed == len(r.removed_spans) and r.removed_words == len(held(documents[d], r.removed_spans)) for d, r in found.items())
        again = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"), min_line_words=line_dedup.MIN_WORDS)
        check_spans(documents, {r.doc_id: r for r in again.collect()})
    elif name == "op7_packing":
        check_pieces(rows, documents, library)
    elif name == "op8_licences":
        told = [r for r in rows if r.own_licence]
        assert told and all(re.search("(?i)licen[sc]e|rights reserved", documents[r.doc_id]) for r in told)
        assert all(r.path.endswith(f"/{r.doc_id}.txt") for r in rows)
        missed = [r for r in rows if not r.own_licence and re.search(r"(?m)^(Licensed under the Apache License, Version 2.0\.|Released under the MIT License\.)$", documents[r.doc_id])]
        assert not missed
    elif name == "op9_quality_rules":
        for r in rows:
            p = plain_statistics(documents[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == p
            assert r.base_failed == (p[0] < 10 or 100 * p[4] > 20 * p[0]) and not (r.kept and r.base_failed)
    else:
        assert name == "op10_sentencepiece" and df.filter("NOT round_trip").isEmpty() and df.agg(F.count(F.lit(1))).first()[0] == len(documents)


def test_only_texts_that_removal_made_equal_repeat(spark):
    """Exact copies are gone before passages are compared."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, SF)
    assert exact_dedup(docs).filter("NOT kept").isEmpty()

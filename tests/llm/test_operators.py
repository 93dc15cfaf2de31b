"""The training-data operators against brute force, round trips and held-out rows, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bagminhash, boosting, licences, line_dedup, near_dedup, packing, quality, sentencepiece_viterbi, token_files, tokens, toxicity, url_filter
from loomgraph.llm.exact_dedup import exact_dedup, kept_documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = r"[\x20\x09-\x0D]"
ODD = [None, "", " ", "\n\n", "a", "a b\nc", "\x0b a  b\t", "é é é é é é é", "一 二 三 四 五 一 二 三 四 五", "foo  bar \n baz — é ñ", "x. y, z!\nq's it's", "tail ", "\U0001f600 ok.\nB", "x" * 3000, "the <|endoftext|> end"]


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(400)}", f"v{rng.randrange(4000)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 12, 60, 90])) for _ in range(40)]
    passage = words(rng, 60)
    near = []
    for t in base[:20]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    lines = [f"{b}\n{passage}\n{words(rng, 5)}" for b in base[20:26]]
    return [*ODD, *base, *base[:5], *near, *lines, "A  b\tc", "A b c", base[0] + "\n"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k * 3 + 1, t, "x", 1.5, "keep") for k, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    # names that operators use inside must not clash
    return spark.createDataFrame(rows, "doc_id long, text string, norm string, quality double, content string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, norm string, quality double, content string")


def by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_exact_dedup(spark, docs, empty):
    norm = {d: re.sub(f"{SPACE}+", " ", t) for d, t in by_id(docs).items()}
    groups = collections.defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    found = exact_dedup(docs).collect()
    assert len(found) == len(norm)
    for r in found:
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert {r.doc_id for r in kept_documents(docs).collect()} == {min(g) for g in groups.values()}
    assert exact_dedup(empty).isEmpty() and kept_documents(docs).columns == docs.columns
    odd = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, "z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in exact_dedup(odd).collect() if r.group_size > 1) == [("2", 2, True), ("2", 2, True), ("None", 2, False)]
    assert exact_dedup(odd).filter("text_md5 = md5('z')").first().kept


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(3)
    diff = []
    for weights in ([1] * 40, [1, 2, 3, 5, 9, 17] * 4, [100, 700, 3]):
        n = len(weights)
        for _ in range(60):
            a = np.array(weights)
            b = np.maximum(0, a + rng.integers(-2, 3, n) * (rng.random(n) < 0.5))
            e = rng.integers(0, 2**63, n).astype(np.uint64)
            row = np.concatenate([np.zeros(n, int), np.ones((b > 0).sum(), int)])
            s = bagminhash.signatures(row, np.concatenate([e, e[b > 0]]), np.concatenate([a, b[b > 0]]), 2, 256)
            assert np.isfinite(s).all()
            diff.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(diff)) < 0.006
    assert np.isinf(bagminhash.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 2, 8)).all()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def classes(rows):
    """Smallest id of each component of links at 0.8; texts without words are one."""
    s = {d: shingles(t) for d, t in rows.items()}
    parent = {d: d for d in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared, all_ = sum((s[a] & s[b]).values()), sum((s[a] | s[b]).values())
            if shared >= 0.8 * all_ and (shared or not all_):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in s}


def test_near_duplicates(docs, empty):
    found = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    expected = classes(by_id(docs))
    assert {d: r.class_id for d, r in found.items()} == expected
    assert all(r.kept == (d == expected[d]) for d, r in found.items())
    assert near_dedup.near_duplicates(empty).isEmpty()


def test_near_duplicate_chains(spark):
    """Neighbours of a chain are alike, its ends are not; and rows without an id or with the same one."""
    rng = random.Random(9)
    w = [f"a{i}" for i in range(100)]
    rows, at = [], list(w)
    for k in range(8):
        rows.append((100 - k, " ".join(at)))
        at[k * 12 : k * 12 + 2] = [f"b{k}x", f"b{k}y"]
    rows += [(None, rows[0][1]), (500, "z " * 50), (500, "z " * 50), (7, words(rng, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.class_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    expected = classes({d: t for d, t in rows if d is not None})
    assert all(c == expected[d] for d, c, _ in found if d is not None)
    assert (None, None, True) in found and found.count((500, 500, True)) == 2


def test_encoder_equals_the_library(texts):
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    rng = random.Random(2)
    odd = ["".join(rng.choice(["a", "b", " ", "\n", ".", ",", "'s", "é", "1", "\u00a0", "!", "中", "\u0301", "\t", "\x1f"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    rows = [*texts, *odd]
    ids, n = tokens.Encoder(BPE, cached=300).encode(pa.array(rows))
    at = np.cumsum(n) - n
    for k, t in enumerate(rows):
        assert ids[at[k] : at[k] + n[k]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@pytest.fixture(scope="module")
def encoded(docs):
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in by_id(docs).items()}


def test_token_files(spark, docs, empty, encoded):
    files = token_files.write_token_files(docs, BPE, 2, shards=3)
    found = sorted(tuple(r)[:4] for r in token_files.read_token_files(spark, files).collect())
    start, expected = 0, []
    for d in sorted(encoded):
        ids = [*encoded[d], 2]
        expected.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert found == expected
    whole, token_files.SHARD_BYTES = token_files.SHARD_BYTES, 500  # many files, each still a run of ids
    finer = token_files.write_token_files(docs, BPE, 2)
    token_files.SHARD_BYTES = whole
    assert len(finer.shards(spark)) > 10 and sorted(tuple(r)[:4] for r in token_files.read_token_files(spark, finer).collect()) == expected
    shards = files.shards(spark)
    flat = []
    for _, path, _, _, n, rows in shards:
        file = token_files.SequenceFile(path)
        assert rows == -(-n // token_files.LENGTH)
        for k in range(rows):
            ids, mask = file.sequence(k)
            assert len(ids) == token_files.LENGTH and not ids.flags.owndata
            flat += ids[np.asarray(mask)].tolist()
    assert flat == [i for d in sorted(encoded) for i in [*encoded[d], 2]]
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, BPE, 2)).isEmpty()


def test_packing(docs, empty, encoded):
    rows = packing.pack_documents(docs, BPE, 0).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = [*encoded[r.doc_id], 0]
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids)
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(pieces[d], len(encoded[d]) + 1) for d in encoded] + [(s, sum(n for _, n in s)) for s in sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == total
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes) <= 1024 and sum(n & (n - 1) != 0 for n in sizes) <= 3  # one a partition
    assert packing.pack_documents(empty, BPE, 0).isEmpty()


def test_packing_plan():
    rng = random.Random(4)
    pieces, at = [], 0
    for d in range(300):
        n = rng.choice([1, 5, 100, 128, 129, 500, 1024, 1025, 3000])
        pieces.append(packing.Piece(d, 0, n, at))
        at += n
    windows, rest = packing.plan(pieces)
    assert all(sum(p.length for p in w) in packing.TIERS for w in windows)
    assert sorted(i for w in [*windows, rest] for p in w for i in range(p.at, p.at + p.length)) == list(range(at))


def check_urls(urls, found):
    """Scores, calibration, probabilities and verdicts by plain counts of all examples."""
    order = url_filter.ORDER
    framed = ["\u0002" * order + (u or "").lower() + "\u0003" for u in urls]
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    for k, t in enumerate(framed):
        if found[k].rule:
            for i in range(order, len(t)):
                counts[found[k].verdict].update([("g", t[i - j : i + 1]) for j in range(order + 1)] + [("c", t[i - j : i]) for j in range(order + 1)])

    def score(k):
        t, total = framed[k], 0.0
        own = found[k].verdict if found[k].rule else None
        for i in range(order, len(t)):
            p = dict.fromkeys(counts, 1 / 64)
            for j in range(order + 1):
                less = {v: int(v == own) for v in p}  # an example is taken out of its own counts
                p = {v: (max(counts[v]["g", t[i - j : i + 1]] - less[v], 0) + 2 * p[v]) / (max(counts[v]["c", t[i - j : i]] - less[v], 0) + 2) for v in p}
            total += np.log(p["allow"] / p["block"])
        return total / (len(t) - order)

    scores = [score(k) for k in range(len(urls))]
    of = {v: np.array([s for k, s in enumerate(scores) if found[k].rule and found[k].verdict == v]) for v in counts}
    high, low = of["allow"].mean(), of["block"].mean()
    slope = (high - low) / ((of["allow"].var() + of["block"].var()) / 2)
    for k, s in enumerate(scores):
        p = 1 / (1 + np.exp(-np.clip(slope * (s - (high + low) / 2), -40, 40)))
        assert found[k].score == pytest.approx(s) and found[k].probability == pytest.approx(p, abs=1e-6)
        if not found[k].rule and abs(p - 0.5) > 1e-6:
            assert found[k].verdict == ("allow" if p >= 0.5 else "block")
    return counts


def test_urls(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/")]
    urls = ["http://WWW.Example.com/en/1?q=/es/", "https://m.example.com/en/2", "http://a.com#x", "http://a.com/", "x://b.net/es/", "http://anet/es/", "b.net/es/", None, "", "http://h\n.org/p\nq?z"]
    urls += [f"http://good{k}.com/news/{k}" for k in range(30)] + [f"http://spam{k}.net/es/casino{k}" for k in range(30)] + ["http://good99.org/news/7", "http://spam99.org/es/casino9"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in url_filter.url_filter(pages, rules).collect()}
    assert [(found[k].host, found[k].path, found[k].rule) for k in range(10)] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("m.example.com", "/en/2", "example.com/en/"), ("a.com", "", None), ("a.com", "/", "com/"), ("b.net", "/es/", "net/es/"),
        ("anet", "/es/", None), ("", "", None), ("", "", None), ("", "", None), ("h\n.org", "/p\nq", None),
    ]
    assert [found[k].verdict for k in (0, 1, 3, 4)] == ["allow", "block", "allow", "block"]
    assert found[len(urls) - 2].verdict == "allow" and found[len(urls) - 1].verdict == "block"

    check_urls(urls, found)
    none = url_filter.url_filter(pages.limit(0), rules)
    assert none.isEmpty() and url_filter.url_filter(pages, []).filter("verdict <> 'allow' OR rule IS NOT NULL").isEmpty()


def labelled(spark, n=400):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        bad, toxic = k % 4 == 0, k % 5 == 0
        t = words(rng, rng.randint(20, 60))
        if toxic:
            t += f" {rng.choice(['scum', 'vermin', 'lowlife'])}. " + words(rng, 5)
        if bad:
            t = " ".join(w + rng.choice(["$$$", "###"]) for w in t.split(" "))
        rows.append((k, t, rng.choice(["en", "fr"]), int(not bad), int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumn("_id", F.lit(1)).withColumn("label_toxic", F.lit(0))
    return rows, docs, spark.createDataFrame([(r[0], r[3], r[4]) for r in rows if r[0] < n // 2], "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    rows, docs, labels = labelled(spark)
    toxic = F.col("label_toxic")
    categories = {"en": F.when(F.col("lang") == "en", toxic), "fr": F.when(F.col("lang") == "fr", toxic), "none": F.lit(None).cast("int"), "any": toxic}
    chain = toxicity.train(docs, labels, categories)
    assert len(chain.models[3].earlier) == 3
    found = {r.doc_id: r for r in toxicity.toxicity(docs, chain).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert np.mean([found[r[0]].toxic == bool(r[4]) for r in held]) > 0.97
    assert max(r.p_none for r in found.values()) < 0.01
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert [r.toxic for r in toxicity.toxicity(odd, chain).collect()] == [False] * 3
    assert toxicity.toxicity(empty, chain).isEmpty()
    assert toxicity.toxicity(docs, toxicity.train(docs, labels.limit(0), categories)).filter("toxic").isEmpty()


def test_toxicity_chain_feeds_forward():
    """A category that is another's opposite where words say nothing can only be learnt from the chain."""
    rng = np.random.default_rng(0)
    row = np.arange(600)
    first = rng.random(600) < 0.5
    bucket = np.where(first, 7, 9)
    chain = toxicity.fit_chain({"a": first.astype(float), "b": (~first).astype(float)}, row, bucket)
    assert chain.models[1].earlier[0] < 0


def plain_statistics(t):
    ws, seen, again = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    c = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    inside = {i + k for i in range(len(ws) - 4) if c[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)


def test_quality(spark, docs, empty, texts):
    rows, more, labels = labelled(spark)
    trees = quality.train(more, labels)
    found = {r.doc_id: r for r in quality.quality_rules(docs, trees).collect()}
    for d, t in by_id(docs).items():
        r, p = found[d], plain_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == p
        assert r.base_failed == (p[0] < 10 or 100 * p[4] > 20 * p[0]) and (not r.base_failed or not r.kept)
    odd = ["a\nb\na\na\n", "x y z w v x y z w v q", "\n\n", "a b c d e f\n" * 9]
    base, _ = quality.statistics(pa.array(odd))
    assert list(zip(*(base[n].tolist() for n in quality.BASE), strict=True)) == [plain_statistics(t) for t in odd]
    held = {r.doc_id: r.kept for r in quality.quality_rules(more, trees).collect()}
    assert np.mean([held[r[0]] == bool(r[3]) for r in rows if r[0] >= 200]) > 0.97
    assert {r.doc_id for r in quality.good_documents(docs, trees).collect()} == {d for d, r in found.items() if r.kept}
    assert quality.quality_rules(empty, trees).isEmpty() and quality.good_documents(docs, trees).columns == docs.columns
    assert quality.train(more, labels.limit(0)).probability(np.zeros((1, 12)))[0] == 0.5


def test_boosting_is_monotonic_and_flat_trees_agree():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.1, 800)) > 1).astype(float)
    t = boosting.fit(x, y, (1, 0, -1))
    grid = np.tile(rng.random((50, 1, 3)), (1, 40, 1))
    for f, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(0, 1, 40)
        steps = np.diff(t.margin(g.reshape(-1, 3)).reshape(50, 40), axis=1) * sign
        assert steps.min() > -1e-9
    assert ((t.probability(x) > 0.5) == y).mean() > 0.9

    def slow(row):
        total = t.base
        for node in t.roots:
            while t.feature[node] >= 0:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return total

    assert np.allclose(t.margin(x[:50]), [slow(r) for r in x[:50]])


def plain_removals(rows, min_words, min_line_words):
    """Words that go, by document: windows of min_words words that stand earlier too, and runs of whole lines that do."""
    windows, lines, out = {}, {}, {}
    for d in sorted(rows):
        found = [(m.group().lower(), rows[d].count("\n", 0, m.start())) for m in re.finditer(r"[^\x20\x09-\x0D]+", rows[d])]
        ws = [w for w, _ in found]
        gone, run = set(), []
        for i in range(len(ws) - min_words + 1):
            if windows.setdefault(tuple(ws[i : i + min_words]), (d, i)) != (d, i):
                gone |= set(range(i, i + min_words))
        for k, group in [(k, list(g)) for k, g in itertools.groupby(range(len(ws)), key=lambda i: found[i][1])] + [(None, [])]:
            if group and lines.setdefault(tuple(ws[i] for i in group), (d, k)) != (d, k):
                run += group
            else:
                gone |= set(run) if len(run) >= min_line_words else set()
                run = []
        out[d] = gone
    return out


def held(text, spans):
    """Numbers of the words that lie in the spans."""
    return {k for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)) if any(s.start <= m.start() and m.end() <= s.end for s in spans)}


def check_spans(rows, found):
    for d, t in rows.items():
        spans = sorted([(s.start, s.end) for s in [*found[d].kept_spans, *found[d].removed_spans]])
        assert spans == [] if not t else (spans[0][0] == 0 and spans[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)))
        assert "".join(t[s.start : s.end] for s in found[d].kept_spans) == (found[d].text or "")


def test_line_dedup(docs, empty):
    rows = by_id(docs)
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    expected = plain_removals(rows, line_dedup.MIN_WORDS, line_dedup.MIN_LINE_WORDS)
    check_spans(rows, found)
    for d, t in rows.items():
        gone = held(t, found[d].removed_spans)
        # a word after a passage may agree by chance with what another document than the first has there
        assert gone <= expected[d] and len(expected[d] - gone) <= 2
        assert found[d].removed_words == len(gone)
        expected[d] = gone
    assert sum(map(bool, expected.values())) >= 20
    # lines of which nothing goes, or everything, keep or lose their line breaks
    for d, t in rows.items():
        left, k = [], 0
        for line in t.split("\n"):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            own = set(range(k, k + n))
            k += n
            if not n or not own <= expected[d]:
                left.append(own)
        assert (found[d].text or "").count("\n") == max(len(left) - 1, 0)
    assert line_dedup.dedup_lines(empty).isEmpty()
    again = line_dedup.dedup_lines(docs.withColumn("kept_spans", F.lit("clash")))
    assert again.columns.count("kept_spans") == 1


def test_passages_in_mid_line(spark):
    """Passages planted in the middle of lines, over line ends, twice in a document and in many documents go word for word; short ones stay."""
    rng = random.Random(12)
    some = lambda n: [f"{rng.choice('abcdefg')}{rng.randrange(10**6)}" for _ in range(n)]
    passages = [some(n) for n in (51, 59, 60, 100, 46)] + [some(20)]
    rows, planted = [], {}
    for d in range(120):
        text, places, at = [], [], 0
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages) if d % 3 else passages[0]
            around = some(rng.randint(3, 60))
            text += around
            places.append((tuple(p), len(text)))
            text += p
        text += some(rng.randint(0, 30))
        planted[d] = places
        ends = [rng.choice([" ", " ", " ", " ", "  ", "\t", "\n", "\n\n"]) for _ in text]
        rows.append((d, "".join((w.upper() if rng.random() < 0.1 else w) + e for w, e in zip(text, ends, strict=True))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    seen, expected = set(), {}
    for d in sorted(planted):
        expected[d] = set()
        for p, at in planted[d]:
            if p in seen and len(p) > 45:
                expected[d] |= set(range(at, at + len(p)))
            seen.add(p)
    for hot in (line_dedup.HOT, 1):  # with one digest at most broadcast, the others meet by a join
        before, line_dedup.HOT = line_dedup.HOT, hot
        found = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_line_words=45).collect()}
        line_dedup.HOT = before
        check_spans(dict(rows), found)
        assert {d: held(t, found[d].removed_spans) for d, t in rows} == expected
    group, line_dedup.GROUP = line_dedup.GROUP, 3
    again = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_line_words=45).collect()}
    line_dedup.GROUP = group
    assert again == {d: r.text for d, r in found.items()}


def test_line_dedup_on_awkward_tables(spark):
    """Repeated and missing ids, columns with the operator's own names, very long and periodic texts."""
    rng = random.Random(13)
    long_text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"x {p} y"), (1, f"x {p} y"), (2, f"z {p} q"), (2, f"other {p}"), (None, f"z {p} q"), (3, None), (4, ""), (5, "so " * 500), (6, "a b so " + "so " * 300), (7, long_text), (8, "begin " + long_text[:3_000_000])]
    docs = spark.createDataFrame([(d, t, *"abcdefghij") for d, t in rows], "doc_id long, text string, id string, h string, places string, later string, ends string, c0 string, _id string, start string, d1 string, first string")
    found = line_dedup.dedup_lines(docs).collect()
    assert found and line_dedup.dedup_lines(docs).columns[:12] == docs.columns
    told = collections.defaultdict(list)
    for r in found:
        assert (r.id, r.h, r.first) == ("a", "b", "j")
        told[r.doc_id].append(r.text)
    assert told[1] == [f"x {p} y"] * 2 and sorted(told[2]) == ["other ", "z q"] and told[None] == [f"z {p} q"] and told[3] == [None] and told[4] == [""]
    assert 0 < len(told[5][0].split()) < 60 and told[6][0].split()[:2] == ["a", "b"] and len(told[6][0].split()) < 60
    assert told[7] == [long_text] and told[8][0].split()[0] == "begin" and len(told[8][0]) < 40


def test_licences(spark, empty):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rng = random.Random(8)
    body = lambda: words(rng, 50)
    files = [
        ("a/LICENSE", body() + "\n" + mit), ("a/x.py", body()), ("a/b/c/y.py", body()), ("a/b/LICENSE.md", gpl), ("a/b/z.py", body() + "\n" + mit), ("other/q.py", body()), ("top.py", ""), (None, None),
        ("ab/x.py", body() + "\nthe rights of all and the license of some were kept by those who had none of them in the end"),
    ]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files)], "doc_id long, place string, text string").withColumn("own_licence", F.lit("clash"))
    found = {r.path: (r.licence, r.from_directory, r.is_file) for r in licences.scan(docs, F.col("place")).collect()}
    assert found == {
        "a/LICENSE": ("MIT", None, True), "a/x.py": ("MIT", "a", False), "a/b/c/y.py": ("GPL-3.0", "a/b", False), "a/b/LICENSE.md": ("GPL-3.0", None, True), "a/b/z.py": ("MIT", None, False),
        "other/q.py": (None, None, False), "top.py": (None, None, False), None: (None, None, False), "ab/x.py": (None, None, False),
    }
    assert licences.scan(empty, F.lit("p")).isEmpty()
    for name, notices in licences.TEMPLATES.items():
        for n in notices:
            assert licences.Matcher({}).best(n)[0] == name


def unigram_library():
    """The library's own Viterbi over the same pieces and scores: the model file with its type set to unigram."""
    import sentencepiece

    with open(PIECES, "rb") as f:
        data = f.read()
    out = b""
    for n, a, b, value in sentencepiece_viterbi._fields(data):
        if n == 2:
            value = b"".join(value[x:y] if m != 3 else b"\x18\x01" for m, x, y, _ in sentencepiece_viterbi._fields(value))
            size, head = len(value), b"\x12"
            while size > 127:
                head, size = head + bytes([size & 127 | 128]), size >> 7
            out += head + bytes([size]) + value
        else:
            out += data[a:b]
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def brute_viterbi(model, text):
    """Best ids over the whole text, in exact arithmetic and without a window."""
    if not text:
        return []
    text = "\u2581" + text.replace(" ", "\u2581")
    best = [(0.0, 0, -2)] + [None] * len(text)
    for s in range(len(text)):
        hits = [(e, *model.trie[text[s:e]]) for e in range(s + 1, min(len(text), s + model.longest) + 1) if model.trie.get(text[s:e], (-1,))[0] >= 0]
        if not any(e == s + 1 for e, *_ in hits):
            hits.append((s + 1, -1, model.unknown_score))
        for e, i, own in hits:
            if best[e] is None or best[s][0] + own > best[e][0]:
                best[e] = (best[s][0] + own, s, i)
    out, e = [], len(text)
    while e:
        _, s, i = best[e]
        out = ([i] if i >= 0 else model.fallback(text[s:e])) + out
        e = s
    return out


def test_sentencepiece(spark, texts, docs, empty):
    model, library = sentencepiece_viterbi.Model(PIECES), unigram_library()
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab \n,é日the") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 400, "   x  ", "日本語"]
    for t in [*(x or "" for x in texts), *odd]:
        assert sentencepiece_viterbi.encode_text(model, t, 7) == brute_viterbi(model, t)
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ,.") for _ in range(60)) for _ in range(200)]
    assert [library.encode(t) for t in plain] == [sentencepiece_viterbi.encode_text(model, t) for t in plain]
    rows = [*texts, *odd]
    coder = sentencepiece_viterbi.SentencePieceEncoder(PIECES, cached=200)
    ids, n = coder.encode(pa.array(rows))
    at = np.cumsum(n) - n
    assert all(ids[at[k] : at[k] + n[k]].tolist() == brute_viterbi(model, t or "") for k, t in enumerate(rows))
    assert [x.decode() for x in coder.decode(ids, n).to_pylist()] == [t or "" for t in rows]
    search = sentencepiece_viterbi.StreamingViterbi(model)
    out = [i for k in range(0, 20000, 100) for i in search.feed("ab" * 50)] + search.finish()
    assert search.widest <= 8 * model.longest and len(out) > 1000
    assert sentencepiece_viterbi.digests(docs, PIECES).filter("NOT round_trip").isEmpty()
    both = sentencepiece_viterbi.decode_documents(sentencepiece_viterbi.encode_documents(docs, PIECES), PIECES)
    assert by_id(both) == by_id(docs)
    assert sentencepiece_viterbi.digests(empty, PIECES).isEmpty()


def test_url_counts_are_exact(spark):
    """With more grams than any fixed table of 65,536 cells keeps apart, scores are still those of exact counts."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_~%=&"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    urls = [f"http://{some(12)}.{end}/es/{some(60)}" for end in ("com", "net", "org") for _ in range(1200)] + ["http://a.net/es/x"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "net", "/es/")]
    found = {r.page_id: r for r in url_filter.url_filter(pages, rules).collect()}
    assert len(found) == len(urls)
    counts = check_urls(urls, found)
    assert len(counts["allow"] | counts["block"]) > 1 << 16
    hot, url_filter.HOT = url_filter.HOT, 4  # most windows meet their urls by the join
    again = {r.page_id: r for r in url_filter.url_filter(pages, rules).collect()}
    url_filter.HOT = hot
    assert all(again[k].score == pytest.approx(found[k].score) for k in found)


def test_short_repeated_lines_go(spark):
    """A line of nine words that many documents have stays in the first alone; two words in common are no repeat."""
    rng = random.Random(4)
    notice = "All of this text may be read by anyone."
    rows = [(k, f"Part one\n{words(rng, 30)}\n{notice}\n{words(rng, 30)}") for k in range(12)]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k].text.count(notice) for k in range(12)] == [1] + [0] * 11
    assert all(found[k].text.startswith("Part one\n") and found[k].removed_words == (9 if k else 0) for k in range(12))


def test_passages_inside_lines_go(spark):
    """A passage goes where it stands in the middle of a paragraph, over line ends, or in a line that was edited elsewhere."""
    rng = random.Random(6)
    said = lambda n: words(rng, n).capitalize() + "."
    one, two, three, short = said(25), said(12), said(20), "So be it."
    passage = f"{one} {two} {short} {three}"
    rows = [
        (1, f"{said(9)} {passage} {said(8)}\n{said(10)}"), (2, f"{said(30)}\n{said(7)} {passage} {said(9)}"), (3, f"{said(11)} {one}\n{two}\n{short}  {three} {said(6)}\n"),
        (4, f"{passage} {said(9)} {passage}"), (5, f"{said(9)} {short} {said(12)}"), (6, "Ah. Oh no.\nWell. So it is.\n" + said(9)), (7, said(9) + "\nAh. Oh no.\nWell. So it is."),
    ]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {d: re.sub(r"\s+", " ", r.text) for d, r in found.items()}
    assert left[1] == re.sub(r"\s+", " ", rows[0][1]) and left[5] == rows[4][1] and left[6] == re.sub(r"\s+", " ", rows[5][1])
    for d in (2, 3, 4):
        assert not any(x in left[d] for x in (one, two, three, short))
        # next to a passage, a word or two may agree by chance with what stands there in the first document
        assert 0 <= found[d].removed_words - 60 * (1 + (d == 4)) <= 2
    assert found[2].text.count("\n") == 1 and found[7].text == rows[6][1].split("\n")[0]
    check_spans(dict(rows), found)


def test_licence_headers_and_texts(spark):
    """Notices that go over line ends, end a long line, or are whole licence texts on one line or wrapped."""
    rng = random.Random(9)
    body = lambda n=60: words(rng, n)

    def wrapped(text, mark=""):
        return "\n".join(mark + line for line in textwrap.wrap(text, 72))

    apache, gpl, mit = (max(licences.TEMPLATES[k], key=len) for k in ("Apache-2.0", "GPL-3.0", "MIT"))
    opening = licences.TEMPLATES["GPL-3.0"][-1]
    files = [
        ("g/x.c", wrapped(gpl, " * ") + "\n" + body(), "GPL-3.0", False), ("m/x.py", body() + "\n" + wrapped(mit[:460], "# ") + "\n" + body(), "MIT", False), ("a/x.js", apache + "\n" + body(200), "Apache-2.0", False),
        ("n/x.txt", body(17) + " licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", False), ("n/long.txt", body(900) + " Released under the MIT License. " + body(900), "MIT", False),
        ("t/one.txt", "The MIT License Copyright (c) 2020 Some One. All rights reserved. " + mit, "MIT", True), ("t/sub/y.py", body(), "MIT", False), ("u/COPYING", opening + " " + body(3000), "GPL-3.0", True), ("u/z.py", body(), "GPL-3.0", False),
        ("none/x.py", body(30) + " the rights of all and the license of some " + body(300), None, False),
    ]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t, _, _) in enumerate(files)], "doc_id long, place string, text string")
    found = {r.path: (r.licence, r.is_file) for r in licences.scan(docs, F.col("place")).collect()}
    assert found == {p: (name, is_file) for p, _, name, is_file in files}


def test_licence_files(spark):
    """Whole texts on one line or wrapped are licence files whatever their name; a header makes no licence file, however short the file."""
    rng = random.Random(10)
    texts = licences.licence_texts()
    assert set(texts) >= {"MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MPL-2.0"}
    header = "\n".join("# " + line for line in textwrap.wrap(max((t for t in licences.TEMPLATES["Apache-2.0"] if "writing" in t), key=len), 72))
    files = [("one/LICENSE", " ".join(texts["MIT"].split()), "MIT", True, None), ("one/a/x.py", words(rng, 40), "MIT", False, "one"), ("src/head.py", header, "Apache-2.0", False, None), ("src/other.py", words(rng, 40), None, False, None)]
    for name, text in texts.items():
        lines = textwrap.wrap(text.replace("<year>", "2021").replace("<copyright holder>", "Some One"), 50)
        files += [(f"w/{name}/notes.txt", "\n".join(lines), name, True, None), (f"w/{name}/deep/down/y.c", words(rng, 30), name, False, f"w/{name}")]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t, *_) in enumerate(files)], "doc_id long, place string, text string").withColumn("dir", F.lit("x")).withColumn("row", F.lit(1))
    for hot in (licences.HOT, 1):
        before, licences.HOT = licences.HOT, hot
        found = {r.path: (r.licence, r.is_file, r.from_directory) for r in licences.scan(docs, F.col("place")).collect()}
        licences.HOT = before
        assert found == {p: (name, is_file, given) for p, _, name, is_file, given in files}


def test_licence_cosines_are_plain_tf_idf(spark):
    rng = random.Random(11)
    rows = [words(rng, 40) + " license the rights " * rng.randint(0, 3) for _ in range(30)] + ["Released under the MIT license, somewhat.", "all  rights\nRESERVED"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    counts, n = licences.document_frequencies(docs)
    assert n == len(rows) and all(c == sum(w in licences._words(t) for t in rows) for w, c in counts.items())
    idf = {w: np.log((1 + n) / (1 + c)) + 1 for w, c in counts.items()}
    matcher = licences.Matcher(idf, texts=licences.licence_texts())
    rare = max(idf.values())
    weigh = lambda text: {w: (1 + np.log(k)) * idf.get(w, rare) for w, k in collections.Counter(licences._words(text)).items()}
    notices = [t for listed in licences.TEMPLATES.values() for t in listed] + list(licences.licence_texts().values())
    for text in rows[-4:]:
        x = weigh(text)
        for k, cosine in matcher.cosines(licences._words(text), range(len(notices))):
            y = weigh(notices[k])
            assert cosine == pytest.approx(sum(x[w] * y.get(w, 0) for w in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())))


def test_near_duplicates_with_repeated_ids(spark):
    """Rows of one id with different texts are one document: what is like either is in its class, and each row has one class."""
    rng = random.Random(21)
    x, y, z = (words(rng, 50) for _ in range(3))
    rows = [(5, x), (5, y), (3, y), (7, x + " end"), (9, z), (9, z), (None, z), (2, z + " more"), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept_id", F.lit(1)).withColumn("id", F.lit(2)).withColumn("band", F.lit(3))
    found = sorted((str(r.doc_id), r.class_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert found == sorted([("5", 3, False), ("5", 3, False), ("3", 3, True), ("7", 3, False), ("9", 2, False), ("9", 2, False), ("None", None, True), ("2", 2, True), ("11", 11, True)])
    kept = near_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["11", "2", "3", "None"]
    before, near_dedup.GROUP, near_dedup.GROUP_BYTES = (near_dedup.GROUP, near_dedup.GROUP_BYTES), 2, 1000
    again = sorted((str(r.doc_id), r.class_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    near_dedup.GROUP, near_dedup.GROUP_BYTES = before
    assert again == found


LONG = " ".join(f"word{k % 70_001} and" for k in range(400_000))


@pytest.mark.parametrize("name", ["exact", "near", "tokens", "toxicity", "lines", "packing", "licences", "quality", "pieces", "urls"])
def test_awkward_tables(spark, name):
    """Null and repeated ids, null and empty texts, a text of several MB, equal rows, and columns with the operators' own names."""
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "same  text here"), (6, LONG), (6, "other text of this id"), (None, None)]
    clash = ["_id", "id", "_kept_id", "norm", "hash", "rep", "label", "band", "size", "content", "text_sha256", "kept", "keep_id", "dir", "row", "path", "url", "y", "x", "buckets", "start", "length", "n_words", "toxic", "_of", "_y", "host", "c0"]
    docs = spark.createDataFrame([(d, t, *map(str, range(len(clash)))) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    empty, n = docs.limit(0), len(rows)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 1, 0), (6, 1, 0), (99, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("y", F.lit(2))

    def both(f):
        assert f(empty).isEmpty()
        return f(docs).collect()

    if name == "exact":
        found = both(exact_dedup)
        assert len(found) == n and {r.keep_id for r in found if r.doc_id in (4, 5)} == {4}
        assert kept_documents(docs).columns == docs.columns and both(kept_documents)
    elif name == "near":
        found = both(near_dedup.near_duplicates)
        assert len(found) == n and all((r.doc_id is None) == (r.class_id is None) for r in found)
        assert near_dedup.distinct_documents(docs).columns == docs.columns
    elif name == "tokens":
        f = lambda df: token_files.read_token_files(spark, token_files.write_token_files(df, BPE, 2))
        found = both(f)
        assert len(found) == n and {r.n_tokens for r in found if r.doc_id in (1, 2)} == {1} and max(r.n_tokens for r in found) > 800_000
        ends = sorted((r.start, r.n_tokens) for r in found)
        assert all(a + k == b for (a, k), (b, _) in zip(ends, ends[1:], strict=False))
    elif name == "toxicity":
        categories = {"toxic": F.col("label_toxic")}
        chain = toxicity.train(docs, labels, categories)
        assert len(both(lambda df: toxicity.toxicity(df, chain))) == n
        assert toxicity.train(empty, labels, categories).categories == ("toxic",)
    elif name == "lines":
        assert len(both(line_dedup.dedup_lines)) == n
    elif name == "packing":
        found = both(lambda df: packing.pack_documents(df, BPE, 0))
        assert {str(r.doc_id) for r in found} == {str(d) for d, _ in rows} and max(r.doc_tokens for r in found) > 800_000
        per = collections.Counter()
        for r in found:
            per[r.sequence_id] += r.length
        assert max(per.values()) <= 1024
    elif name == "licences":
        found = both(lambda df: licences.scan(df, F.when(F.col("doc_id") != 4, F.concat(F.lit("p/"), "doc_id"))))
        assert len(found) == n and all(r.licence is None for r in found)
    elif name == "quality":
        trees = quality.train(docs, labels)
        found = both(lambda df: quality.quality_rules(df, trees))
        assert len(found) == n and max(r.n_words for r in found) == 800_000 and quality.good_documents(docs, trees).columns == docs.columns
        assert quality.train(empty, labels).probability(np.zeros((1, 12)))[0] == 0.5
    elif name == "pieces":
        short = docs.withColumn("text", F.substring("text", 1, 400_000))  # the search is slow in Python
        f = lambda df: sentencepiece_viterbi.digests(df, PIECES)
        assert f(empty).isEmpty()
        found = f(short).collect()
        assert len(found) == n and all(r.round_trip for r in found)
    else:
        pages = docs.withColumn("url", F.concat(F.lit("http://a.com/"), F.substring("text", 1, 20_000)))
        f = lambda df: url_filter.url_filter(df, [url_filter.Rule("allow", "com", "/other")], "doc_id")
        assert f(pages.limit(0)).isEmpty()
        found = f(pages).collect()
        assert len(found) == n and {r.verdict for r in found} == {"allow"}


def test_the_driver_gets_a_bounded_sample(spark):
    """An id that a thousand rows have is one training row."""
    docs = spark.createDataFrame([(1, f"some text number {k} with a few words in it") for k in range(1000)] + [(k, f"other text {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(1, 40)] * 3, "doc_id long, quality int, toxic boolean")
    seen = []
    before = boosting.fit
    quality.boosting.fit = lambda x, y, signs: seen.append(len(y)) or before(x, y, signs)
    try:
        quality.train(docs, labels)
    finally:
        quality.boosting.fit = before
    before_chain = toxicity.fit_chain
    toxicity.fit_chain = lambda c, row, bucket: seen.append(len(next(iter(c.values())))) or before_chain(c, row, bucket)
    try:
        toxicity.train(docs, labels, {"t": F.col("label_toxic")})
    finally:
        toxicity.fit_chain = before_chain
    assert seen == [39, 39]

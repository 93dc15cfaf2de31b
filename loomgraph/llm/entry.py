"""The opN queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, line_dedup, quality, sentencepiece_viterbi, toxicity
from .common import table
from .divergence import divergence
from .exact_dedup import exact_dedup
from .interactions import filter_interactions
from .near_dedup import near_duplicates
from .packing import pack_documents
from .token_files import read_token_files, write_token_files
from .topk import top_k
from .url_filter import Rule, url_filter

URL_RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256, md5(norm) AS text_md5
FROM t JOIN g USING (norm)
"""


#: All pairs that share a shingle, compared in full; classes by the links' closure. Texts without words are one class.
OP2_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
copies AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY ws) AS rep, ws FROM w),
reps AS MATERIALIZED (SELECT doc_id AS id, ws FROM copies WHERE doc_id = rep),
shingles AS (
  SELECT id, md5(array_to_string(ws[i : i + 4], ' ')) AS s FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM reps WHERE len(ws) >= 5)
  UNION ALL SELECT id, md5(array_to_string(ws, ' ')) FROM reps WHERE len(ws) BETWEEN 1 AND 4),
counts AS MATERIALIZED (SELECT id, s, count(*) AS n FROM shingles GROUP BY ALL),
sizes AS MATERIALIZED (SELECT id, sum(n) AS n FROM counts GROUP BY id),
shared AS (SELECT a.id AS x, b.id AS y, sum(least(a.n, b.n)) AS n FROM counts a JOIN counts b USING (s) WHERE a.id < b.id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared s JOIN sizes a ON a.id = x JOIN sizes b ON b.id = y WHERE s.n >= 0.8::DOUBLE * (a.n + b.n - s.n)),
ties AS MATERIALIZED (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT a, b FROM ties UNION SELECT r.a, t.b FROM reach r JOIN ties t ON t.a = r.b),
labels AS (SELECT a AS id, least(a, min(b)) AS label FROM reach GROUP BY a)
SELECT doc_id, coalesce(label, rep) AS class_id, rep AS copy_of, doc_id = coalesce(label, rep) AS kept
FROM copies LEFT JOIN labels ON id = rep
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(spark, write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain goes over toxicity in each language to toxicity in any."""
    docs = table(spark, sf_dir, "documents")
    toxic = F.col("label_toxic")
    categories = {f"toxic_{lang}": F.when(F.col("lang") == lang, toxic) for lang in ("en", "fr", "de", "es")} | {"toxic": toxic}
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), categories))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of MIN_WORDS words or more; shorter lines that documents share (source names, greetings) stay."""
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_line_words=line_dedup.MIN_WORDS))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source and language are the directories."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan(table(spark, sf_dir, "documents"), path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.c::DOUBLE[], b.c::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM (SELECT DISTINCT row, lang, term FROM found) GROUP BY lang, term HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS MATERIALIZED (SELECT DISTINCT d.lang, d.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM d LEFT JOIN totals USING (lang, source) LEFT JOIN sizes ON sizes.lang = d.lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (g.total + 5 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts) WHERE part = 'pair' OR rank <= 50
"""


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order walked mask by mask.
OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS MATERIALIZED (SELECT row_number() OVER () AS row, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS failed
  FROM w LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders(o) AS (SELECT l FROM letters UNION ALL SELECT o || l FROM orders, letters WHERE NOT contains(o, l) AND length(o) < 5),
steps AS (SELECT o AS filter_order, s::INTEGER AS step, substr(o, s::INTEGER, 1) AS f, substr(o, 1, s::INTEGER - 1) AS earlier FROM orders, range(1, 6) t(s) WHERE length(o) = 5),
parts AS (SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM fails GROUP BY ALL),
met AS (SELECT p.*, s.*, contains(failed, f) AS now, earlier <> '' AND regexp_matches(failed, '[' || earlier || '_]') AS before FROM parts p, steps s),
sums AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT now AND NOT before THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN now AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN now AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN now AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN now AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM sums
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_near_dedup": op2_near_dedup,
        "op3_token_files": op3_token_files,
        "op4_url_filter": op4_url_filter,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_licences": op8_licences,
        "op9_quality_rules": op9_quality_rules,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_exact_top_k": op11_exact_top_k,
        "op12_source_divergence": op12_source_divergence,
        "op13_filter_interactions": op13_filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    """For the others: fitted models, sequences of ids and units that hashes of words delimit have no SQL form."""
    return {"op1_exact_dedup": OP1_SQL, "op2_near_dedup": OP2_SQL, "op11_exact_top_k": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_interactions": OP13_SQL}

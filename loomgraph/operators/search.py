"""Ranked full-text search over nodes or other texts."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.lineage import materialise

COLUMNS = ("name", "qualified_name", "signature", "metadata")
K1, B = 1.2, 0.75


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; the last may be a prefix; column None means any."""

    tokens: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Node:
    op: str
    parts: tuple[Node | Phrase, ...]


def _folding() -> tuple[str, str]:
    """Letters with one accent and the letters without it; after those, the accents themselves, which go."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and unicodedata.combining(parts[1]):
            pairs.append((c, parts[0]))
    accents = "".join(map(chr, range(0x300, 0x370)))
    return "".join(c for c, _ in pairs) + accents, "".join(p for _, p in pairs)


_FROM, _TO = _folding()
_FOLD = {ord(c): _TO[k] if k < len(_TO) else None for k, c in enumerate(_FROM)}
#: What tokens are made of.
_IN = r"[\p{L}\p{N}\p{Co}]"
_OUT = r"[^\p{L}\p{N}\p{Co}]"


def tokens(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.translate(_FOLD).lower()))


def folded(text: Column) -> Column:
    """Lower case without accents; null counts as empty."""
    found = F.coalesce(text.cast("string"), F.lit(""))
    return F.lower(F.when(found.rlike(r"[^\x00-\x7F]"), F.translate(found, _FROM, _TO)).otherwise(found))


def token_column(text: Column) -> Column:
    """Lower-case runs of letters and digits, without accents."""
    return F.regexp_extract_all(folded(text), F.lit(f"({_IN}+)"), F.lit(1))


def parse(query: str, columns: tuple[str, ...] = COLUMNS) -> Node | Phrase:
    """Words (all must occur), OR, NOT, "phrases", prefix*, column:word, parentheses."""
    found = re.findall(r'\s*(?:(\()|(\))|(\w+)\s*:\s*|"((?:[^"]|"")*)"\s*(\*)?|([^\s()":*]+)(\*)?)', query)
    if re.sub(r'\s*(?:\(|\)|\w+\s*:\s*|"(?:[^"]|"")*"\s*\*?|[^\s()":*]+\*?)', "", query).strip():
        raise QuerySyntaxError(query)
    at = 0

    def peek() -> str | None:
        return None if at >= len(found) else found[at][0] or found[at][1] or found[at][5] or "x"

    def phrase() -> Node | Phrase:
        nonlocal at
        if at >= len(found):
            raise QuerySyntaxError(query)
        opened, closed, column, quoted, star, bare, bare_star = found[at]
        at += 1
        if opened:
            inner = either()
            if peek() != ")":
                raise QuerySyntaxError(query)
            at += 1
            return inner
        if column:
            if column not in columns:
                raise QuerySyntaxError(query)
            inner = phrase()
            if not isinstance(inner, Phrase) or inner.column:
                raise QuerySyntaxError(query)
            return Phrase(inner.tokens, inner.prefix, column)
        words = tokens(quoted or bare)
        if closed or bare in ("OR", "NOT", "AND") or not words or (bare and not re.fullmatch(r"\w+", bare)):
            raise QuerySyntaxError(query)
        return Phrase(words, bool(star or bare_star))

    def without() -> Node | Phrase:
        nonlocal at
        left = phrase()
        while peek() == "NOT":
            at += 1
            left = Node("not", (left, phrase()))
        return left

    def all_() -> Node | Phrase:
        nonlocal at
        parts = [without()]
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                at += 1
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def either() -> Node | Phrase:
        nonlocal at
        parts = [all_()]
        while peek() == "OR":
            at += 1
            parts.append(all_())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    tree = either()
    if at != len(found):
        raise QuerySyntaxError(query)
    return tree


def _pattern(p: Phrase) -> str:
    """Fits, without taking a character, wherever the phrase begins: overlapping occurrences all count."""
    body = f"{_OUT}+".join(re.escape(t) for t in p.tokens)
    return f"(?<!{_IN})(?={body}{'' if p.prefix else f'(?!{_IN})'})"


def _frequency(p: Phrase, columns: tuple[str, ...]) -> Column:
    """How often the phrase occurs."""
    return reduce(Column.__add__, [F.regexp_count(f"_t_{c}", F.lit(_pattern(p))) for c in (columns if p.column is None else (p.column,))])


def _phrases(tree: Node | Phrase, positive: bool = True) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree] if positive else []
    if tree.op == "not":
        return _phrases(tree.parts[0], positive)
    return [p for part in tree.parts for p in _phrases(part, positive)]


def _matches(tree: Node | Phrase, counts: dict[Phrase, str]) -> Column:
    if isinstance(tree, Phrase):
        return F.col(counts[tree]) > 0
    parts = [_matches(p, counts) for p in tree.parts]
    if tree.op == "not":
        return parts[0] & ~parts[1]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.op == "and" else out | p
    return out


def _all_phrases(tree: Node | Phrase) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else [p for part in tree.parts for p in _all_phrases(part)]


def _score(n: int, mean: float | None, phrases: list[tuple[Column, int]], length: Column) -> Column:
    """BM25 of phrases (frequency, rows that have it) in a row of that length."""
    score = F.lit(0.0)
    for f, df in phrases:
        idf = F.greatest(F.log(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean or 1.0)))
    return score


def search(rows: DataFrame, query: str, limit: int | None = 50, id_col: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """rows that match, with score (BM25, larger is better), best first; ties by id. limit None returns all.

    A query that is no valid match expression becomes a LIKE over name and qualified_name (the first two
    columns), where % and _ of the query are wildcards, ordered by id with score 0.

    Two passes over the text columns: one aggregates the collection's size, mean length and each phrase's document
    frequency to a single row, one scores. Nothing is shuffled but the top rows. For many queries over the same rows, build an Index.
    """
    try:
        tree = parse(query, columns)
    except QuerySyntaxError:
        like = F.lit(False)
        for c in columns[:2]:
            like = like | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
        found = rows.filter(like).withColumn("score", F.lit(0.0)).orderBy(id_col)
        return found if limit is None else found.limit(limit)
    phrases = list(dict.fromkeys(_phrases(tree)))
    counts = {p: f"_f{k}" for k, p in enumerate(dict.fromkeys([*phrases, *_all_phrases(tree)]))}
    # the row number keeps the optimizer from moving the folding into each use of the text
    split = rows.withColumns({f"_t_{c}": folded(F.col(c)) for c in columns} | {"_row": F.monotonically_increasing_id()})
    length = reduce(Column.__add__, [F.regexp_count(f"_t_{c}", F.lit(f"{_IN}+")) for c in columns])
    counted = split.withColumns({"_len": length} | {name: _frequency(p, columns) for p, name in counts.items()})
    n, mean, *have = counted.filter("_row >= 0").agg(F.count(F.lit(1)), F.avg("_len"), *[F.count_if(F.col(counts[p]) > 0) for p in phrases]).first()
    score = _score(n, mean, [(F.col(counts[p]), df) for p, df in zip(phrases, have, strict=True)], F.col("_len"))
    found = counted.filter(_matches(tree, counts) & (F.col("_row") >= 0)).withColumn("score", score).select(*rows.columns, "score").orderBy(F.desc("score"), id_col)
    return found if limit is None else found.limit(limit)


def postings(rows: DataFrame, id_col: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(term, doc_id, tf): the index to keep where many queries run over the same rows."""
    words = F.concat(*[token_column(F.col(c)) for c in columns])
    return rows.select(F.col(id_col).alias("doc_id"), F.explode(words).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


#: Places of terms in a bucket, and in a file of it, about; and buckets at most.
BUCKET_PLACES, FILE_PLACES, MOST_BUCKETS = 1 << 18, 1 << 22, 4096
#: Terms that a prefix is replaced by at most; beyond, all buckets are read for it.
MOST_TERMS = 1000


def write_index(rows: DataFrame, folder: str, id_col: str, columns: tuple[str, ...], buckets: int | None = None) -> tuple[int, int, int]:
    """Writes lengths (id, length), postings (bucket, term, id, field, places) and terms (term, bucket); (rows, places, buckets).

    A bucket is a hash of the term and a folder, and rows lie in order of terms, so a term is a few row groups of one
    folder. terms is the dictionary: all terms in order, so a prefix is a few row groups too. buckets: by default as many as the places ask for.
    """
    spark = rows.sparkSession
    split = rows.select(F.col(id_col).alias("id"), *[token_column(F.col(c)).alias(f"t{k}") for k, c in enumerate(columns)])
    length = reduce(Column.__add__, [F.size(f"t{k}") for k in range(len(columns))])
    split.select("id", length.alias("length")).write.mode("overwrite").parquet(f"{folder}/lengths")
    n, places = spark.read.parquet(f"{folder}/lengths").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    buckets = buckets or min(MOST_BUCKETS, max(1, -(-places // BUCKET_PLACES)))
    files = max(1, -(-places // (buckets * FILE_PLACES)))
    parts = [split.select("id", F.lit(c).alias("field"), F.posexplode(f"t{k}").alias("place", "term")) for k, c in enumerate(columns)]
    posted = reduce(DataFrame.unionAll, parts).groupBy("term", "id", "field").agg(F.sort_array(F.collect_list("place")).alias("places"))
    posted = posted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    kind = rows.schema[id_col].dataType.simpleString()
    terms = spark.read.schema(f"term string, id {kind}, field string, places array<int>, bucket int").parquet(f"{folder}/postings").select("term", "bucket").distinct()
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
    return n, places, buckets


class Index:
    """Postings and lengths in a folder: a query reads the terms it names, and scores the rows that have them. See write_index; totals is one row."""

    def __init__(self, folder: str, columns: tuple[str, ...] = COLUMNS, buckets: int | None = None) -> None:
        self.folder, self.columns, self.buckets = folder.rstrip("/"), columns, buckets

    @classmethod
    def build(cls, rows: DataFrame, folder: str, id_col: str = "id", columns: tuple[str, ...] = COLUMNS, buckets: int | None = None) -> Index:
        """Writes the index of rows. Ids are unique. One shuffle, of (term, id) with all places of a term in a row."""
        found = cls(folder, columns)
        n, places, found.buckets = write_index(rows, found.folder, id_col, columns, buckets)
        totals = rows.sparkSession.createDataFrame([(n, places / n if n else None, found.buckets)], "n long, mean double, buckets int")
        totals.write.mode("overwrite").parquet(f"{found.folder}/totals")
        return found

    def search(self, rows: DataFrame, query: str, limit: int | None = 50, id_col: str = "id") -> DataFrame:
        """What search(rows, query, limit, id_col, columns) gives, from the index of rows. Texts are read for what is found alone, or where a query is no match expression."""
        try:
            found = self.hits(rows.sparkSession, query, limit, rows.schema[id_col].dataType.simpleString())
        except QuerySyntaxError:
            return search(rows, query, limit, id_col, self.columns)
        found = found.withColumnRenamed("id", "_hit")
        return rows.join(found, F.col(id_col) == F.col("_hit")).select(*rows.columns, "score").orderBy(F.desc("score"), id_col)

    def hits(self, spark: SparkSession, query: str, limit: int | None = 50, id_type: str = "string") -> DataFrame:
        """(id, score), best first: the search without the rows' columns. A query that is no match expression is an error."""
        tree = parse(query, self.columns)
        postings, lengths, n, mean = self._read(spark, id_type)
        everything = list(dict.fromkeys(_all_phrases(tree)))
        phrases = [p for p in everything if p in set(_phrases(tree))]
        counts = {p: f"f{k}" for k, p in enumerate(everything)}
        found = reduce(DataFrame.unionAll, [self._occurrences(spark, postings, p).select("id", "_layer", F.lit(counts[p]).alias("phrase"), "f") for p in everything])
        found = found.groupBy("id", "_layer").pivot("phrase", list(counts.values())).agg(F.sum("f")).na.fill(0)
        found = materialise(self._alive(found))
        have = found.agg(*[F.count_if(F.col(counts[p]) > 0) for p in phrases]).first()
        scored = found.filter(_matches(tree, counts)).join(lengths, ["id", "_layer"])
        score = _score(n, mean, [(F.col(counts[p]), df) for p, df in zip(phrases, have, strict=True)], F.col("length"))
        best = scored.select("id", score.alias("score")).orderBy(F.desc("score"), "id")
        return best if limit is None else best.limit(limit)

    def _read(self, spark: SparkSession, id_type: str) -> tuple[DataFrame, DataFrame, int, float | None]:
        """(postings, lengths, rows, mean length)."""
        n, mean, self.buckets = spark.read.parquet(f"{self.folder}/totals").first()
        return *self._tables(spark, [self.folder], id_type), n, mean

    @staticmethod
    def _tables(spark: SparkSession, folders: list[str], id_type: str) -> tuple[DataFrame, DataFrame]:
        schemas = {"postings": f"term string, id {id_type}, field string, places array<int>, bucket int", "lengths": f"id {id_type}, length int"}
        read = lambda name: reduce(DataFrame.unionAll, [spark.read.schema(schemas[name]).parquet(f"{f}/{name}").withColumn("_layer", F.lit(k)) for k, f in enumerate(folders)])
        return read("postings"), read("lengths")

    def _folders(self) -> list[str]:
        return [self.folder]

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (id, _layer) that nothing has replaced."""
        return rows

    def _prefixed(self, spark: SparkSession, prefix: str) -> list[tuple[str, int]] | None:
        """(term, bucket) of the terms that begin so, from the dictionaries; None if they are many."""
        none = spark.createDataFrame([], "term string, bucket int")
        terms = reduce(DataFrame.unionAll, [spark.read.schema("term string, bucket int").parquet(f"{f}/terms") for f in self._folders()], none)
        found = terms.filter(F.col("term").startswith(prefix)).distinct().limit(MOST_TERMS + 1).collect()
        return None if len(found) > MOST_TERMS else [tuple(r) for r in found]

    def _occurrences(self, spark: SparkSession, postings: DataFrame, p: Phrase) -> DataFrame:
        """(id, _layer, f) of rows that have the phrase: each token's places, less its place in the phrase, must meet."""
        if p.column is not None:
            postings = postings.filter(F.col("field") == p.column)
        hashes = spark.createDataFrame([(t,) for t in set(p.tokens)], "t string").select("t", F.xxhash64("t").alias("h")).collect()
        bucket = {r.t: r.h % self.buckets for r in hashes}
        begins = None
        for k, t in enumerate(p.tokens):
            if p.prefix and k == len(p.tokens) - 1:
                terms = self._prefixed(spark, t)
                own = postings.filter(F.col("term").startswith(t)) if terms is None else postings.filter(F.col("bucket").isin(sorted({b for _, b in terms})) & F.col("term").isin(sorted(w for w, _ in terms)))
            else:
                own = postings.filter((F.col("bucket") == bucket[t]) & (F.col("term") == t))
            places = own.select("id", "_layer", "field", F.explode("places").alias("place")).select("id", "_layer", "field", (F.col("place") - k).alias("begin")).distinct()
            begins = places if begins is None else begins.join(places, ["id", "_layer", "field", "begin"])
        return begins.groupBy("id", "_layer").agg(F.count(F.lit(1)).alias("f"))

"""Near-duplicate detection: BagMinHash signatures, banding, exact multiset overlap, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import identities, signatures
from .common import Words, blocks, checkpoint, files_for, forget, met, mix, with_ids

#: Words of a shingle, and the weighted Jaccard similarity of shingle multisets that makes a link.
SHINGLE = 5
SIMILARITY = 0.8
#: Registers: BANDS * ROWS. A pair at the threshold shares no band with probability (1 - 0.8**5)**25 = 5e-5.
BANDS, ROWS = 25, 5
#: Documents that are compared with one, or with as many others, in one group of a task.
GROUP = 512
#: Bytes of text in one group of a task, about: documents of many megabytes make smaller groups.
GROUP_BYTES = 1 << 25
#: Rounds of nearest partners before all that is left is compared; they save work and change no result.
NEAREST_ROUNDS = 2
#: Pairs of a residual bucket whose signatures agree in less than this share are not verified: with 125
#: registers the share of a pair at 0.8 falls below it with probability 2e-7.
LEAST_SHARE = 0.62


def shingle_counts(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, Words]]:
    """For runs of rows: (first row, end row, row of each distinct shingle, its hash, how often it occurs, the words).

    A text of one to four words has one shingle, all of them. A text without words has none.
    """
    for a, b, data, offsets in blocks(text):
        w = Words(data, offsets)
        first, h = w.windows(SHINGLE)
        row = w.row[first]
        short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
        if len(short):
            words = w.hashes()
            extra = np.array([reduce(lambda x, y: mix(x * np.uint64(3) + y), words[w.bounds[r] : w.bounds[r + 1]], np.full(1, w.counts[r], np.uint64))[0] for r in short], np.uint64)
            row, h = np.concatenate([row, short]), np.concatenate([h, extra])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield a, b, row[at], h[at], np.diff(np.append(at, len(h))), w


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, content (16-byte digest of the word sequence), signature (32 bits a register), bands (a hash for each) and size (bytes of text)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, h, n, w in shingle_counts(batch.column(1)):
                ids = identities(signatures(row, h, n, b - a, BANDS * ROWS))
                some = w.counts > 0
                parts = ids.reshape(b - a, BANDS, ROWS)
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (b - a, BANDS)).copy()
                for k in range(ROWS):
                    band = mix(band * np.uint64(0xD1342543DE82EF95) + parts[:, :, k])
                words = w.hashes()
                content = [hashlib.blake2b(words[x:y].tobytes(), digest_size=16).digest() for x, y in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
                short = (ids & np.uint64(0xFFFFFFFF)).astype("<u4")
                lists = [band[r].view(np.int64) if some[r] else np.zeros(0, np.int64) for r in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(content, pa.binary()), pa.array([s.tobytes() for s in short], pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(np.diff(w.offsets))],
                    names=["_id", "content", "signature", "bands", "size"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(measured, f"_id {kind}, content binary, signature binary, bands array<long>, size long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _per_group(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """f over the rows of each key, streamed from sorted partitions: no start-up cost for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            if found := f(group):
                yield pa.record_batch(found)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents with the ids, written once: later joins move these alone."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return checkpoint(texts.join(ids.hint("merge"), "id", "left_semi"))


def _multisets(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted shingle hashes, counts) of each text."""
    found = []
    for a, b, row, h, n, _ in shingle_counts(text):
        edges = np.searchsorted(row, np.arange(b - a + 1))
        found += [(h[edges[r] : edges[r + 1]], n[edges[r] : edges[r + 1]]) for r in range(b - a)]
    return found


def _linked(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    """Whether sum of minima >= similarity * sum of maxima; without shingles on both sides, never."""
    (h0, n0), (h, n) = x, y
    if not len(h0) or not len(h):
        return False
    at = np.minimum(np.searchsorted(h0, h), len(h0) - 1)
    shared = np.where(h0[at] == h, np.minimum(n0[at], n), 0).sum()
    return bool(shared >= similarity * (n0.sum() + n.sum() - shared))


def _parts(n: Column, size: Column) -> Column:
    """Into how many groups n documents of so many bytes in all go."""
    return F.greatest(F.ceil(n / GROUP), F.ceil(size / GROUP_BYTES), F.lit(1)).cast("int")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) of pairs whose shingle multisets have the similarity: sum of minima over sum of maxima.

    Pairs (a, b, size: bytes of b's text) are dealt by their left document in groups of about GROUP partners or
    GROUP_BYTES, each with the left text once, so a document with many or long partners fills many groups.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    counts = pairs.groupBy("a").agg(_parts(F.count(F.lit(1)), F.sum("size")).alias("parts"))
    dealt = checkpoint(pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")))
    left = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast(kind).alias("b"), "text")
    right = dealt.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")

    def overlap(group: pa.Table) -> dict | None:
        group = group.combine_chunks()
        others = group.column("b").to_pylist()
        found = _multisets(group.column("text").combine_chunks())
        own = found[others.index(None)]
        good = [b for b, x in zip(others, found, strict=True) if b is not None and _linked(own, x, similarity)]
        return {"a": group.column("a").combine_chunks().take(pa.array([0] * len(good))), "b": pa.array(good, group.schema.field("b").type)} if good else None

    return _per_group(left.unionByName(right), ["a", "part"], [], overlap, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each end of the links (a, b): label is the smallest id that the links reach.

    Each round takes the smallest label among neighbours, then the label of that label; the rounds follow
    the logarithm of the longest chain. Each is written to the shared folder. A document with very many links, and a
    label that very many documents have, are met by broadcast (their number is bounded, see met), so no task gets all of them.
    """
    edges = checkpoint(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    total = edges.count()
    files = files_for(total)
    labels = last = checkpoint(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"), "degree"), files=files)
    while True:
        near = met(edges, ["b"], labels.select(F.col("id").alias("b"), F.col("label").alias("near"), "degree"), "degree", total=total).groupBy("a").agg(F.min("near").alias("near"))
        moved = labels.join(near, F.col("id") == F.col("a")).select("id", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label that a document takes is one that some document had
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = checkpoint(sizes.join(labels.select("id", F.col("label").alias("jump")), F.col("label") == F.col("id")).select("label", "jump", "n"), files=files)
        now = checkpoint(met(moved, ["label"], jump, "n").select("id", "degree", "old", F.least("label", "jump").alias("label")), files=files)
        forget(last, jump)
        labels, last = now.select("id", "label", "degree"), now
        if now.filter("label <> old").isEmpty():
            forget(edges)
            return labels.select("id", "label")


def _buckets(members: DataFrame) -> DataFrame:
    """Buckets whose members (band, t, id, size, label) are of more than one component: band, n, major (the largest component), lefts, rights.

    The members outside the largest component (left) are to meet all (right), in so many blocks of either side.
    """
    sizes = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    whole = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "label", "bytes")).alias("top"), F.count(F.lit(1)).alias("labels"))
    lefts = _parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    return whole.filter("labels > 1").select("band", "n", F.col("top.label").alias("major"), lefts.alias("lefts"), _parts(F.col("n"), F.col("bytes")).alias("rights"))


def _signed(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Members with their documents' signatures. A document, with its places in at most BANDS buckets, meets its signature once, however many buckets are left."""
    places = members.groupBy("id").agg(F.collect_list(F.struct(*[c for c in members.columns if c != "id"])).alias("places"))
    signed = places.join(reps.select(F.col("_id").alias("id"), "signature"), "id")
    return signed.select("id", "signature", F.explode("places").alias("p")).select("id", "signature", "p.*")


def _blocks(members: DataFrame) -> DataFrame:
    """Members with their bucket's columns, dealt so that all pairs across components meet once; pairs within one need no further link."""
    columns = ("band", "t", "id", "label", "size", "signature")
    rows = members.withColumn("minor", F.col("label") != F.col("major"))
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = rows.filter("minor").select(own("lefts").alias("l"), every("rights").alias("r"), F.lit(True).alias("left"), "minor", *columns)
    right = rows.select(every("lefts").alias("l"), own("rights").alias("r"), F.lit(False).alias("left"), "minor", *columns)
    return left.unionByName(right)


def _hits(group: pa.Table, similar: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(left row, right rows, shares of equal registers) of the pairs to compare in this block.

    Across components, with a share of `similar` or more, that meet in no earlier band, each once.
    """
    side, minor = group.column("left").to_numpy(), group.column("minor").to_numpy()
    ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
    band = group.column("t")[0].as_py()
    registers = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u4").reshape(len(ids), BANDS, ROWS)
    right = np.flatnonzero(~side)
    for k in np.flatnonzero(side).tolist():
        y = right[(labels[right] != labels[k]) & (~minor[right] | (ids[right] > ids[k]))]
        equal = registers[y] == registers[k]
        share = equal.mean((1, 2))
        good = (share >= similar) & (equal.all(2).argmax(1) == band)
        yield k, y[good], share[good]


def _nearest(blocks: DataFrame, similar: float) -> DataFrame:
    """(a, b): of each left member the partner of another component whose signature is nearest."""
    kind = blocks.schema["id"].dataType.simpleString()

    def nearest(group: pa.Table) -> dict | None:
        ids, sizes = group.column("id").to_numpy(), group.column("size").to_numpy()
        best = [(ids[k], ids[j := y[s.argmax()]], sizes[j], float(s.max())) for k, y, s in _hits(group, similar) if len(y)]
        return {name: pa.array([x[i] for x in best]) for i, name in enumerate(("a", "b", "size", "share"))} if best else None

    found = _per_group(blocks, ["band", "l", "r"], ["left", "id"], nearest, f"a {kind}, b {kind}, size long, share double")
    return found.groupBy("a").agg(F.max(F.struct("share", "b", "size")).alias("best")).select("a", F.col("best.b").alias("b"), F.col("best.size").alias("size"))


def _exhausted(blocks: DataFrame, texts: DataFrame, similarity: float, similar: float) -> DataFrame:
    """Links (a, b) among all pairs across components that _hits names; one per left member and other component of a block is enough."""
    kind = blocks.schema["id"].dataType.simpleString()
    schema = f"band long, l int, r int, left boolean, minor boolean, t int, id {kind}, label {kind}, size long, signature binary"

    def named(group: pa.Table) -> dict | None:
        rows = np.zeros(group.num_rows, bool)
        for k, y, _ in _hits(group, similar):
            rows[y] = True
            rows[k] |= len(y) > 0
        chosen = group.filter(pa.array(rows)).combine_chunks()
        return {c: chosen.column(c).combine_chunks() for c in ("band", "l", "r", "left", "minor", "t", "id", "label", "size", "signature")} if rows.any() else None

    few = checkpoint(_per_group(blocks, ["band", "l", "r"], ["left", "id"], named, schema))

    def compared(group: pa.Table) -> dict | None:
        group = group.combine_chunks()
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        found = _multisets(group.column("text").combine_chunks())
        a, b = [], []
        for k, y, share in _hits(group, similar):
            done = set()
            for j in y[np.argsort(-share, kind="stable")].tolist():
                if labels[j] not in done and _linked(found[k], found[j], similarity):
                    done.add(labels[j])
                    a.append(ids[k]), b.append(ids[j])
        return {"a": pa.array(a), "b": pa.array(b)} if a else None

    return _per_group(few.join(texts, "id"), ["band", "l", "r"], ["left", "id"], compared, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, class_id (smallest id of its class), copy_of (smallest id with the
    same words) and kept (whether it is the class's smallest).

    A class is a connected component of the links between documents whose multisets of SHINGLE-word shingles
    (words: [^\\x20\\x09-\\x0D]+, as written) have a weighted Jaccard similarity of `similarity` or more.

    Plan: documents with the same words are one row from the first aggregation on. Each remaining document
    puts a hash of each of its bands into a bucket. First, all members of a bucket are compared with its
    smallest, which settles most groups of copies of any size with one comparison a member. Then members of
    buckets whose documents are not all connected by now are compared with the member of another component
    whose signature is nearest, one comparison a member and round. What is still apart meets across
    components in blocks: signatures first, then texts where they agree enough; only links leave a block. No
    pair that shares a bucket and could be a link between components is left out, and no cap holds anywhere.

    Defined cases: null and empty texts and texts of white space have the same (no) words and so are one class;
    a row without an id is a class of its own (class_id null, kept); rows that repeat an id are one document,
    and all are kept if it is; other columns are not read. Ids must have an order and compare with numpy
    (numbers); very long texts are one block of their own.
    """
    found = checkpoint(features(docs.filter(F.col(id_col).isNotNull()), id_col, text_col))
    files = files_for(found.count())
    copies = checkpoint(found.groupBy("content").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), files=files)
    own = checkpoint(met(found.select("_id", "content"), ["content"], copies, "n", how="left").select("_id", "content", F.coalesce("rep", "_id").alias("rep")), files=files)
    reps = checkpoint(found.join(own.filter("_id <> rep").select("_id", "content"), ["_id", "content"], "left_anti"))
    forget(found, copies)
    # rows that repeat an id are one document, whatever their texts
    ids = checkpoint(own.groupBy("_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")), files=files)
    several = ids.filter("rep <> last").select("_id", F.col("rep").alias("a"))
    same = checkpoint(own.join(several, "_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct(), files=files)
    banded = reps.select(F.col("_id").alias("id"), "size", F.posexplode("bands").alias("t", "band"))
    hubs = checkpoint(banded.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), files=files * 4)
    members = checkpoint(met(banded, ["band"], hubs, "n"))
    forget(hubs)
    texts = texts_of(docs, members.select("id").distinct(), id_col, text_col)
    first = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), "size").distinct()
    links = checkpoint(verified(first, texts, similarity)).unionByName(same)
    labels = components(links)
    share = LEAST_SHARE + similarity - SIMILARITY

    def unsettled() -> DataFrame:
        # buckets of two are settled
        placed = members.filter("n > 2").join(labels, "id", "left").select("band", "t", "id", "size", F.coalesce("label", "id").alias("label"))
        apart = met(placed, ["band"], checkpoint(_buckets(placed), files=files), "n")
        return checkpoint(_blocks(_signed(apart, reps)))

    for _ in range(NEAREST_ROUNDS):
        blocks_left = unsettled()
        more = checkpoint(verified(_nearest(blocks_left, share), texts, similarity))
        forget(blocks_left)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = components(links)
    more = checkpoint(_exhausted(unsettled(), texts, similarity, share))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    classes = ids.join(labels.withColumnRenamed("id", "l_id"), F.col("rep") == F.col("l_id"), "left").select("_id", "rep", F.coalesce("label", "rep").alias("class_id"))
    rows = docs.select(F.col(id_col).alias("id"))
    return rows.join(classes, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias(id_col), "class_id", F.col("rep").alias("copy_of"), (F.col("id").eqNullSafe(F.col("class_id"))).alias("kept")
    )


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    return with_ids(docs, near_duplicates(docs, similarity, id_col, text_col).filter("kept").select(id_col), id_col)

"""Helpers that several operators share: tables, shared folders, byte-level word hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are hashed in one go; bounds the numpy temporaries (about 40 bytes a byte).
BLOCK_BYTES = 1 << 20
#: Rows of an Arrow batch while tables are written.
BATCH_ROWS = 1000

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where that is unset on a single machine (as in tests), a folder under /tmp becomes the setting; on a cluster it
    must be set, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file:///tmp/checkpoints"
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for actions inside: whole texts are long, and a batch stands in memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Narrow rows (ids, labels, counts) of a file, where their number is known before they are written.
FILE_ROWS = 250_000


def files_for(rows: int) -> int:
    """Into how many files so many narrow rows go: a file costs a task and, on local disks, a process that sets its rights."""
    return max(4, -(-rows // FILE_ROWS))


def checkpoint(df: DataFrame, batch_rows: int = BATCH_ROWS, files: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors cost nothing. files: at most so many."""
    spark = df.sparkSession
    out = shared_folder(spark, "table")
    df = df.coalesce(files) if files else df
    with small_batches(spark, batch_rows):
        df.write.parquet(out)
    found = spark.read.schema(df.schema).parquet(out)
    found._table_of_steps = out
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes tables of checkpoint() that nothing reads any more."""
    for df in tables:
        spark, out = df.sparkSession, getattr(df, "_table_of_steps", None)
        if out:
            folder = spark._jvm.org.apache.hadoop.fs.Path(out)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Keys that are broadcast at most: those with a HOT-th of all rows.
HOT = 1024


def met(rows: DataFrame, keys: list[str], table: DataFrame, n: str, hot: int = HOT, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined to table on the keys; table has one row a key, with the number n of its rows, and is read thrice.

    how: inner, or left to keep rows without a key in the table, with nulls. total: the sum of n, where it is known.

    Keys with at least a hot-th of all rows of the table's keys, hot of them at most, are broadcast, and their rows are
    dealt by a hash of their own; the others meet by a join on the keys. So no task gets the rows of a hot key.
    """
    values = [c for c in table.columns if c not in keys]
    least = ((table.agg(F.sum(n)).first()[0] or 0) if total is None else total) / hot
    value = F.struct(*values)
    few = F.broadcast(table.filter(F.col(n) >= least).select(*keys, value.alias("met_hot")))
    rest = table.filter(F.col(n) < least).select(*[F.col(k).alias(f"met_{k}") for k in keys], value.alias("met_cold"))
    is_hot = F.col("met_hot").isNotNull()
    # a hot row's own hash stands in for its key; an equal key's value is not used
    own = F.xxhash64(*rows.columns)
    joined = rows.join(few, keys, "left")
    for k in keys:
        kind = rows.schema[k].dataType.simpleString()
        mine = F.concat(F.lit("/ "), own.cast("string")).cast(kind) if kind in ("string", "binary") else own
        joined = joined.withColumn(f"met_{k}", F.when(is_hot, mine).otherwise(F.col(k)))
    joined = joined.join(rest, [f"met_{k}" for k in keys], "left").withColumn("met_value", F.coalesce("met_hot", "met_cold"))
    joined = joined if how == "left" else joined.filter("met_value IS NOT NULL")
    return joined.select(*rows.columns, *[F.col("met_value")[v].alias(v) for v in values])


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is among the one column of ids (null equals null). Columns may have any names."""
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return rows.join(ids.toDF("id").distinct(), rows[f"c{names.index(id_col)}"].eqNullSafe(F.col("id")), "left_semi").toDF(*names)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        usual = BLOCK_BYTES + (1 << 19)
        steps = np.full(max(n, usual), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= usual:
            _powers[base] = have
    return have


def strings(column: pa.Array) -> pa.Array:
    """The column as one string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("")


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `most` bytes; a longer row is a run of its own."""
    column = strings(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, k, data[offsets[i] : offsets[k]], offsets[i : k + 1] - offsets[i]
        i = k


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a run of texts (or of bytes that `space` leaves), as arrays over all words of the run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> None:
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        inside = ~space[data]
        self.inside = inside
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: The words of row i are bounds[i]:bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        weighted = (data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))[: len(data)]
        self._hashes: np.ndarray | None = None
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(weighted, out=self._sums[1:])

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        low = _power(_INVERSE, len(self.data) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * low[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.hashed(self.starts, self.ends)
        return self._hashes

    def windows(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of n words within a row."""
        h = self.hashes()
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total = mix(total * np.uint64(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k])
        first = np.flatnonzero(self.row[: len(h) - n + 1] == self.row[n - 1 :])
        return first, total[first]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged; fast where few are."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.offsets))


def salted(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows."""
    return mix(h ^ mix(row.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))


def quiet_threads() -> None:
    """One thread per Python worker: Spark's tasks are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")

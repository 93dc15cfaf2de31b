"""Token ids as Arrow IPC files of fixed-size-list batches: equal-length sequences and their masks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder
from .tokens import encoder

#: Ids of a sequence, and sequences of a record batch.
LENGTH = 1024
BATCH = 256
#: Bytes of text that go into one file, about.
SHARD_BYTES = 1 << 28
_MANIFEST = "shard long, path string, docs_path string, n_docs long, n_tokens long, n_sequences long"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class SequenceWriter:
    """Writes ids as they come; holds one batch at most. The file appears under its name when it is whole."""

    def __init__(self, path: str, dtype: type, attempt: int, length: int = LENGTH, batch: int = BATCH) -> None:
        self.fs, self.path = _filesystem(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{attempt}.draft"
        self.length, self.batch, self.dtype = length, batch, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = self.fs.open_output_stream(self.draft)
        self.out = pa.ipc.new_file(self.file, self.schema)
        self.rest = np.zeros(0, dtype)
        self.n_tokens = self.n_sequences = 0

    def _put(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[: len(ids)] = ids
        mask = pa.array(np.arange(len(padded)) < len(ids))
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))
        self.n_sequences += rows

    def write(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        whole = self.length * self.batch
        ids = np.concatenate([self.rest, ids.astype(self.dtype, copy=False)])
        for k in range(0, len(ids) - whole + 1, whole):
            self._put(ids[k : k + whole])
        self.rest = ids[len(ids) - len(ids) % whole :].copy()

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        self.out.close()
        self.file.close()
        self.fs.move(self.draft, self.path)


class SequenceFile:
    """Random access to one file: batches have equal row counts, so sequence k is row k % BATCH of batch k // BATCH."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = _filesystem(path)
        # a mapped local file gives arrays that are views of it; other stores give one buffer per batch
        source = pa.memory_map(self.path) if self.fs.type_name == "local" else self.fs.open_input_file(self.path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self._at = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self._at[0] != k:
            self._at = (k, self.reader.get_batch(k))
        return self._at[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view, not a copy) and mask of sequence k."""
        batch, row = self.batch(k // self.rows), k % self.rows
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
        return ids[row * self.length : (row + 1) * self.length], batch.column("mask")[row].values

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from the file's id `start` on; padding stands at the end only."""
        size, parts = self.rows * self.length, []
        while n:
            k, at = divmod(start, size)
            take = min(n, size - at)
            parts.append(self.batch(k).column("ids").values.to_numpy(zero_copy_only=True)[at : at + take])
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class TokenFiles:
    """Where a corpus's files are: the manifest has a row per shard, in id order."""

    folder: str
    id_type: str

    def shards(self, spark: SparkSession) -> list[tuple]:
        """(shard, path, docs_path, n_docs, n_tokens, n_sequences) in order; one row per file."""
        return sorted(map(tuple, spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").collect()))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> TokenFiles:
    """Writes the ids of every text, each followed by end_id, in ascending id order.

    Range partitioning by id, then by a hash of the text, gives each task a run of rows, which it sorts, encodes and writes to one file
    (sequences of LENGTH ids across document borders; the last is padded and masked) and one index file
    (id, start in the file, number of ids). There are as many files as tasks of a shuffle, or more, so that each
    holds about SHARD_BYTES of text at most. A task that is run again, or twice at once, moves the same bytes to the same name.

    Defined cases: null and empty texts are the end id alone; null ids come first; rows with equal ids, which may
    fill many files, follow each other in the order of a hash of their texts; an empty table has no files.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        path, docs_path = f"{folder}/shard-{shard:07d}.arrow", f"{folder}/shard-{shard:07d}.docs.arrow"
        encode, out, index, index_file = encoder(tokenizer), None, None, None
        n_docs = 0
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                if out is None:
                    out = SequenceWriter(path, encode.dtype, task.taskAttemptId())
                    index_file = out.fs.open_output_stream(f"{out.path}.{task.taskAttemptId()}.docs.draft")
                    index_schema = pa.schema([("id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    index = pa.ipc.new_stream(index_file, index_schema)
                ids, n = encode.encode(batch.column(1))
                n = n + 1
                starts = out.n_tokens + np.cumsum(n) - n
                out.write(np.insert(ids, np.cumsum(n - 1), end_id))
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), pa.array(n)], schema=index_schema))
                n_docs += batch.num_rows
        if out is None:
            return
        out.close()
        index.close()
        index_file.close()
        out.fs.move(f"{out.path}.{task.taskAttemptId()}.docs.draft", _filesystem(docs_path)[1])
        yield pa.record_batch({"shard": [shard], "path": [path], "docs_path": [docs_path], "n_docs": [n_docs], "n_tokens": [out.n_tokens], "n_sequences": [out.n_sequences]})

    order = ["id", F.xxhash64("text"), "text"]
    placed = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    placed.mapInArrow(written, _MANIFEST).write.parquet(f"{folder}/manifest")
    return TokenFiles(folder, docs.schema[id_col].dataType.simpleString())


def read_token_files(spark: SparkSession, files: TokenFiles, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32, n_sequences it lies in."""
    before, shards = 0, []
    for _, path, docs_path, _, n_tokens, _ in files.shards(spark):
        shards.append((path, docs_path, before))
        before += n_tokens
    schema = f"`{id_col}` {files.id_type}, start long, n_tokens long, ids_crc32 long, first_sequence long, shard string"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, docs_path, before in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                file = SequenceFile(path)
                store, place = _filesystem(docs_path)
                with store.open_input_stream(place) as stream:
                    for docs in pa.ipc.open_stream(stream):
                        starts, n = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(file.span(s, k).astype("<u4")) for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("id"), pa.array(starts + before), docs.column("n_tokens"), pa.array(crc, pa.int64()), pa.array(starts // file.length), pa.array([path.rpartition("/")[2]] * len(crc))],
                            names=[id_col, "start", "n_tokens", "ids_crc32", "first_sequence", "shard"],
                        )

    return spark.createDataFrame(shards, "path string, docs_path string, before long").repartition(len(shards)).mapInArrow(read, schema)

"""Token-id files: flat unsigned integers plus 64-bit document offsets.

A shard ``<name>.bin`` holds the ids of its documents one after another (uint16
or uint32, little endian); ``<name>.idx`` holds n+1 offsets (uint64, in ids) and
then the n document ids (int64; the smallest int64 stands for a null id). Shards follow the order of document ids, and
the base of each comes from a prefix sum over the shards' sizes, so no task needs
to know more than its own documents.

Defined results: a null text is an empty one, a document of the end id only; null
ids sort first; repeated rows are documents of their own; other columns are
ignored; an empty table gives no shards.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Scratch, chunks
from .word_tokens import default_path, tokenizer

NULL_ID = -(2**63)
#: Bytes of input a shard, by what Spark's planner knows of the table's size.
SHARD_BYTES = 128 << 20
MANIFEST = "shard string, n_docs long, n_ids long, first_id long, width int"
ARROW = pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("width", pa.int32())])


def _store(uri: str):
    """The pyarrow file system of a uri, and the path there."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    if not rest:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def _written(uri: str):
    """A file that appears under its name only when it is whole, so that a task
    run again, or twice at a time, leaves one good file."""
    store, path = _store(uri)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


@contextmanager
def _mapped(uri: str, dtype) -> Iterator[np.ndarray]:
    """The file as an array: memory-mapped where the store is a mounted folder, else
    read slice by slice. Nothing is copied to this machine."""
    store, path = _store(uri)
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        size = os.path.getsize(path)
        yield np.memmap(path, dtype, "r") if size else np.empty(0, dtype)
        return
    with store.open_input_file(path) as source:
        yield _Slices(source, np.dtype(dtype))


class _Slices:
    """A remote file whose slices are read when asked for."""

    def __init__(self, source, dtype: np.dtype):
        self.source, self.dtype = source, dtype

    def __getitem__(self, part: slice) -> np.ndarray:
        size = self.dtype.itemsize
        begin, end, _ = part.indices(self.source.size() // size)
        return np.frombuffer(self.source.read_at((end - begin) * size, begin * size), self.dtype)


def _writer(folder: str, path: str, end_id: int, dtype: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        name = f"{folder}/shard-{TaskContext.get().partitionId():06d}"
        end = np.array([end_id], "<u4").tobytes()
        ids, lengths = array("q"), array("q")  # eight bytes a document each
        with _written(f"{name}.bin") as out:
            for batch in chunks(batches, "text", owner="word_tokens"):
                tokens, sizes = tok.encode_all(batch.column("text"), end)
                out.write(tokens.astype(dtype).tobytes())
                lengths.frombytes(sizes.astype(np.int64).tobytes())
                ids.frombytes(batch.column("doc_id").fill_null(NULL_ID).to_numpy().astype(np.int64).tobytes())
        if ids:
            offsets = np.append(0, np.cumsum(np.frombuffer(lengths, np.int64))).astype("<u8")
            with _written(f"{name}.idx") as out:
                out.write(offsets.tobytes())
                out.write(ids.tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": name, "n_docs": len(ids), "n_ids": int(offsets[-1]), "first_id": ids[0], "width": np.dtype(dtype).itemsize}], schema=ARROW)

    return write


def _shards(docs: DataFrame) -> int:
    """As many as shuffle partitions, or more where the planner knows that the table has
    more bytes. Tables of unknown size are given as eight exabytes."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES) if size < 1 << 50 else 1)


def write_token_files(docs: DataFrame, folder: str | None = None, *, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", dtype: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write the documents in ascending id order; return the manifest: shard,
    n_docs, n_ids, first_id, width and base (ids in all shards before it).

    Ids are two bytes wide where the tokenizer's ids fit, else four, unless dtype
    says otherwise. There are as many shards as shuffle partitions, or more where the
    table is larger than SHARD_BYTES for each. One shuffle by ranges of the id, and of the place in the input among
    rows that share an id (or have none), so that they need not meet in one task; each
    task streams its sorted documents to one shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token_files")
    path = tokenizer_path or default_path()
    dtype = dtype or ("<u2" if max(tokenizer(path).lib.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
    folder = folder or scratch.path("ids")
    n = partitions or _shards(docs)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    order = F.col("doc_id").asc_nulls_first(), F.col("place").asc()
    sorted_docs = table.repartitionByRange(n, *order).sortWithinPartitions(*order)
    shards = scratch.write(sorted_docs.mapInArrow(_writer(folder, path, end_id, dtype), MANIFEST), "manifest")
    # A row a shard: the prefix sum runs over as many rows as there were tasks. Their
    # names follow the ranges.
    bases, total = [], 0
    for shard, n_ids in sorted((r["shard"], r["n_ids"]) for r in shards.select("shard", "n_ids").toLocalIterator()):
        bases.append((shard, total))
        total += n_ids
    return shards.join(F.broadcast(spark.createDataFrame(bases, "shard string, base long")), "shard")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n, base = row["n_docs"], row["base"]
            with _mapped(f"{row['shard']}.idx", "<u8") as index, _mapped(f"{row['shard']}.bin", f"<u{row['width']}") as ids:
                offsets = np.asarray(index[: n + 1]).astype(np.int64)
                names = np.asarray(index[n + 1 :]).view("<i8")
                begin = 0
                while begin < n:  # about 4 MB of ids at a time
                    end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (1 << 20), "right")) - 1)
                    low = offsets[begin]
                    some = np.asarray(ids[low : offsets[end]]).astype("<u4")
                    own = [some[offsets[i] - low : offsets[i + 1] - low].tobytes() for i in range(begin, end)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[begin:end], mask=names[begin:end] == NULL_ID), pa.array(offsets[begin:end] + base), pa.array(np.diff(offsets[begin : end + 1])), pa.array(own, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    begin = end


def read_token_files(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: doc_id, start, n_tokens and ids (little-endian
    unsigned 32-bit), by mapping each shard's files into memory."""
    n = max(1, min(manifest.count(), 10_000))
    cut = manifest.select("shard", "n_docs", "width", "base").repartition(n, "shard")
    return cut.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = read_token_files(write_token_files(docs))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

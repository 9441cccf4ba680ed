"""Shared plumbing of the training-data operators: scratch tables in the shared
folder, the held-out rule, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or the folder given to
    SparkContext.setCheckpointDir.

    Only where neither is set and the session is a local one, as in tests, a temporary
    folder is made; it is removed when the process ends. On a cluster, where a folder of
    this machine would not be seen by executors, their absence is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_dirs[app] = f"file://{folder}"
    return _local_dirs[app]


#: The scratches made inside a freeing() block, innermost last.
_made: list[list["Scratch"]] = []


@contextmanager
def freeing() -> Iterator[None]:
    """Delete the scratch tables made inside this block when it ends. Results that
    still read them must be written before."""
    _made.append([])
    try:
        yield
    finally:
        for scratch in _made.pop():
            scratch.close()


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read twice.

    A table survives the loss of executors, because it lies in shared storage. Steps
    drop the tables that nothing reads any more; the rest goes with close(), at the end
    of a freeing() block, or when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
        self.count = 0
        path, store = self._hadoop(self.root)
        store.deleteOnExit(path)
        if _made:
            _made[-1].append(self)

    def _hadoop(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of this scratch that no later step reads. A frame that reads
        anything outside this scratch's own folder is refused, and nothing is deleted."""
        path, store = self._hadoop(self.root)
        own = store.makeQualified(path).toUri().getPath().rstrip("/") + "/"
        # The names of input files are encoded as in a URI.
        folders = {unquote(file.rpartition("/")[0]) for df in frames for file in df.inputFiles()}
        for name in folders:
            folder, folder_store = self._hadoop(name)
            if not folder_store.makeQualified(folder).toUri().getPath().startswith(own):
                raise ValueError(f"not a table of this scratch: {name}")
        for name in folders:
            folder, folder_store = self._hadoop(name)
            folder_store.delete(folder, True)

    def close(self) -> None:
        """Delete all its tables."""
        path, store = self._hadoop(self.root)
        store.delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Bytes of an Arrow batch sent to Python. Batches are bounded by rows by default,
#: which long texts and sets make large.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give memory that a finished task no longer needs back to the machine: Python
    workers live on, and their neighbours need it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


#: What modules keep in a Python worker between tasks, and how to drop it.
caches: dict[str, Callable[[], None]] = {}


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20, max_rows: int = 2048, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about max_bytes of text at most
    (one row at least). Stores of other owners than this task's are dropped first,
    since the worker may have served another operator before."""
    for name, drop in caches.items():
        if name != owner:
            drop()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and (total + n > max_bytes or i - begin >= max_rows):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)
    release()


#: Ids that are broadcast at most (8 bytes each); beyond it the tables are shuffled.
BROADCAST_IDS = 1_000_000


def _by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    side = ids.toDF("__listed_id")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        side = F.broadcast(side)
    return docs.join(side, docs[id_col].eqNullSafe(F.col("__listed_id")), how)


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is listed; ids: a stored table of one column."""
    return _by_ids(docs, ids, id_col, "left_semi")


def text_key(text: Column) -> Column:
    """A text's hash; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id and text are not listed together; gone: a stored table of an
    id and a text's hash."""
    side = gone.toDF("__listed_id", "__listed_key")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        side = F.broadcast(side)
    return docs.join(side, docs[id_col].eqNullSafe(F.col("__listed_id")) & (text_key(docs[text_col]) == F.col("__listed_key")), "left_anti")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not listed; ids: a stored table of one column."""
    return _by_ids(docs, ids, id_col, "left_anti")

"""What the training-data operators share: reading, staging in the shared folder, Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
_written: list[str] = []


#: Bytes of an Arrow batch that Spark hands to a worker; its default of 64 MB is as much again in the worker and in the JVM.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session's texts, unless it has chosen a size of its own."""
    if spark.conf.get(BATCH_KEY) in ("67108864b", "64MB"):
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is unset (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        root = _fallback.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidewater-"))
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.
    ``by``: columns of which each value has a folder of its own."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _written.append(path)
    df.write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete all that ``staged`` has written so far. For callers who know that no frame made from it will be read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only if the table is counted and found to have at most ``max_rows`` rows; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


def crc_mod(col: str, n: int):
    """crc32 of the column as text, modulo ``n``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice has at most about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null counts as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; a bare path and ``file:`` are the local or mounted disk."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


@lru_cache(maxsize=1)
def mapped(uri: str) -> np.ndarray:
    """The 8-byte numbers of a file: mapped where the shared folder is a mounted disk, so that a worker holds only pages that it
    reads, else read."""
    fs, path = filesystem(uri)
    if fs.type_name == "local":
        return np.memmap(path, np.uint64, "r") if fs.get_file_info(path).size else np.zeros(0, np.uint64)
    with fs.open_input_stream(path) as source:
        return np.frombuffer(source.read(), np.uint64)


class WordCache(dict):
    """A cache of about ``max_bytes`` in two generations: what is met again in the older one moves to the newer.
    Values have a length, of ``unit`` bytes an element."""

    def __init__(self, max_bytes: int, unit: int = 1):
        super().__init__()
        self.half, self.unit, self.used, self.old = max_bytes // 2, unit, 0, {}

    def keep(self, key, value):
        # An entry of a dictionary and two objects take some 200 bytes besides their contents.
        size = 200 + 2 * len(key) + self.unit * len(value)
        if self.used + size > self.half:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self.used += size
        self[key] = value
        return value

    def keep_all(self, entries: dict) -> None:
        """``keep`` for many at once."""
        size = 200 * len(entries) + 2 * sum(map(len, entries)) + self.unit * sum(map(len, entries.values()))
        if self.used + size > self.half:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self.used += size
        self.update(entries)

    def older(self, key):
        value = self.old.get(key)
        return None if value is None else self.keep(key, value)

    def drop(self):
        self.clear()
        self.used, self.old = 0, {}


_holder: list = ["", ()]


def own(name: str, *caches) -> None:
    """To call as a task begins: what another operator's tasks left in this worker is dropped. ``caches``, with a method ``drop``,
    are this operator's and stay for its next task here."""
    if _holder[0] != name:
        before, _holder[:] = _holder[1], [name, caches]
        if before:
            release(*before)


def release(*caches) -> None:
    """Empty caches and hand freed memory back, as the worker lives on beside other stages' workers."""
    for cache in caches:
        cache.drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Row numbers that are broadcast at most to drop their rows; more of them join by shuffle.
MAX_IDS = 2_000_000
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number for each row, so that repeated and null ids stay apart."""
    bound_batches(docs.sparkSession)
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``numbered`` rows without those whose number is in the only column of ``gone``, and without the number. The numbers are
    written and counted first, so that a small set goes to the rows and the texts don't shuffle."""
    gone = broadcast_if_small(staged(gone.toDF("_gone").distinct(), "gone"), MAX_IDS)
    return rows.join(gone, rows[ROW] == gone["_gone"], "left_anti").drop(ROW)

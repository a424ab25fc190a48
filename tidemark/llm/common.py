"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is spark.checkpoint.dir where the session has one; only without it (local tests) a temporary folder is made
    and set as the session's checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def stored(df: DataFrame, kind: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and losing executors costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


#: Paths of the tables that stored() returned, while their DataFrames live.
_PATHS: dict[int, str] = {}


def forget(df: DataFrame) -> None:
    """Delete a table made by stored(), when nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS[id(df)])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df to be broadcast if its rows, of row_bytes and 16 more each, are counted to be at most BROADCAST_BYTES; else as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * (row_bytes + 16) <= BROADCAST_BYTES else df


#: Bytes of an Arrow batch.  Whole texts can be long, and the JVM and a Python worker both hold a batch.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Arrow batches of at most BATCH_BYTES (or one row); a smaller limit of its own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow, releasing memory when a task ends: Python workers are used again, and would each keep the most that any of their tasks needed."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2 ... that no column of df has (case ignored, as Spark does)."""
    taken, k, found = {c.lower() for c in df.columns}, 0, name
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal id, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2

"""What several operators share: words, word numbers, tables on shared storage."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)
#: Rows with texts that a Python function takes at a time.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of each table that written() made and that is still referred to.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a session on one machine, as in tests, gets a folder
    under its own warehouse directory; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/pagewright/{uuid.uuid4().hex}"


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to shared storage and read again: its lineage ends here and lost executors don't repeat it. rows: at most so many in an Arrow batch, where these hold texts."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    with small_batches(spark, rows) if rows else nullcontext():
        df.write.parquet(folder)
    released(spark)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing reads any more."""
    for t in tables:
        spark, folder = t.sparkSession, _FOLDERS.pop(t, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS):
    """For a job that runs inside the block: at most so many rows in an Arrow batch, where a task needs its memory for other things."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, before the next step needs the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed() -> None:
    """Gives memory that a Python worker no longer uses back to the system. Workers stay for later tasks, beside which they would hold all that any task before needed."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ROWS rows, none of them empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """64-bit numbers of words. Hashing a word costs less than looking it up among many."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x ^ (x >> SHIFT)
    x = x * MIX_1
    x ^= x >> SHIFT
    x *= MIX_2
    x ^= x >> SHIFT
    return x


def windows(numbers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for every run of size consecutive numbers, by repeated doubling of the run length."""
    if len(numbers) < size:
        return np.empty(0, np.uint64)
    result, start, span, step = None, 0, 1, numbers
    left = size
    while left:
        if left & 1:
            part = step[start:]
            result = part if result is None else mixed(result[: len(part)] * MIX_1 + part[: len(result)])
            start += span
        left >>= 1
        if left:
            step = mixed(step[:-span] * MIX_2 + step[span:])
            span *= 2
    return result[: len(numbers) - size + 1]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts in UTF-8; a null is an empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow for a function of one batch that returns one batch, a table's columns or None; a task's end gives back its memory."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = batch = out = None
        try:
            run = f()
            for batch in batches:
                if batch.num_rows and (out := run(batch)) is not None:
                    yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out
        finally:
            run = batch = out = None
            trimmed()

    return df.mapInArrow(each, schema)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text as the operators read them, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as the cluster has cores, where its files give fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

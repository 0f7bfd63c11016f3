"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of rows whose document id is null: they sort after every other document.
NULL_ID = 2**63 - 1


def doc_key(column: str = "doc_id") -> Column:
    """The document id as a long that is never null; null ids share the largest value."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


#: Bytes of an Arrow batch at most: a worker holds several copies of one.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by their bytes, as ten thousand long texts in one batch would fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; make one of our own only in local mode, where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master.startswith("local[") or context.master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenlog-checkpoint-"))


def release(spark: SparkSession, rounds: int = 2) -> None:
    """Let Spark's cleaner drop shuffles and broadcasts that nothing refers to any more, and checkpoint files too where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.

    The cleaner follows the driver's garbage collector, which a driver with little to do would not run for half an hour. The shuffles
    of what has just ended go with the second collection only; after one they stay through the next step.
    """
    for n in range(rounds):
        if n:
            time.sleep(0.1)  # for the cleaner
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def lean_executors(spark: SparkSession, once: bool = False) -> None:
    """Let the executors' JVMs collect their garbage and give the free heap back to the system, for the Python workers of what follows.

    A JVM keeps the heap that a stage took, and shrinks it in a full collection only. A task for each core: Spark deals them
    to all executors that are free, though nothing makes sure of that; results don't depend on it. once: a task for each executor only.
    """
    context = spark.sparkContext
    tasks = max(1, context._jsc.sc().getExecutorMemoryStatus().size() - 1) if once else context.defaultParallelism  # the driver is in that map too
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def cut(df: DataFrame, in_loop: bool = False) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor loses nothing, and drop what led to it.

    A checkpoint keeps the optimiser's size estimate of the plan that it replaces, and an estimate of a join is the product of
    its sides: in a loop it gets twice the digits in each round, until the driver's heap is full. in_loop drops the estimate.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    out = df.checkpoint(eager=True)
    if in_loop:
        jdf = out._jdf
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)
    del df  # else its shuffles stay until the next release
    release(spark, 1 if in_loop else 2)
    return out


#: Rows of a few longs that one task takes.
TASK_ROWS = 100_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as its rows need, where it has more: loops over few rows then need few tasks, or no exchange at all."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Arrays up to this size come from the C heap, which keeps up to KEPT_BYTES of free memory at its top while a task runs.
HEAP_BYTES, KEPT_BYTES = 8 << 20, 32 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # mallopt's names in glibc


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, if it is glibc."""
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim") else None


#: What a Python worker keeps from one task of an operator to its next one; it goes as soon as the worker gets another task.
KEPT: dict = {}
#: Files that a worker's task has mapped, by path; a mapped file keeps its disk, though it is deleted, so they go at the task's end.
MAPPED: dict = {}


@contextmanager
def lean_heap(keeps: bool = False) -> Iterator[None]:
    """In a Python worker: numpy's arrays reuse memory while a task runs, and what is free goes back to the system at its end.

    By default the C heap maps each array of half a megabyte anew, so that its pages are made and cleared again and again, which
    costs several times what is computed in it; and a worker that waits for its next task keeps what the last one took.
    keeps: the task uses KEPT.
    """
    if not keeps:
        KEPT.clear()
    libc = _libc()
    if libc:
        libc.mallopt(_MMAP_THRESHOLD, HEAP_BYTES)
        libc.mallopt(_TRIM_THRESHOLD, KEPT_BYTES)
    try:
        yield
    finally:
        MAPPED.clear()
        pa.default_memory_pool().release_unused()
        if libc:
            libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each piece has about limit bytes, one row at least; for a task's input, once."""
    with lean_heap(keeps):
        for batch in batches:
            sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
            start, total = 0, 0
            for row, size in enumerate(sizes):
                size = size or 0
                if row > start and total + size > limit:
                    yield batch.slice(start, row - start)
                    start, total = row, 0
                total += size
            if start < batch.num_rows:
                yield batch.slice(start)

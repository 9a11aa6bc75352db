"""Shared helpers: staged tables in the cluster's shared folder, table reading."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the text contracts define it: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, from ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests) a temporary folder
    is set once, so that later calls of the session agree on it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lettermill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that survive any executor, and computes an
    expensive input once when several later steps read it.  Nothing reads the
    shuffle files of the write afterwards, so Spark is told to drop them.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_: Column, text: Column) -> Column:
    """A 64-bit key of an id and its text, nulls included: verdicts on it leave other texts of the same id alone."""
    return F.xxhash64(id_.isNull(), id_, text.isNull(), text)


def small_batches(spark: SparkSession, rows: int = 256) -> SparkSession:
    """Hold at most ``rows`` rows in one Arrow batch, so that long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


BATCH_BYTES = 4 << 20


def slices(batches, most_bytes: int = BATCH_BYTES):
    """The batches, cut by rows into pieces of about ``most_bytes``; a row is never cut."""
    for batch in batches:
        step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        if batch.num_rows <= step:
            yield batch
        else:
            yield from (batch.slice(low, step) for low in range(0, batch.num_rows, step))


def release() -> None:
    """Give the memory that a task's Python side has freed back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def bounded(run, most_bytes: int = BATCH_BYTES):
    """``run`` for mapInArrow over batches bounded by bytes, that leaves no freed memory with the worker."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(slices(batches, most_bytes))
        finally:
            release()

    return task


def small(staged: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A staged table of narrow rows, to be broadcast if its counted rows allow; else it is joined by a shuffle."""
    return F.broadcast(staged) if staged.count() <= most_rows else staged

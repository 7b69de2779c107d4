"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemill

#: Executors need no installed copy of the package: functions travel with the task.
cloudpickle.register_pickle_by_value(tidemill)

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(WORD.encode())
WORD_TEXT = re.compile(WORD)
#: Lower-cases A-Z only, byte by byte.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only in local mode where none is named (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
    return context.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that any executor can read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: For jobs whose result is written: their shuffle files go when the job has ended, and
#: Python gets whole texts in small batches.
_JOB = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def job_settings(spark: SparkSession) -> Iterator[None]:
    """The session's settings with those of ``_JOB``, put back at the end."""
    before = {k: spark.conf.get(k, None) for k in _JOB}
    for k, v in _JOB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back, for results used more than once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with job_settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(column: str | Column = "doc_id") -> Column:
    """0..3 by the CRC-32 of the id as text; 2 is the held-out fold."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % 4


def utf8(column: pa.Array) -> list[bytes | None]:
    """Values of a string column as bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def trim() -> None:
    """Give a worker's freed memory back to the system, so that the next stage does not add to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A map over record batches that trims its worker when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over the tasks that reuse it."""
    return sys.modules.setdefault("_tidemill_worker_cache", types.ModuleType("_tidemill_worker_cache")).__dict__


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, changed where the table has a column of the same name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

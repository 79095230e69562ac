"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskshift.session import checkpoint_dir

#: Regular expression of one word; the same bytes that ``bytes.split()`` keeps.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: In writes shuffle files go when their query ends, and Arrow batches of long rows stay small on both sides.
_CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
_IN_WRITES = {_CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_lock = threading.Lock()
_writers: list[dict[str, str]] = []
# workers give freed batches back to the system
pa.set_memory_pool(pa.system_memory_pool())
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def write_settings(spark: SparkSession) -> Iterator[None]:
    """While any write runs in here its settings hold; after the last one the session's own are back."""
    with _lock:
        if not _writers:
            _writers.append({k: spark.conf.get(k) for k in _IN_WRITES})
            for k, v in _IN_WRITES.items():
                spark.conf.set(k, v)
        _writers.append({})
    try:
        yield
    finally:
        with _lock:
            _writers.pop()
            if len(_writers) == 1:
                for k, v in _writers.pop().items():
                    spark.conf.set(k, v)


def written(df: DataFrame, tag: str) -> str:
    """Path of ``df``, written to the cluster's shared checkpoint folder; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with write_settings(spark):
        df.write.parquet(path)
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared checkpoint folder and read it back.

    Cuts lineage (a lost executor costs only a re-read) and lets several
    consumers share one computation. The shuffle files of the write are
    dropped when it ends, the table when the application ends, or with ``scratch``.
    """
    path = written(df, tag)
    if (tables := _scratch.get()) is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system and path of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes in here are deleted at the end, also after an error."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get():
            delete(spark, path)
        _scratch.reset(token)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


def text_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of whole texts of about ``max_bytes``.

    Yields the run and its ``text`` column as UTF-8 bytes (null: empty), so
    working arrays stay small whatever the batch holds. One text is never cut.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            done = int(upto[start - 1]) if start else 0
            end = min(len(batch), int(np.searchsorted(upto, done + max_bytes)) + 1)
            yield batch.slice(start, end - start), [t or b"" for t in texts.slice(start, end - start).to_pylist()]
            start = end

"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import checkpoint_dir

#: ASCII white space; everything between is a word.
SPACES = b" \t\n\r\x0b\x0c"
#: Rows of a batch that a written job passes to Python.
BATCH_ROWS = 1000
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession):
    """Meanwhile jobs pass rows to Python ``BATCH_ROWS`` at a time: a batch of whole texts
    lies in the executor's memory beside its heap, and in the worker's as well."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name))
    if not 0 < given <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, given)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost
    executor costs nothing that was staged before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): all columns but the text travel in one struct, where
    their names meet no others."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def dropped(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches; at its end the worker, which lives on for
    later tasks, gives unused memory back."""
    def and_release(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_unused()

    return and_release


def release_unused() -> None:
    """Give the worker's unused memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

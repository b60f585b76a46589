"""Small helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.session import durable, scratch_path, ship_package

__all__ = [
    "durable", "each_run", "each_slice", "frugal", "read_table", "scratch_path", "ship_package", "texts_of", "whole_text", "written",
]


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so that no other column can clash or be read."""
    return docs.select(F.col("doc_id"), whole_text().alias("text"), *more)


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """The rows, written once as a table in the shared folder and read again; lineage ends there.

    ``compact``: with a denser encoding of numbers and stronger compression, for large tables.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    if compact:
        writer = writer.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function; when its task ends, memory that it has freed goes back to the system.

    A Python worker waits for the next task, of whatever query, and would keep what the last one needed at most.
    """

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others free at once or not at all
            if trim is not None:
                trim(0)

    return task


def each_slice(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only a few texts at a time are Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def each_run(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Runs of equal ``key`` in batches sorted by it, each as an iterator over its slices.

    Only one batch is held at a time, however long a run is. A run must be read to its end before
    the next one is asked for.
    """
    source = iter(batches)
    waiting: list[pa.RecordBatch] = []

    def next_batch() -> pa.RecordBatch | None:
        while not waiting:
            batch = next(source, None)
            if batch is None:
                return None
            if batch.num_rows:
                waiting.append(batch)
        return waiting.pop()

    def slices(value: object) -> Iterator[pa.RecordBatch]:
        while (batch := next_batch()) is not None:
            column = batch.column(key)
            if column[0].as_py() != value:
                waiting.append(batch)
                return
            if column[batch.num_rows - 1].as_py() == value:
                yield batch
                continue
            low, high = 0, batch.num_rows - 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if column[middle].as_py() == value else (low, middle)
            waiting.append(batch.slice(high))
            yield batch.slice(0, high)
            return

    while (batch := next_batch()) is not None:
        value = batch.column(key)[0].as_py()
        waiting.append(batch)
        yield value, slices(value)

"""Block stores of gallery rows, and tasks that stream them past the queries they hold.

A store is a Parquet folder sorted by id, one file per block, with an index of one small row per
block. Queries are hashed into partitions that fit a worker's memory; a task holds its queries, reads
one bounded batch of gallery rows after the other from the shared storage and keeps a running
result per query. Only queries are shuffled. Where there are fewer query partitions than cores, the
blocks are dealt out in stripes as well, and Spark merges one partial result per query and stripe.

Positions in the id order are whole numbers, so ties between ids are decided without comparing text.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.session import scratch_path, ship_package

#: Bytes of a block's file before compression, about.
BLOCK_BYTES = 64 << 20
#: Blocks at most, so that the index stays small; beyond, blocks get larger. Files are read in batches.
MOST_BLOCKS = 1 << 16
#: Bytes of queries that one task holds.
HOLD_BYTES = 512 << 20
#: The same for the plans that :func:`plan_for` makes: workers hold copies and results beside the queries.
PLAN_HOLD_BYTES = 128 << 20
#: Bytes of gallery rows in one batch.
BATCH_BYTES = 32 << 20
#: Values of gallery rows that one task compares with its queries; larger scans become more tasks, not longer ones.
TASK_WORK = 1 << 38


@dataclass(frozen=True)
class Block:
    """One file: its rows, the rows of all earlier blocks, and its first and last id."""

    path: str
    rows: int
    before: int
    first_id: str
    last_id: str


@dataclass(frozen=True)
class BlockStore:
    """The index of a store, blocks in id order."""

    blocks: tuple[Block, ...]

    @property
    def rows(self) -> int:
        return sum(b.rows for b in self.blocks)

    def stripe(self, number: int, stripes: int) -> tuple[Block, ...]:
        return self.blocks[number::stripes]


def write_blocks(rows: DataFrame, path: str, count: int, row_bytes: int, block_bytes: int = BLOCK_BYTES) -> BlockStore:
    """Write ``rows`` (unique ``id`` and what goes with it) as a store below ``path`` and return its index."""
    blocks = min(max(1, math.ceil(count * row_bytes / block_bytes)), MOST_BLOCKS)
    rows.repartitionByRange(blocks, "id").sortWithinPartitions("id").write.mode("errorifexists").parquet(path)
    return open_blocks(rows.sparkSession, path)


def open_blocks(spark: SparkSession, path: str) -> BlockStore:
    """The index of a store that was written earlier; reads the ids only, one row per file comes back."""
    ids = spark.read.parquet(path).select("id", F.col("_metadata.file_path").alias("path"))
    found = ids.groupBy("path").agg(F.count("id").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).collect()
    blocks, before = [], 0
    for row in sorted(found, key=lambda r: r["first"]):
        if blocks and row["first"] <= blocks[-1].last_id:
            raise ValueError(f"{path} is not a block store: ids of {row['path']} lie in another block, or occur twice")
        blocks.append(Block(row["path"], row["n"], before, row["first"], row["last"]))
        before += row["n"]
    return BlockStore(tuple(blocks))


def scratch_store(rows: DataFrame, count: int, row_bytes: int) -> BlockStore:
    """A store of ``rows`` in the shared scratch folder."""
    return write_blocks(rows, scratch_path(rows.sparkSession, "blocks"), count, row_bytes)


def read_batches(blocks: Sequence[Block], row_bytes: int, columns: Sequence[str] | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Inside a task: ``(position of the first row, batch)`` of the blocks, in id order."""
    import pyarrow.fs
    import pyarrow.parquet

    for block in blocks:
        system, where = pyarrow.fs.FileSystem.from_uri(block.path)
        with system.open_input_file(where) as source:
            at = block.before
            step = max(1, BATCH_BYTES // row_bytes)
            for batch in pyarrow.parquet.ParquetFile(source).iter_batches(step, columns=columns):
                yield at, batch
                at += batch.num_rows


@dataclass(frozen=True)
class StreamPlan:
    """Query partitions and stripes of a scan of the whole gallery by all queries."""

    query_blocks: int
    stripes: int

    @property
    def tasks(self) -> int:
        return self.query_blocks * self.stripes

    def shuffled_bytes(self, query_rows: int, query_bytes: int) -> int:
        return query_rows * query_bytes * self.stripes

    def read_bytes(self, gallery_rows: int, gallery_bytes: int) -> int:
        return gallery_rows * gallery_bytes * self.query_blocks


def plan_stream(
    query_rows: int,
    gallery_rows: int,
    query_bytes: int,
    gallery_bytes: int,
    gallery_blocks: int,
    parallelism: int,
    hold_bytes: int = HOLD_BYTES,
    min_pairs: int = 1 << 20,
    task_pairs: int | None = None,
) -> StreamPlan:
    """As few bytes moved as possible, with queries that fit ``hold_bytes`` and a task for every core.

    The number of tasks is that of the query partitions, or of the cores where those are more; it grows with the gallery
    only where a task would compare more than ``task_pairs``. More memory per task means fewer passes over the gallery.
    """
    least = max(1, math.ceil(query_rows * query_bytes / hold_bytes))
    useful = max(1, min(parallelism, query_rows * gallery_rows // min_pairs))
    if task_pairs is not None:
        # A partition holds one query at least.
        useful = max(useful, min(math.ceil(query_rows * gallery_rows / task_pairs), query_rows * max(1, gallery_blocks)))

    def plan(stripes: int) -> StreamPlan:
        return StreamPlan(max(least, math.ceil(useful / stripes)), stripes)

    def moved(p: StreamPlan) -> int:
        return p.shuffled_bytes(query_rows, query_bytes) + p.read_bytes(gallery_rows, gallery_bytes)

    return min((plan(s) for s in range(1, max(1, min(gallery_blocks, useful)) + 1)), key=moved)


def plan_for(queries: DataFrame, store: BlockStore, query_rows: int, query_bytes: int, gallery_bytes: int, **options) -> StreamPlan:
    """A plan of tasks that end in bounded time, however large both sides are; see ``TASK_WORK``."""
    options = {"hold_bytes": PLAN_HOLD_BYTES, "task_pairs": max(1, TASK_WORK * 8 // gallery_bytes), **options}
    parallelism = queries.sparkSession.sparkContext.defaultParallelism
    return plan_stream(query_rows, store.rows, query_bytes, gallery_bytes, len(store.blocks), parallelism, **options)


Kernel = Callable[[pa.Table, tuple[Block, ...]], Iterator[pa.RecordBatch]]


def stream(queries: DataFrame, key: Sequence[str], store: BlockStore, plan: StreamPlan, kernel: Kernel, schema: str) -> DataFrame:
    """Run ``kernel(held queries, blocks of one stripe)`` for every query partition and stripe.

    A kernel reads the blocks itself, with :func:`read_batches`, all of them or those it needs. Tasks depend on
    their queries and on files that stay, so a lost one is run again.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(plan.query_blocks)).cast("int") * F.lit(plan.stripes)
    stripe = F.explode(F.sequence(F.lit(0), F.lit(plan.stripes - 1)))
    placed = queries.withColumn("_stripe", stripe).withColumn("_place", part + F.col("_stripe"))
    stripes = plan.stripes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            del held
            yield from kernel(table, store.stripe(table.column("_stripe")[0].as_py(), stripes))

    ship_package(queries.sparkSession)
    return placed.repartitionById(plan.tasks, F.col("_place")).mapInArrow(run, schema)


def locate(ids: Sequence[str], blocks: Sequence[Block]) -> np.ndarray:
    """The place in ``blocks`` of the block that would hold each id: the last one that begins at or before it, or -1."""
    first = [b.first_id for b in blocks]
    return np.fromiter((bisect_right(first, i) - 1 for i in ids), dtype=np.int64, count=len(ids))

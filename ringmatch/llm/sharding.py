"""Contiguous shards of near equal bytes, by prefix sums over the whole table.

Rows are put into one global order by range partitions. Each partition's rows and bytes are added up, the
totals of all earlier partitions are a partition's offset, and a running sum inside each partition
completes the global prefix. A shard is the stretch between two equal targets of that prefix, so only
totals (one row per partition) ever meet in one place, and a row's text need not move to be placed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringmatch.llm.common import durable, scratch_path, ship_package, whole_text

SHARDS = 40
#: Bytes that a row takes in a shard besides its text.
ROW_BYTES = 16
#: Rows of a range partition on average.
PART_ROWS = 1 << 14
#: Partitions at most, so that the table of offsets stays below some megabytes at any row count.
MOST_PARTS = 1 << 16


def sized(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, digest, copy`` of every row, and with ``carry`` the row itself as ``doc``.

    ``copy`` tells equal rows apart, so that any number of them can be spread over partitions.
    """
    data = whole_text().cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(data).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("digest"),
        F.monotonically_increasing_id().alias("copy"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []),
    )


def _running(shards: int, columns: Sequence[str]):
    """Batches of one partition in order, with its offset in every row, become shards and row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = byte = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            total = batch.column("total")[0].as_py()
            if row is None:
                row, byte = batch.column("first_row")[0].as_py(), batch.column("first_byte")[0].as_py()
            before = byte + np.cumsum(size) - size
            # The middle of a row decides: a row at a cut goes where most of it lies. Python's whole numbers
            # hold the product at any size.
            middle = (2 * before + size).astype(object) if total > 1 << 55 else 2 * before + size
            shard = np.minimum(middle * shards // (2 * total), shards - 1).astype(np.int32)
            rows = row + np.arange(batch.num_rows, dtype=np.int64)
            row, byte = row + batch.num_rows, byte + int(size.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(shard), pa.array(rows)], [*columns, "shard", "number"]
            )

    return run


def place(docs: DataFrame, shards: int = SHARDS, carry: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row, and with ``carry`` the row itself as ``doc``.

    The order is by ``doc_id`` (null first), then by a digest of the text. Rows equal in both are
    copies and may change places. ``slot`` counts a shard's rows from 0 without a gap. Shards are contiguous in
    that order; a shard's bytes differ from an equal share by less than the largest row. A row larger
    than a share leaves shards without rows.
    """
    ship_package(docs.sparkSession)
    rows = durable(sized(docs, carry))
    parts = min(max(1, -(-rows.count() // part_rows)), MOST_PARTS)
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "digest", "copy")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = durable(dealt.withColumn("part", F.spark_partition_id()).drop("digest", "copy"))
    totals = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        F.col("part").alias("of"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first_row"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("first_byte"),
        F.sum("bytes").over(whole).alias("total"),
    )
    # At most MOST_PARTS rows of four numbers. A broadcast join keeps the partitions of the durable table,
    # and with them its order.
    joined = dealt.join(F.broadcast(offsets), F.col("part") == F.col("of"))
    columns = ["doc_id", "size", "text_crc32", *(["doc"] if carry else [])]
    schema = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in columns) + ", shard int, number long"
    numbered = durable(joined.mapInArrow(_running(shards, columns), schema))
    first = numbered.groupBy(F.col("shard").alias("of")).agg(F.min("number").alias("first"))  # one row per shard
    placed = numbered.join(F.broadcast(first), F.col("shard") == F.col("of"))
    return placed.select(*columns, "shard", (F.col("number") - F.col("first")).alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by the law ``bytes``.

    A null text counts as no bytes (its row takes 16), a null id comes first, repeated rows get places
    of their own next to each other, an empty table gives no rows, other columns are ignored.
    ``grown_shard`` is null: only a law by key says where a row goes when a shard is added.
    """
    placed = place(docs, shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS) -> str:
    """Write whole documents as one folder per shard (``shard=<n>``), each in the order of ``slot``.

    Every text moves once, into its range partition; a partition holds rows of few shards, so each
    shard is a handful of files. Returns the path. All columns of the documents are kept; where they have a
    ``shard`` or ``slot`` of their own, the operator's gets underscores in front.
    """
    path = path or scratch_path(docs.sparkSession, "shards")
    names = {"shard": "shard", "slot": "slot"}
    for own in names:
        while names[own].lower() in (c.lower() for c in docs.columns):
            names[own] = f"_{names[own]}"
    placed = place(docs, shards, carry=True)
    rows = placed.select("doc.*", F.col("slot").alias(names["slot"]), F.col("shard").alias(names["shard"]))
    rows.write.partitionBy(names["shard"]).parquet(path)
    return path

"""Global positions and running values without a single-partition window.

Rows are split into blocks that follow the sort order; only one row per block meets in the small
prefix window. A hot group is therefore spread over as many blocks as it has rows for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringmatch.functions.seeds import stable_seed
from ringmatch.session import durable


def _before(partition_cols: Sequence[str]):
    return W.partitionBy(*(partition_cols or [F.lit(0)])).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)


def blocked_row_number(
    df: DataFrame,
    order_cols: Sequence[Column | str],
    block: Column,
    partition_cols: Sequence[str] = (),
    name: str = "row_number",
) -> DataFrame:
    """1-based row number; ``block`` must not decrease along the order."""
    keys = [*partition_cols, "_block"]
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(*keys, F.coalesce(F.sum("_rows").over(_before(partition_cols)), F.lit(0)).alias("_offset"))
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order_cols))
    return (
        blocked.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_block")
    )


def blocked_previous_max(
    df: DataFrame,
    value: str,
    order_cols: Sequence[Column | str],
    block: Column,
    partition_cols: Sequence[str],
    name: str = "previous_max",
) -> DataFrame:
    """Maximum of all earlier rows of the group (null for the first)."""
    keys = [*partition_cols, "_block"]
    blocked = df.withColumn("_block", block)
    peaks = blocked.groupBy(*keys).agg(F.max(value).alias("_peak"))
    earlier = peaks.select(*keys, F.max("_peak").over(_before(partition_cols)).alias("_earlier"))
    inside = F.max(value).over(W.partitionBy(*keys).orderBy(*order_cols).rowsBetween(W.unboundedPreceding, -1))
    return (
        blocked.withColumn("_inside", inside)
        .join(earlier, keys)
        .withColumn(name, F.greatest("_inside", "_earlier"))
        .drop("_inside", "_earlier", "_block")
    )


def shuffled_index(
    df: DataFrame,
    seed_items: Sequence[object],
    id_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    name: str = "shuffle_index",
    rows: int | None = None,
) -> DataFrame:
    """0-based position in the keyed random order of the rows.

    The order is by seed, then by id. The seed is uniform, so its leading bits give even blocks, about as many as
    a block has rows. ``rows``: how many rows there are, about; they are counted where the caller does not know.
    """
    rows = df.count() if rows is None else rows
    block_bits = min(32, max(4, (max(rows, 1).bit_length() + 1) // 2))
    keyed = df.withColumn("_seed", stable_seed(*seed_items, *[F.col(c) for c in id_cols]))
    numbered = blocked_row_number(
        keyed,
        ["_seed", *id_cols],
        F.shiftright("_seed", 32 - block_bits),
        partition_cols,
        name,
    )
    return numbered.withColumn(name, F.col(name) - 1).drop("_seed")


def lexical_rank(df: DataFrame, column: str, name: str = "lexical_rank", block_rows: int = 1 << 16) -> DataFrame:
    """0-based position of unique ids in code-point order.

    Blocks are the range partitions of the engine, as many as the row count asks for. They are written
    once, so that the number of a row's partition cannot change under it.
    """
    blocks = max(1, -(-df.count() // block_rows))
    placed = durable(df.repartitionByRange(blocks, column).withColumn("_range", F.spark_partition_id()))
    ranked = blocked_row_number(placed, [column], F.col("_range"), name=name)
    return ranked.withColumn(name, F.col(name) - 1).drop("_range")

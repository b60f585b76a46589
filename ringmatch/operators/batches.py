"""Balanced mixed-FoV batch planning without location reuse.

Plan rows are ``kind, batch, fov_deg, offset, location``; later steps add ``position`` and ``step``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.functions.crops import int_div
from ringmatch.functions.seeds import stable_seed
from ringmatch.operators.index import shuffled_index


def _pick(values: Sequence[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), (index + 1).cast("int"))


def hard_anchors(
    locations: DataFrame, hard_batches: int, fovs: Sequence[int], seed_items: Sequence[object], rows: int | None = None
) -> DataFrame:
    """First ``hard_batches x FoVs`` shuffled locations, dealt by batch, then FoV (offset 0)."""
    count = len(fovs)
    index = F.col("shuffle_index")
    order = shuffled_index(locations.select("location"), [*seed_items, "hard_anchors"], ["location"], rows=rows)
    return order.filter(index < hard_batches * count).select(
        F.lit("hard").alias("kind"),
        int_div(index, F.lit(count).cast("bigint")).alias("batch"),
        _pick(fovs, index % count).alias("fov_deg"),
        F.lit(0).cast("bigint").alias("offset"),
        "location",
    )


def normal_fill(
    locations: DataFrame,
    used: DataFrame | None,
    normal_batches: int,
    per_fov: int,
    fovs: Sequence[int],
    seed_items: Sequence[object],
    rows: int | None = None,
) -> DataFrame:
    """Shuffle the unused locations and cut them into FoV groups batch after batch; the rest is left out."""
    free = locations.select("location")
    if used is not None:
        free = free.join(used.select("location"), "location", "left_anti")
    count = len(fovs)
    index = F.col("shuffle_index")
    order = shuffled_index(free, [*seed_items, "normal_locations"], ["location"], rows=rows)
    group = int_div(index, F.lit(per_fov).cast("bigint"))
    return order.filter(index < normal_batches * per_fov * count).select(
        F.lit("normal").alias("kind"),
        int_div(group, F.lit(count).cast("bigint")).alias("batch"),
        _pick(fovs, group % count).alias("fov_deg"),
        (index % per_fov).alias("offset"),
        "location",
    )


def fov_cycle_rank(fovs: Sequence[int], seed_items: Sequence[object]) -> Column:
    """0-based place of a row's FoV in the shuffled cycle of its batch."""

    def key(fov: Column) -> Column:
        return stable_seed(*seed_items, F.col("kind"), F.col("batch"), "fov_cycle", fov)

    own = F.struct(key(F.col("fov_deg")), F.col("fov_deg"))
    ahead = [
        F.when(F.struct(key(F.lit(int(f))), F.lit(int(f)).cast("bigint")) < own, 1).otherwise(0) for f in fovs
    ]
    total = ahead[0]
    for term in ahead[1:]:
        total = total + term
    return total.cast("bigint")


def interleave(rows: DataFrame, fovs: Sequence[int], seed_items: Sequence[object]) -> DataFrame:
    """Positions that alternate FoVs, so that every contiguous shard of a batch is balanced."""
    place = F.col("offset") * len(fovs) + fov_cycle_rank(fovs, seed_items)
    return rows.withColumn("position", place)


def batch_schedule(spark: SparkSession, normal_batches: int, hard_batches: int, seed_items: Sequence[object]) -> DataFrame:
    """Shuffled order of all batches of an epoch: ``kind, batch, step``."""
    number = F.col("id")
    batches = spark.range(normal_batches + hard_batches).select(
        F.when(number < normal_batches, "normal").otherwise("hard").alias("kind"),
        F.when(number < normal_batches, number).otherwise(number - normal_batches).alias("batch"),
    )
    return shuffled_index(batches, [*seed_items, "batch_schedule"], ["kind", "batch"], name="step", rows=normal_batches + hard_batches)


def shard(position: Column, per_shard: int) -> Column:
    return int_div(position, F.lit(int(per_shard)).cast("bigint"))


def shard_bounds(rows: int, shards: int) -> list[tuple[int, int]]:
    """Contiguous half-open ranges that cover ``rows`` once."""
    return [(rows * r // shards, rows * (r + 1) // shards) for r in range(shards)]


def shard_of_index(index: Column, rows: int, shards: int) -> Column:
    """Shard whose range ``[n*r//w, n*(r+1)//w)`` holds the index."""
    w, n = F.lit(int(shards)).cast("bigint"), F.lit(int(rows)).cast("bigint")
    return int_div((index + 1) * w - 1, n)


def sample_requests(plan: DataFrame) -> DataFrame:
    """Sample requests: hard rows use the orientation their pool was mined with."""
    return plan.withColumn("orientation_mode", F.when(F.col("kind") == "hard", "hard_train").otherwise("train"))


def fov_buckets(plan: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Positions and locations of each FoV group of a batch, in position order.

    A group holds one batch's quota, so the lists are short.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", "location")))
    grouped = plan.groupBy(*by, "fov_deg").agg(listed.alias("rows"))
    return grouped.select(*by, "fov_deg", F.col("rows.position").alias("positions"), F.col("rows.location").alias("locations"))


def unknown_fovs(plan: DataFrame, supported: Sequence[int]) -> DataFrame:
    return plan.filter(~F.col("fov_deg").isin([int(f) for f in supported]))


def position_gaps(plan: DataFrame, batch_rows: int, by: Sequence[str] = ("step",)) -> DataFrame:
    """Batches whose positions are not exactly 0..batch_rows-1."""
    audit = plan.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("position").alias("distinct_positions"),
        F.min("position").alias("first"),
        F.max("position").alias("last"),
    )
    good = (
        (F.col("rows") == batch_rows)
        & (F.col("distinct_positions") == batch_rows)
        & (F.col("first") == 0)
        & (F.col("last") == batch_rows - 1)
    )
    return audit.filter(~good)


def quota_counts(plan: DataFrame, fovs: Sequence[int], shards: int, batch_rows: int) -> DataFrame:
    """Rows per FoV in every shard of every batch."""
    sharded = plan.withColumn("shard", shard(F.col("position"), batch_rows // shards))
    return sharded.groupBy("step", "shard").agg(
        *[F.count_if(F.col("fov_deg") == int(f)).alias(f"fov_{int(f)}") for f in fovs]
    )


def plan_audit(plan: DataFrame, fovs: Sequence[int], per_fov: int, shards: int = 1) -> DataFrame:
    """One row: steps, rows, distinct locations, and batches or shards off their quota."""
    batch_rows = per_fov * len(fovs)
    off = F.lit(False)
    for f in fovs:
        off = off | (F.col(f"fov_{int(f)}") != per_fov // shards)
    shard_audit = quota_counts(plan, fovs, shards, batch_rows).agg(F.count_if(off).alias("unbalanced_shards"))
    totals = plan.agg(
        F.count_distinct("step").alias("steps"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("location").alias("distinct_locations"),
    )
    both = totals.unionByName(shard_audit, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def plan_faults(plan: DataFrame, fovs: Sequence[int], per_fov: int, shards: int = 1) -> DataFrame:
    """One row with everything that makes a plan unusable, in one job over two aggregates.

    ``steps, rows, distinct_locations, unbalanced_shards`` as :func:`plan_audit`, the rows of unknown FoVs, and the batches
    whose positions are not exactly 0 to the batch size.
    """
    batch_rows = per_fov * len(fovs)
    number = shard(F.col("position"), batch_rows // shards)
    parts = plan.groupBy("step", number.alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("position").alias("places"),
        F.min("position").alias("first"),
        F.max("position").alias("last"),
        F.count_if(~F.col("fov_deg").isin([int(f) for f in fovs])).alias("unknown"),
        *[F.count_if(F.col("fov_deg") == int(f)).alias(f"fov_{int(f)}") for f in fovs],
    )
    off = F.lit(False)
    for f in fovs:
        off = off | (F.col(f"fov_{int(f)}") != per_fov // shards)
    per_step = parts.groupBy("step").agg(
        F.sum("rows").alias("rows"),
        F.sum("places").alias("places"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("unknown").alias("unknown"),
        F.count_if(off).alias("off"),
    )
    whole = (F.col("rows") == batch_rows) & (F.col("places") == batch_rows) & (F.col("first") == 0) & (F.col("last") == batch_rows - 1)
    totals = per_step.agg(
        F.count(F.lit(1)).alias("steps"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("off"), F.lit(0)).alias("unbalanced_shards"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_fovs"),
        F.count_if(~whole).alias("position_gaps"),
    )
    places = plan.groupBy("location").count().agg(F.count(F.lit(1)).alias("distinct_locations"))
    both = totals.unionByName(places, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])

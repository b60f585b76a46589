"""Stage, refresh-epoch and cadence lookups on epochs.

Stages are a handful of closed epoch ranges, so a lookup is an expression over a literal list: no join,
no table of epochs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def stages_at(epoch: Column, stages: Sequence[Mapping]) -> Column:
    """The stages that hold an epoch, as an array of (stage, hard_batch_fraction)."""
    known = []
    for entry in stages:
        inside = epoch.between(int(entry["epoch_start"]), int(entry["epoch_end"]))
        fields = F.struct(
            F.lit(str(entry["name"])).alias("stage"),
            F.lit(float(entry["hard_batch_fraction"])).alias("hard_batch_fraction"),
        )
        known.append(F.when(inside, fields))
    return F.array_compact(F.array(*known))


def with_stage(df: DataFrame, stages: Sequence[Mapping], epoch: str = "epoch") -> DataFrame:
    """Attach the stage of each row's epoch; both fields are null unless ``stage_matches`` is 1."""
    found = df.withColumn("_stages", stages_at(F.col(epoch), stages))
    found = found.withColumn("stage_matches", F.size("_stages").cast("bigint"))
    only = F.when(F.col("stage_matches") == 1, F.get("_stages", F.lit(0)))
    return found.withColumns({n: only[n] for n in ("stage", "hard_batch_fraction")}).drop("_stages")


def latest_before(epoch: Column, refresh: Sequence[int]) -> Column:
    """Newest refresh epoch strictly before ``epoch``; null where there is none."""
    listed = F.array(*[F.lit(int(r)).cast("bigint") for r in refresh])
    return F.array_max(F.filter(listed, lambda r: r < epoch))


def plan_lookup(spark: SparkSession, epoch: int, stages: Sequence[Mapping], refresh: Sequence[int]) -> Row:
    """What a planner needs of one epoch: stage, hard fraction, number of stages that hold it, pool epoch."""
    one = spark.range(1).select(F.lit(int(epoch)).cast("bigint").alias("epoch"))
    return with_stage(one, stages).withColumn("source_epoch", latest_before(F.col("epoch"), refresh)).first()


def validation_due(epoch: Column, interval: int) -> Column:
    return epoch % int(interval) == 0


def refresh_due(epoch: Column, refresh: Sequence[int]) -> Column:
    return epoch.isin([int(r) for r in refresh])

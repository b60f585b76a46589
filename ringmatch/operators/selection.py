"""Best-so-far selection and step-log rollups over the metric log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringmatch.functions.crops import int_div
from ringmatch.operators.index import blocked_previous_max

EPOCH_BLOCK = 1 << 14


def is_number(score: str) -> Column:
    value = F.col(score)
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def mark_new_best(
    scores: DataFrame, score: str, order: str = "epoch", run: str = "run", block: Column | None = None
) -> DataFrame:
    """Flag records that strictly beat everything earlier in their run.

    A run's records are spread over blocks of consecutive epochs, so one long run is many tasks. A null
    or NaN score is never a best and hides none.
    """
    block = int_div(F.col(order).cast("bigint"), F.lit(EPOCH_BLOCK).cast("bigint")) if block is None else block
    usable = scores.withColumn("_usable", F.when(is_number(score), F.col(score)))
    marked = blocked_previous_max(usable, "_usable", [order], block, [run], name="previous_best")
    better = F.col("previous_best").isNull() | (F.col("_usable") > F.col("previous_best"))
    return marked.withColumn("new_best", F.col("_usable").isNotNull() & better).drop("_usable")


def best_records(scores: DataFrame, score: str, order: str = "epoch", run: str = "run") -> DataFrame:
    """Best score per run with the earliest epoch that reached it; null and NaN scores take no part."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("e")))
    return scores.filter(is_number(score)).groupBy(run).agg(top.alias("_top")).select(
        run, F.col("_top.s").alias(f"best_{score}"), (-F.col("_top.e")).alias(f"best_{order}")
    )


def step_rollup(log: DataFrame, by: Sequence[str] = ("run", "epoch", "record_type")) -> DataFrame:
    """Loss and accuracy averages, the latest loss and the batch mix per group."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.avg("loss").alias("mean_loss"),
        F.max_by("loss", "step").alias("latest_loss"),
        F.avg("joint_in_batch_accuracy").alias("mean_accuracy"),
        F.count_if(F.col("batch_kind") == "hard").alias("hard_batches"),
        F.count_if(F.col("batch_kind") == "normal").alias("normal_batches"),
    )


def fov_totals(log: DataFrame, by: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """Rows per FoV summed over the step records."""
    entries = log.filter("record_type = 'train_step'").select(*by, F.explode("fov_counts").alias("fov", "rows"))
    return entries.groupBy(*by, F.col("fov").cast("bigint").alias("fov_deg")).agg(F.sum("rows").alias("rows"))

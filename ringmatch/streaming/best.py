"""Incremental best-so-far over the appended metric log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.operators.selection import is_number
from ringmatch.streaming.snapshot import Snapshot


def start_best_stream(log: DataFrame, score: str, state_path: str, checkpoint: str, order: str = "epoch", run: str = "run"):
    """Keep the best record of every run up to date while the log grows.

    The state store and the snapshot below ``state_path`` hold one row per run. A batch that is run again replaces
    what it wrote before. The order in which records of a run arrive does not change the result; null and
    NaN scores take no part.
    """
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("e")))
    best = log.filter(is_number(score)).groupBy(run).agg(top.alias("_top"))
    names = (f"best_{score}", f"best_{order}")

    def newest(rows: DataFrame) -> DataFrame:
        again = F.max(F.struct(F.col(names[0]).alias("s"), (-F.col(names[1])).alias("e"))).alias("_top")
        return rows.groupBy(run).agg(again).select(run, F.col("_top.s").alias(names[0]), (-F.col("_top.e")).alias(names[1]))

    def publish(changed: DataFrame, batch_id: int) -> None:
        rows = changed.select(run, F.col("_top.s").alias(names[0]), (-F.col("_top.e")).alias(names[1]))
        Snapshot(changed.sparkSession, state_path).merge(rows, batch_id, newest)

    return (
        best.writeStream.outputMode("update")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_best(spark: SparkSession, state_path: str, score: str, order: str = "epoch", run: str = "run") -> DataFrame:
    """Current best record per run from everything published so far."""
    return Snapshot(spark, state_path).read().select(run, f"best_{score}", f"best_{order}")

"""Macro recall of validations from a growing log, once every field of view has arrived.

A validation's records may arrive one FoV at a time, in any order and in any micro-batch. Keyed state per (run,
epoch) holds what has arrived; when the last FoV is there, one row with the macro recall is emitted. A FoV
that arrives twice, or a value that is not finite, spoils the validation: if its row was emitted it is taken back, so the
snapshot always equals the batch result over the same log.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringmatch.operators.selection import best_records
from ringmatch.session import ship_package
from ringmatch.sources.logs import validation_recalls
from ringmatch.streaming.snapshot import Snapshot

EMITTED = "run string, epoch long, macro_recall double, complete boolean"
STATE = "fovs array<long>, recalls array<double>, spoilt boolean, emitted boolean"


def _collect(fovs: Sequence[int]):
    wanted = [int(f) for f in fovs]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, spoilt, emitted = {}, False, False
        if state.exists:
            names, values, spoilt, emitted = state.get
            held = dict(zip(names, values))
        for frame in frames:
            for fov, value in zip(frame["fov_deg"], frame["recall_at_1"]):
                if pd.isna(fov) or int(fov) not in wanted:
                    continue
                spoilt |= int(fov) in held or value is None or not math.isfinite(value)
                held[int(fov)] = 0.0 if value is None else float(value)
        whole = len(held) == len(wanted) and not spoilt
        if whole != emitted:
            total = held[wanted[0]] if whole else None
            for fov in wanted[1:] if whole else ():
                total += held[fov]
            macro = total / len(wanted) if whole else None
            yield pd.DataFrame({"run": [key[0]], "epoch": [key[1]], "macro_recall": [macro], "complete": [whole]}).astype({"macro_recall": "float64"})
        state.update((list(held), list(held.values()), spoilt, whole))

    return step


def start_validation_stream(log: DataFrame, fovs: Sequence[int], state_path: str, checkpoint: str):
    """Keep a snapshot of all complete validations (``run, epoch, macro_recall``) up to date while the log grows.

    ``log`` is a stream of metric records. The snapshot holds one row per validation and is compacted with
    every batch; a batch that runs again after a failure writes the same version again.
    """
    ship_package(log.sparkSession)
    rows = validation_recalls(log)
    changed = rows.groupBy("run", "epoch").applyInPandasWithState(
        _collect(fovs), EMITTED, STATE, "update", GroupStateTimeout.NoTimeout
    )

    def latest(merged: DataFrame) -> DataFrame:
        newest = W.partitionBy("run", "epoch").orderBy(F.desc("batch"))
        ranked = merged.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
        return ranked.drop("_n")

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        Snapshot(batch.sparkSession, state_path).merge(rows, batch_id, latest)

    return (
        changed.writeStream.outputMode("update")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_validations(spark: SparkSession, state_path: str) -> DataFrame:
    """``run, epoch, macro_recall`` of every validation that is complete by now."""
    return Snapshot(spark, state_path).read().filter("complete").select("run", "epoch", "macro_recall")


def read_best_validations(spark: SparkSession, state_path: str) -> DataFrame:
    """The best validation of every run by now; the earliest epoch wins a tie."""
    return best_records(read_validations(spark, state_path), "macro_recall")

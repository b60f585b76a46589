"""Best epoch per run from the metric log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ringmatch.operators.audits import require_empty
from ringmatch.operators.recall import macro_recall
from ringmatch.operators.selection import best_records
from ringmatch.sources.logs import read_log, validation_recalls


def validations(spark: SparkSession, log_path: str, fovs: Sequence[int]) -> DataFrame:
    """``run, epoch, macro_recall, fov_rows, complete`` of every validation in the log."""
    return macro_recall(validation_recalls(read_log(spark, log_path)), fovs, ["run", "epoch"])


def incomplete_validations(spark: SparkSession, log_path: str, fovs: Sequence[int]) -> DataFrame:
    """Validations that lack a FoV or hold a value that is not finite."""
    return validations(spark, log_path, fovs).filter("NOT complete").select("run", "epoch", "fov_rows")


def select_best(spark: SparkSession, log_path: str, fovs: Sequence[int], skip_incomplete: bool = False) -> DataFrame:
    """Highest macro R@1 per run; the earliest epoch wins a tie.

    An incomplete validation is refused, unless the caller asks to leave those out.
    """
    if not skip_incomplete:
        require_empty(incomplete_validations(spark, log_path, fovs), "Validations are not complete")
    return best_records(validations(spark, log_path, fovs).filter("complete"), "macro_recall")

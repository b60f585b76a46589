"""Artifact metadata comparison, reuse and table hashes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.functions.canonical import canonical_json
from ringmatch.operators.fingerprints import DEPTH, tree_fingerprint


def long_metadata(df: DataFrame, artifact: str, columns: Sequence[str]) -> DataFrame:
    """(artifact, key, value) rows of some columns."""
    entries = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.col(artifact).alias("artifact"), F.explode(F.array(*entries)).alias("e")).select(
        "artifact", "e.key", "e.value"
    )


def metadata_mismatches(recorded: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys whose recorded and expected values differ, a missing side being null."""
    left = recorded.select("artifact", "key", F.col("value").alias("recorded"))
    right = expected.select("artifact", "key", F.col("value").alias("expected"))
    joined = left.join(right, ["artifact", "key"], "full_outer")
    return joined.filter(~F.col("recorded").eqNullSafe(F.col("expected")))


def reusable_artifacts(recorded: DataFrame, expected: DataFrame) -> DataFrame:
    """Artifacts all of whose expected keys are recorded with the same value."""
    joined = expected.select("artifact", "key", F.col("value").alias("expected")).join(
        recorded.select("artifact", "key", F.col("value").alias("recorded")), ["artifact", "key"], "left"
    )
    return (
        joined.groupBy("artifact")
        .agg(F.bool_and(F.col("recorded").eqNullSafe(F.col("expected"))).alias("reusable"))
        .filter("reusable")
        .select("artifact")
    )


def build_missing(
    wanted: DataFrame, bank: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "id"
) -> DataFrame:
    """Keep bank rows that are wanted and build only the rest; ``reused`` tells them apart."""
    kept = bank.join(wanted.select(key), key, "left_semi").withColumn("reused", F.lit(True))
    built = build(wanted.join(bank.select(key), key, "left_anti")).withColumn("reused", F.lit(False))
    return kept.unionByName(built)


def table_hash(df: DataFrame, by: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """Content hash of a table; part files, row order and the other groups play no role."""
    return tree_fingerprint(df, depth, by)


def row_digest(columns: Sequence[str]):
    return F.sha2(canonical_json(columns), 256)

"""Partitioned stores for descriptors and hard pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bank(bank: DataFrame, path: str, split: str, artifact_hash: str) -> None:
    """Store descriptors under (split, artifact_hash); only that partition is replaced."""
    rows = bank.withColumns({"split": F.lit(split), "artifact_hash": F.lit(artifact_hash)})
    _write_partitions(rows, path, ["split", "artifact_hash"])


def read_bank(spark: SparkSession, path: str, split: str, artifact_hash: str) -> DataFrame:
    """Descriptors of one artifact; the other partitions are never listed or read."""
    wanted = (F.col("split") == split) & (F.col("artifact_hash") == artifact_hash)
    return spark.read.parquet(path).filter(wanted).drop("split", "artifact_hash")


def write_pool(pool: DataFrame, path: str, source_epoch: int) -> None:
    """Store one mined pool under (source_epoch, fov_deg)."""
    rows = pool.withColumn("source_epoch", F.lit(int(source_epoch)).cast("bigint"))
    _write_partitions(rows, path, ["source_epoch", "fov_deg"])


def _write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_pool(spark: SparkSession, path: str, source_epoch: int) -> DataFrame:
    pools = spark.read.parquet(path).filter(F.col("source_epoch") == int(source_epoch))
    return pools.withColumns({c: F.col(c).cast("bigint") for c in ("source_epoch", "fov_deg")})


def pool_epochs(spark: SparkSession, path: str) -> list[int]:
    """Stored source epochs, oldest first (one value per refresh, a handful per run)."""
    return sorted(row[0] for row in spark.read.parquet(path).select("source_epoch").distinct().collect())


def publish_newest(spark: SparkSession, path: str, target: str) -> int:
    """Copy the newest pool alone to a fresh table and return its epoch; older ones stay behind."""
    newest = pool_epochs(spark, path)[-1]
    rows = read_pool(spark, path, newest)
    rows.write.mode("errorifexists").partitionBy("source_epoch", "fov_deg").parquet(target)
    return newest

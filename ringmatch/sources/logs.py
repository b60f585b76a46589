"""Append-only metric log as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("batch_kind", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("fov_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("fovs", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
        T.StructField("joint_in_batch_accuracy", T.DoubleType()),
        T.StructField("learning_rates", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("loss", T.DoubleType()),
        T.StructField("new_best", T.BooleanType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("trigger", T.StringType()),
    ]
)


def append_log(records: DataFrame, path: str) -> None:
    """Append one JSON object per record with its keys in name order."""
    records.select(*sorted(records.columns)).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_log(
    spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def validation_recalls(log: DataFrame, metric: str = "R@1") -> DataFrame:
    """``run, epoch, fov_deg, recall_at_1`` rows of the validation records."""
    rows = log.filter("record_type = 'validation'").select("run", "epoch", F.explode("fovs").alias("fov", "metrics"))
    return rows.select(
        "run", "epoch", F.col("fov").cast("bigint").alias("fov_deg"), F.element_at("metrics", metric).alias("recall_at_1")
    )

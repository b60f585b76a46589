"""Inputs derived from the driver tables, written once for Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.functions.crops import int_div
from ringmatch.functions.seeds import stable_seed
from ringmatch.functions.vectors import pad_directions, rotate_bins, valid_mask
from ringmatch.operators.index import blocked_row_number

SEED = 42
DATASET = "pano"
BINS = 8
CHANNELS = 8
BIN_FOVS = (360, 180, 90, 45)
CROP_FOVS = (360, 180, 90, 70)
PANORAMA_WIDTH = 756
# Consecutive keys per block: near the square root of the key range at scale.
KEY_BLOCK = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seven(key: Column) -> Column:
    """Zero-padded id that keeps longer keys whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(7), F.length(text)), "0")


def fov_list(fovs) -> Column:
    return F.array(*[F.lit(f).cast("bigint") for f in fovs])


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        seven(F.col("vec_id")).alias("id"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("direction"),
    )


def queries(spark: SparkSession, sf_dir: str, fovs=BIN_FOVS) -> DataFrame:
    """Rolled, masked mixtures of each gallery entry with a partner entry."""
    own = gallery(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").count()
    partner = own.select(F.col("vec_id").alias("partner"), F.col("direction").alias("other"))
    joined = own.withColumn("partner", (F.col("vec_id") * 7 + 3) % rows).join(partner, "partner")
    # Few bytes turn into several vectors per row: spread the rows before deriving them.
    joined = joined.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    per_fov = joined.withColumn("fov_deg", F.explode(fov_list(fovs)))
    roll = stable_seed(SEED, "fixture", "val", 1, F.col("id"), F.col("fov_deg"), "roll") % BINS
    rolled = per_fov.withColumn("true_shift", roll).withColumn(
        "valid_bins", int_div(F.col("fov_deg"), F.lit(360 // BINS).cast("bigint"))
    )

    def visible(column: str) -> Column:
        turned = rotate_bins(F.col(column), F.col("true_shift"), BINS, CHANNELS)
        return F.slice(turned, F.lit(1), (F.col("valid_bins") * CHANNELS).cast("int"))

    mixed = F.zip_with(visible("direction"), visible("other"), lambda x, y: F.lit(0.6) * x + F.lit(0.4) * y)
    return rolled.select(
        F.col("id").alias("query_id"),
        "vec_id",
        "fov_deg",
        F.col("id").alias("positive_id"),
        "true_shift",
        pad_directions(mixed, BINS, CHANNELS).alias("direction"),
        valid_mask(F.col("valid_bins"), BINS).alias("valid"),
    )


def sizes(spark: SparkSession, sf_dir: str, fovs=BIN_FOVS) -> tuple[int, int]:
    rows = table(spark, sf_dir, "embeddings").count()
    return rows * len(fovs), rows


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen gallery ids per query, spread over the gallery."""
    rows = table(spark, sf_dir, "embeddings").count()
    ids = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda j: seven((F.col("vec_id") + j * 13 + 1) % F.lit(rows))
    )
    return table(spark, sf_dir, "embeddings").select(
        seven(F.col("vec_id")).alias("query_id"),
        F.explode(fov_list(BIN_FOVS)).alias("fov_deg"),
        ids.alias("candidates"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one pair with its bucket and 1-based ordinal."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    numbered = blocked_row_number(orders, ["o_orderkey"], int_div(F.col("o_orderkey"), KEY_BLOCK), name="ordinal")
    id_ = seven(F.col("o_orderkey"))
    return numbered.select("o_orderkey", id_.alias("id"), "ordinal", (stable_seed(id_) % 5).alias("bucket"))


def _splits(bucket: Column) -> Column:
    return F.when(bucket == 0, F.array(F.lit("val"), F.lit("test"))).when(
        bucket == 1, F.array(F.lit("test"))
    ).otherwise(F.array(F.lit("train")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair manifest of the three splits: val lies inside test, train is apart."""
    return pairs(spark, sf_dir).select(
        F.lit(DATASET).alias("dataset"),
        F.explode(_splits(F.col("bucket"))).alias("split"),
        F.col("id").alias("query_id"),
        F.concat(F.lit("ground/"), F.col("id"), F.lit(".jpg")).alias("query_path"),
        F.col("id").alias("satellite_id"),
        F.concat(F.lit("tile/"), F.col("id"), F.lit(".jpg")).alias("satellite_path"),
        F.lit("orders").alias("source_mat_struct"),
        F.col("ordinal").alias("source_mat_index"),
    )


def split_ids(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Query ids of one split with their location index (id order)."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", seven(F.col("o_orderkey")).alias("query_id"))
    bucket = stable_seed(F.col("query_id")) % 5
    chosen = rows.filter(F.array_contains(_splits(bucket), split))
    numbered = blocked_row_number(chosen, ["o_orderkey"], int_div(F.col("o_orderkey"), KEY_BLOCK), name="_n")
    return numbered.select((F.col("_n") - 1).alias("loc_idx"), "query_id")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile files that exist: orders with at least one line."""
    key = seven(F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select(
        F.concat(F.lit("tile/"), key, F.lit(".jpg")).alias("path")
    )

"""Pair lists, annotations, file inventories, manifests and write-once tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringmatch.functions.paths import file_stem, is_relative_inside, under_root
from ringmatch.sources.files import Files

# Fixed column contract of a pair manifest, in order.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("query_path", T.StringType()),
        T.StructField("satellite_id", T.StringType()),
        T.StructField("satellite_path", T.StringType()),
        T.StructField("source_mat_struct", T.StringType()),
        T.StructField("source_mat_index", T.LongType()),
    ]
)
MANIFEST_COLUMNS = MANIFEST_SCHEMA.names
PAIR_COLUMNS = ("satellite_path", "query_path", "annotation_path")


def read_pair_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless three-column CSV with a 1-based source row number.

    Rows are numbered by (file, split offset, place in the split): each split counts its own rows
    and only the per-split counts meet, so any number of files is read in parallel.
    Blank fields are empty strings. ``malformed`` marks rows that do not have exactly three fields.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*PAIR_COLUMNS, "_corrupt")])
    rows = (
        spark.read.schema(schema)
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
        .select(
            *[F.coalesce(c, F.lit("")).alias(c) for c in PAIR_COLUMNS],
            # The length keeps a data column in the scan, which refuses to return the flag alone.
            (F.col("_corrupt").isNotNull() & (F.length(F.coalesce(PAIR_COLUMNS[0], F.lit(""))) >= 0)).alias("malformed"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_place"),
        )
    )
    split = ["_file", "_start"]
    counts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(F.lit(0)).orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*split, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    local = F.row_number().over(W.partitionBy(*split).orderBy("_place"))
    return (
        rows.withColumn("_local", local)
        .join(offsets, split)
        .select(*PAIR_COLUMNS, "malformed", (F.col("_local") + F.col("_offset")).alias("source_row"))
    )


def resolve_ordinals(ids: DataFrame, indices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look up 1-based ordinals in an id list; returns (resolved rows, out-of-bounds rows)."""
    return indices.join(ids, "ordinal"), indices.join(ids, "ordinal", "left_anti")


def annotation_audit(indices: DataFrame, ids: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Annotated, expected and out-of-bounds counts per split."""
    known = indices.join(ids.select("ordinal", F.lit(True).alias("_known")), "ordinal", "left")
    table = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    return known.groupBy("split").agg(
        F.count(F.lit(1)).alias("annotated"),
        F.count_if(F.col("_known").isNull()).alias("out_of_bounds"),
    ).withColumn("expected", F.element_at(table, F.col("split")).cast("bigint"))


def list_files(spark: SparkSession, directory: str, suffix: str) -> DataFrame:
    """Paths in a directory that end in ``suffix``; file contents are never read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory).select("path")
    )


def ids_from_paths(files: DataFrame, suffix: str, column: str = "path") -> DataFrame:
    """Distinct ids: the last path segment with the suffix cut off."""
    name = F.regexp_extract(F.col(column), r"([^/]+)$", 1)
    kept = files.filter(name.endswith(suffix))
    return kept.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("id")).distinct()


def stems_with_extension(files: DataFrame, extension: str, column: str = "path") -> DataFrame:
    """Distinct file stems whose extension matches without regard to case."""
    path = F.col(column)
    return files.filter(F.lower(path).endswith(extension.lower())).select(file_stem(path).alias("id")).distinct()


def check_manifest_columns(df: DataFrame) -> None:
    missing = [c for c in MANIFEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Not in the manifest: columns {missing}")


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Manifest with its relative paths resolved below ``root``.

    A row whose path is absolute or climbs out of the root fails the query that reads it.
    """
    raw = spark.read.parquet(path)
    check_manifest_columns(raw)

    def resolved(column: str):
        bad = F.concat(F.lit("Manifest path must stay below the root: "), F.col(column))
        guarded = F.when(is_relative_inside(F.col(column)), F.col(column)).otherwise(F.raise_error(bad))
        return under_root(root, guarded)

    typed = raw.select(*[F.col(f.name).cast(f.dataType) for f in MANIFEST_SCHEMA])
    return typed.withColumns({c: resolved(c) for c in ("query_path", "satellite_path")})


def relative_to_root(df: DataFrame, column: str, root: str) -> DataFrame:
    """Strip ``root`` from absolute paths; a path outside the root fails the query."""
    prefix = root.rstrip("/") + "/"
    inside = F.col(column).startswith(prefix) & ~F.array_contains(F.split(column, "/"), "..")
    bad = F.concat(F.lit("Path must be inside the root: "), F.col(column))
    return df.withColumn(
        column, F.when(inside, F.substring(F.col(column), F.lit(len(prefix) + 1), F.length(column))).otherwise(F.raise_error(bad))
    )


def write_once(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> str:
    """Parquet sink that refuses an existing target unless told to replace it.

    A replacement is written beside the target and takes its place by renaming when it is whole, so a
    failing one leaves the old table as it was. The new rows may come from the old table.
    """
    files = Files(df.sparkSession, path)
    replaces = files.exists(path)
    if replaces and not overwrite:
        raise FileExistsError(f"{path} holds a table and overwriting was not asked for")
    target = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new" if replaces else path
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.parquet(target)
    except Exception:
        if replaces:
            files.delete(target)
        raise
    if replaces:
        old = f"{target[: -len('new')]}old"
        files.rename(path, old)
        files.rename(target, path)
        files.delete(old)
        df.sparkSession.catalog.refreshByPath(path)
    return path


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Row count of a Parquet table; no data column is read."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))

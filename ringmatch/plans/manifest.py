"""Manifest preparation: read the source, audit it completely, then publish."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.functions.paths import fill_template, is_relative_inside, numeric_id
from ringmatch.operators import audits
from ringmatch.operators.audits import require_empty
from ringmatch.operators.fingerprints import manifest_fingerprint
from ringmatch.session import durable
from ringmatch.sources.tables import (
    MANIFEST_COLUMNS,
    read_pair_list,
    resolve_ordinals,
    write_once,
)


def _require_counts(found: Mapping[str, int], expected: Mapping[str, int], what: str) -> None:
    if set(found) != set(expected):
        raise ValueError(f"Splits are {sorted(found)}, expected {sorted(expected)}")
    for split, count in expected.items():
        if found[split] != count:
            raise ValueError(f"Unexpected {what} count of {split}: {found[split]}, expected {count}")


def audit_manifest(manifest: DataFrame, expected: Mapping[str, int]) -> None:
    """Refuse a manifest that breaks its count, id or split contract."""
    if not {"train", "val"} <= set(expected):
        raise ValueError("Manifests must contain train and val splits")
    found = audits.contract_audit(manifest, list(expected)).first().asDict()
    if found["other"]:
        raise ValueError(f"{found['other']} rows belong to splits other than {sorted(expected)}")
    _require_counts({s: found[f"pairs_{s}"] or 0 for s in expected}, expected, "final")
    if found["broken"] or any(found[f"pairs_{s}"] != found[f"distinct_{s}"] for s in expected):
        raise ValueError(f"Ids must be unique and paired one to one: {found}")
    if found["train_val"] or found["train_test"]:
        raise ValueError(f"train must be disjoint from val and test: {found}")
    if "test" in expected and (found["val_outside_test"] or not found["test_only"]):
        raise ValueError(f"val must be a strict subset of test: {found}")


def _require_equal_inventory(files: DataFrame, referenced: DataFrame, what: str) -> None:
    counts = audits.reconcile(files.select(F.col("path").alias("id")), referenced, "id")
    require_empty(counts.filter("extra > 0 OR missing > 0"), f"{what} inventory differs (listed, referenced, extra, missing)")


def publish(manifest: DataFrame, out: str, protocol: str, overwrite: bool, counts: Mapping[str, DataFrame]) -> dict[str, str]:
    """Write the manifest, its inventory rows and its metadata."""
    spark = manifest.sparkSession
    paths = {name: f"{out}/{name}" for name in ("manifest", "inventory", "metadata")}
    write_once(manifest.select(*MANIFEST_COLUMNS), paths["manifest"], overwrite, ("dataset", "split"))
    written = spark.read.parquet(paths["manifest"]).select(*MANIFEST_COLUMNS)
    inventory = None
    for name, frame in counts.items():
        part = frame.select(F.lit(name).alias("artifact"), F.col("split").alias("key"), F.col("n").cast("string").alias("value"))
        inventory = part if inventory is None else inventory.unionByName(part)
    write_once(inventory, paths["inventory"], overwrite)
    entries = [
        F.struct(F.lit(name).alias("artifact"), F.col("split").alias("key"), F.col(column).alias("value"))
        for name, column in (("manifest_sha256", "fingerprint"), ("manifest_algorithm", "algorithm"))
    ]
    prints = manifest_fingerprint(written).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    version = spark.range(1).select(
        F.lit("protocol_version").alias("artifact"), F.lit("*").alias("key"), F.lit(protocol).alias("value")
    )
    write_once(prints.unionByName(version), paths["metadata"], overwrite)
    return paths


def build_from_pair_lists(
    spark: SparkSession,
    lists: Mapping[str, str],
    query_files: DataFrame,
    satellite_files: DataFrame,
    out: str,
    expected: Mapping[str, int],
    dataset: str,
    protocol: str,
    strict_inventory: bool = True,
    overwrite: bool = False,
) -> dict[str, str]:
    """Manifests from headerless pair lists, in source row order.

    ``lists`` maps a split to its CSV path; the file frames hold the ``path`` of every file there is.
    """
    pairs = None
    for split, path in lists.items():
        rows = read_pair_list(spark, path).withColumns({"split": F.lit(split), "source": F.lit(path)})
        pairs = rows if pairs is None else pairs.unionByName(rows)
    pairs = durable(pairs)
    require_empty(pairs.filter("malformed").select("split", "source_row"), "Pair lists must have three columns")
    bad = audits.triplet_violations(pairs).select("split", "source_row", "reason")
    require_empty(bad, "Rows do not form an id-matched triplet inside the root")
    manifest = pairs.select(
        F.lit(dataset).alias("dataset"),
        "split",
        numeric_id(F.col("query_path")).alias("query_id"),
        "query_path",
        numeric_id(F.col("satellite_path")).alias("satellite_id"),
        "satellite_path",
        F.col("source").alias("source_mat_struct"),
        F.col("source_row").cast("bigint").alias("source_mat_index"),
    )
    require_empty(audits.missing_pairs(manifest, query_files, satellite_files), "Missing image files")
    audit_manifest(manifest, expected)
    if strict_inventory:
        _require_equal_inventory(satellite_files, manifest.select(F.col("satellite_path").alias("id")), "Satellite")
    counts = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return publish(manifest, out, protocol, overwrite, {"final_counts": counts})


def build_from_index(
    spark: SparkSession,
    ids: DataFrame,
    indices: DataFrame,
    exclusions: DataFrame,
    query_files: DataFrame,
    satellite_files: DataFrame,
    out: str,
    expected_annotated: Mapping[str, int],
    expected_final: Mapping[str, int],
    dataset: str,
    protocol: str,
    query_template: str,
    satellite_template: str,
    inventory_split: str | None = "test",
    overwrite: bool = False,
) -> dict[str, str]:
    """Manifests from an id list and 1-based index lists, less the approved exclusions.

    ``ids``: ordinal, query_id; ``indices``: split, ordinal; ``exclusions``: split, query_id,
    source_mat_index, ...; the templates may use ``{split}`` and ``{query_id}``.
    """
    annotated = indices.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"))
    _require_counts({r["split"]: r["pairs"] for r in annotated.collect()}, expected_annotated, "annotation")
    annotations, outside = resolve_ordinals(ids, indices)
    annotations = durable(annotations)
    require_empty(outside, "Index outside the id list")
    require_empty(audits.duplicate_ids(annotations, "query_id"), "Duplicate annotations")
    parts = audits.apply_exclusions(annotations, exclusions)
    require_empty(
        audits.exclusion_violations(parts), "Every exclusion must match one annotation with the same index, once"
    )

    def with_paths(df: DataFrame) -> DataFrame:
        fields = {"split": F.col("split"), "query_id": F.col("query_id")}
        return df.withColumns(
            {
                "query_path": fill_template(query_template, **fields),
                "satellite_path": fill_template(satellite_template, **fields),
            }
        )

    manifest = with_paths(parts["kept"]).select(
        F.lit(dataset).alias("dataset"),
        "split",
        "query_id",
        "query_path",
        F.col("query_id").alias("satellite_id"),
        "satellite_path",
        F.lit("index").alias("source_mat_struct"),
        F.col("ordinal").cast("bigint").alias("source_mat_index"),
    )
    manifest = durable(manifest)
    outside = ~is_relative_inside(F.col("query_path")) | ~is_relative_inside(F.col("satellite_path"))
    require_empty(manifest.filter(outside).select("split", "query_id"), "Paths leave the root")
    require_empty(audits.missing_pairs(manifest, query_files, satellite_files), "Unapproved missing pairs")
    audit_manifest(manifest, expected_final)
    if inventory_split:
        chosen = manifest.filter(F.col("split") == inventory_split)
        _require_equal_inventory(query_files, chosen.select(F.col("query_path").alias("id")), "Query")
        _require_equal_inventory(satellite_files, chosen.select(F.col("satellite_path").alias("id")), "Satellite")
    final = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    paths = publish(
        manifest, out, protocol, overwrite, {"annotated_counts": annotated.withColumnRenamed("pairs", "n"), "final_counts": final}
    )
    applied = with_paths(parts["applied"])
    for side, files in (("query", query_files), ("satellite", satellite_files)):
        seen = files.select(F.col("path").alias(f"{side}_path"), F.lit(True).alias("_seen"))
        applied = applied.join(seen, f"{side}_path", "left")
        applied = applied.withColumn(f"{side}_exists", F.coalesce("_seen", F.lit(False))).drop("_seen")
    paths["exclusions"] = f"{out}/exclusions_applied"
    write_once(applied.drop("query_path", "satellite_path", "ordinal"), paths["exclusions"], overwrite)
    return paths



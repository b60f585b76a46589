"""Manifest audits. Each returns violation rows; an empty frame means the contract holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringmatch.functions.crops import int_div

from ringmatch.functions.paths import is_relative_inside, numeric_id


def triplet_violations(pairs: DataFrame, digits: int = 7) -> DataFrame:
    """Rows whose three paths do not carry one and the same well-formed id."""
    ids = {f"_{c}": numeric_id(F.col(c), digits) for c in ("satellite_path", "query_path", "annotation_path")}
    sat, query, note = (F.col(c) for c in ids)
    malformed = sat.isNull() | query.isNull() | note.isNull()
    mismatch = (sat != query) | (query != note)
    outside = ~(is_relative_inside(F.col("satellite_path")) & is_relative_inside(F.col("query_path")))
    reason = F.when(malformed, "malformed_id").when(mismatch, "id_mismatch").when(outside, "path_escape")
    # Exploding the reason instead of filtering on it keeps the ids from being parsed per comparison.
    found = F.explode(F.array_compact(F.array(reason))).alias("reason")
    return pairs.withColumns(ids).select(*pairs.columns, found)


def apply_exclusions(annotations: DataFrame, exclusions: DataFrame) -> dict[str, DataFrame]:
    """Anti-join on (split, id) with the audit of every configured exclusion.

    ``annotations``: split, query_id, ordinal; ``exclusions``: split, query_id, source_mat_index, ...
    """
    key = ["split", "query_id"]
    keys = exclusions.select(*key, F.col("source_mat_index").alias("_expected"))
    matched = annotations.join(keys, key)
    return {
        "kept": annotations.join(keys, key, "left_anti"),
        "applied": exclusions.join(annotations.select(*key, "ordinal"), key),
        "unmatched": exclusions.join(annotations, key, "left_anti"),
        "ordinal_mismatch": matched.filter(F.col("_expected") != F.col("ordinal")),
        "duplicate": exclusions.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"),
    }


def exclusion_violations(parts: dict[str, DataFrame]) -> DataFrame:
    """Every reason to refuse an exclusion list, from :func:`apply_exclusions`."""
    out = None
    for reason in ("duplicate", "unmatched", "ordinal_mismatch"):
        rows = parts[reason].select("split", "query_id", F.lit(reason).alias("reason"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_existence_flags(applied: DataFrame, query_ids: DataFrame, satellite_ids: DataFrame) -> DataFrame:
    """Mark which side of an excluded pair exists on disk (id frames hold distinct ``id``)."""
    q = query_ids.select(F.col("id").alias("query_id"), F.lit(True).alias("_q"))
    s = satellite_ids.select(F.col("id").alias("query_id"), F.lit(True).alias("_s"))
    joined = applied.join(q, "query_id", "left").join(s, "query_id", "left")
    return (
        joined.withColumn("query_exists", F.coalesce("_q", F.lit(False)))
        .withColumn("satellite_exists", F.coalesce("_s", F.lit(False)))
        .drop("_q", "_s")
    )


def missing_pairs(manifest: DataFrame, query_files: DataFrame | None, satellite_files: DataFrame) -> DataFrame:
    """Kept pairs without a file, one row per missing side (file frames hold ``path``)."""
    sides = {"satellite": satellite_files} | ({"query": query_files} if query_files is not None else {})
    parts = []
    for side, files in sides.items():
        column = f"{side}_path"
        gone = manifest.join(files.select(F.col("path").alias(column)), column, "left_anti")
        parts.append(gone.select("split", "query_id", F.lit(side).alias("side"), F.col(column).alias("path")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reconcile(listed: DataFrame, referenced: DataFrame, key: str = "id") -> DataFrame:
    """Counts of ids on one side only; both frames are reduced to distinct ids first."""
    left = listed.select(key).distinct().withColumn("_l", F.lit(True))
    right = referenced.select(key).distinct().withColumn("_r", F.lit(True))
    return left.join(right, key, "full_outer").agg(
        F.count_if(F.col("_l").isNotNull()).alias("listed"),
        F.count_if(F.col("_r").isNotNull()).alias("referenced"),
        F.count_if(F.col("_r").isNull()).alias("extra"),
        F.count_if(F.col("_l").isNull()).alias("missing"),
    )


def duplicate_ids(manifest: DataFrame, column: str, by: Sequence[str] = ("split",)) -> DataFrame:
    return manifest.groupBy(*by, column).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def bijection_audit(manifest: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Per split: rows, distinct ids on both sides and rows that pair different ids."""
    return manifest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_distinct("query_id").alias("distinct_queries"),
        F.count_distinct("satellite_id").alias("distinct_satellites"),
        F.count_if(F.col("query_id") != F.col("satellite_id")).alias("broken_pairs"),
    )


def count_audit(counts: DataFrame, expected: Mapping[str, int], by: str = "split", value: str = "pairs") -> DataFrame:
    """Compare a count per split with the configured expectation."""
    table = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    wanted = F.element_at(table, F.col(by)).cast("bigint")
    return counts.withColumn("expected", wanted).withColumn("matches", F.col(value).eqNullSafe(wanted))


def split_rollup(manifest: DataFrame) -> DataFrame:
    """Inventory per split, per dataset and in total."""
    return manifest.rollup("dataset", "split").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_id").alias("distinct_queries")
    )


def split_overlaps(manifest: DataFrame, left: str, right: str, column: str = "query_id") -> DataFrame:
    """Ids in both splits."""
    ids = {s: manifest.filter(F.col("split") == s).select(column) for s in (left, right)}
    return ids[left].intersect(ids[right])


def subset_audit(manifest: DataFrame, inner: str, outer: str, column: str = "query_id") -> DataFrame:
    """Ids of ``inner`` outside ``outer`` (must be 0) and the reverse (must not be 0)."""
    flags = manifest.filter(F.col("split").isin(inner, outer)).groupBy(column).agg(
        F.bool_or(F.col("split") == inner).alias("_in"), F.bool_or(F.col("split") == outer).alias("_out")
    )
    counts = flags.agg(
        F.count_if(F.col("_in") & ~F.col("_out")).alias("outside"),
        F.count_if(~F.col("_in") & F.col("_out")).alias("outer_only"),
    )
    return counts.withColumn("strict_subset", (F.col("outside") == 0) & (F.col("outer_only") > 0))


def split_contract(manifest: DataFrame, column: str = "query_id") -> DataFrame:
    """Both overlaps of train and the val-in-test counts in one pass over the ids."""
    member = {s: F.bool_or(F.col("split") == s).alias(s) for s in ("train", "val", "test")}
    flags = manifest.groupBy(column).agg(*member.values())
    train, val, test = F.col("train"), F.col("val"), F.col("test")
    return flags.agg(
        F.count_if(train & val).alias("train_val"),
        F.count_if(train & test).alias("train_test"),
        F.count_if(val & ~test).alias("val_outside_test"),
        F.count_if(test & ~val).alias("test_only"),
    )


def contract_audit(manifest: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Counts, uniqueness, pairing and split overlaps of a whole manifest in one pass over the ids.

    One row: ``pairs_<split>`` and ``distinct_<split>`` per split, ``broken`` (rows that pair
    different ids; at 0 both sides have the same ids), ``other`` (rows of unlisted splits) and the
    overlaps of :func:`split_contract`.
    """
    count = {s: F.count_if(F.col("split") == s).alias(f"_{s}") for s in (*splits, *_absent(splits))}
    per_id = manifest.groupBy("query_id").agg(
        *count.values(),
        F.count_if(F.col("query_id") != F.col("satellite_id")).alias("_broken"),
        F.count_if(~F.col("split").isin(*splits)).alias("_other"),
    )
    has = {s: F.col(f"_{s}") > 0 for s in count}
    return per_id.agg(
        *[F.sum(f"_{s}").alias(f"pairs_{s}") for s in splits],
        *[F.count_if(has[s]).alias(f"distinct_{s}") for s in splits],
        F.sum("_broken").alias("broken"),
        F.sum("_other").alias("other"),
        F.count_if(has["train"] & has["val"]).alias("train_val"),
        F.count_if(has["train"] & has["test"]).alias("train_test"),
        F.count_if(has["val"] & ~has["test"]).alias("val_outside_test"),
        F.count_if(has["test"] & ~has["val"]).alias("test_only"),
    )


def _absent(splits: Sequence[str]) -> list[str]:
    return [s for s in ("train", "val", "test") if s not in splits]


def alignment(bank: DataFrame, manifest: DataFrame, bank_id: str = "id", manifest_id: str = "satellite_id") -> DataFrame:
    """Ids whose copies differ between an artifact and the manifest, or that repeat in either."""
    left = bank.groupBy(F.col(bank_id).alias("id")).agg(F.count(F.lit(1)).alias("in_bank"))
    right = manifest.groupBy(F.col(manifest_id).alias("id")).agg(F.count(F.lit(1)).alias("in_manifest"))
    joined = left.join(right, "id", "full_outer").fillna(0, ["in_bank", "in_manifest"])
    problem: Column = (
        F.when(F.col("in_bank") == 0, "missing")
        .when(F.col("in_manifest") == 0, "extra")
        .when((F.col("in_bank") > 1) | (F.col("in_manifest") > 1), "duplicate")
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def require_empty(violations: DataFrame, message: str, shown: int = 3) -> None:
    """Raise with a few examples if a violation frame has rows.

    The limit sits below an exchange, so that one job looks at all partitions at once; a plain
    ``take`` would walk an empty frame in ever larger steps.
    """
    examples = violations.limit(shown).coalesce(1).collect()
    if examples:
        raise ValueError(f"{message}: first={[tuple(r) for r in examples]}")


def shard_outputs_audit(outputs: DataFrame, expected: DataFrame, rows: int, shards: int) -> DataFrame:
    """Whether shard outputs, put one after the other, are the expected list: one row per shard.

    ``outputs``: ``shard, place`` (0-based, in the shard's own output), ``id``; ``expected``: ``index, id`` of the whole list
    of ``rows``. A shard covers a contiguous range of the list. ``contiguous``: its places are 0, 1, 2, ... up to the end of its
    range, each once. ``in_order``: a digest over (place, id), which merges in any order of rows but depends on
    every row's place, equals that of the list's range. Nothing is sorted, and no shard is held in one task.
    """
    bounds = [(rows * r // shards, rows * (r + 1) // shards) for r in range(shards)]
    number = int_div((F.col("index") + 1) * shards - 1, F.lit(rows).cast("bigint"))
    low = F.element_at(F.array(*[F.lit(b).cast("bigint") for b, _ in bounds]), (F.col("shard") + 1).cast("int"))

    def digest(df: DataFrame) -> list:
        whole = F.bit_xor(F.xxhash64("place", "id")).alias("digest"), F.bit_xor(F.xxhash64("id", "place")).alias("other")
        return [F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"), F.max("place").alias("last"), *whole]

    listed = expected.select(number.alias("shard"), "index", "id").withColumn("place", F.col("index") - low)
    wanted = listed.groupBy("shard").agg(*digest(listed))
    found = outputs.groupBy("shard").agg(*digest(outputs), F.count_distinct("place").alias("places"))
    wanted = wanted.select("shard", F.col("rows").alias("expected_rows"), F.col("digest").alias("_digest"), F.col("other").alias("_other"))
    joined = wanted.join(found, "shard", "full_outer")
    contiguous = (F.col("rows") == F.col("expected_rows")) & (F.col("places") == F.col("rows")) & (F.col("first") == 0)
    contiguous = F.coalesce(contiguous & (F.col("last") == F.col("rows") - 1), F.lit(False))
    equal = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("other").eqNullSafe(F.col("_other"))
    return joined.select(
        "shard",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("expected_rows", F.lit(0)).alias("expected_rows"),
        contiguous.alias("contiguous"),
        (contiguous & equal).alias("in_order"),
    )

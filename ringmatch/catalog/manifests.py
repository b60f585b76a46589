"""Pair lists, manifests, inventories, audits, set checks, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringmatch.catalog import fixtures as X
from ringmatch.catalog import sql as S
from ringmatch.catalog.registry import query
from ringmatch.functions.canonical import canonical_json, canonical_map_json, colliding_keys, sha256_json
from ringmatch.functions.paths import fill_template, is_relative_inside, numeric_id
from ringmatch.functions.seeds import stable_seed
from ringmatch.functions.vectors import quantise
from ringmatch.operators import audits, batches, fingerprints, index, provenance
from ringmatch.session import scratch_path
from ringmatch.sources import tables
from ringmatch.sources.ledger import Ledger, StaleArtifact

# Pair list with some blank annotations, wrong ids and escaping paths.
PAIR_LIST_SQL = f"""{S.PAIRS},
pair_list AS (
  SELECT ordinal, {S.seed("id", "'blank'")} % 50 = 0 AS blank, {S.seed("id", "'swap'")} % 61 = 0 AS swap,
         {S.seed("id", "'escape'")} % 71 = 0 AS esc, id FROM pairs),
pair_rows AS (
  SELECT ordinal AS source_row, 'tile/19/' || id || '.jpg' AS satellite_path,
         CASE WHEN swap THEN 'ground/9' || substr(id, 2) || '.jpg'
              WHEN esc THEN '../ground/' || id || '.jpg' ELSE 'ground/' || id || '.jpg' END AS query_path,
         CASE WHEN blank THEN '' ELSE 'notes/' || id || '.png' END AS annotation_path
  FROM pair_list)"""


def pair_list(spark, sf):
    id_ = F.col("id")
    ground = F.concat(F.lit("ground/"), id_, F.lit(".jpg"))
    swapped = F.concat(F.lit("ground/9"), F.substring(id_, F.lit(2), F.length(id_)), F.lit(".jpg"))
    return X.pairs(spark, sf).select(
        F.col("ordinal").cast("bigint").alias("source_row"),
        F.concat(F.lit("tile/19/"), id_, F.lit(".jpg")).alias("satellite_path"),
        F.when(stable_seed(id_, "swap") % 61 == 0, swapped)
        .when(stable_seed(id_, "escape") % 71 == 0, F.concat(F.lit("../"), ground))
        .otherwise(ground)
        .alias("query_path"),
        F.when(stable_seed(id_, "blank") % 50 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("notes/"), id_, F.lit(".png")))
        .alias("annotation_path"),
    )


@query(
    "s1_pair_list_scan",
    f"""WITH {PAIR_LIST_SQL} SELECT *, false AS malformed FROM pair_rows""",
)
def s1_pair_list_scan(spark, sf):
    path = scratch_path(spark, "pairs")
    ordered = pair_list(spark, sf).repartitionByRange(4, "source_row").sortWithinPartitions("source_row")
    ordered.select(*tables.PAIR_COLUMNS).write.csv(path)
    return tables.read_pair_list(spark, path)


INDEX_SQL = f"""
ids AS (SELECT doc_id + 1 AS ordinal, source || '-' || {S.seven('doc_id')} AS query_id FROM documents),
indices AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split,
                   doc_id + 1 + CASE WHEN doc_id % 40 = 0 THEN 1000000000 ELSE 0 END AS ordinal FROM labels)"""


def index_lists(spark, sf):
    ids = X.table(spark, sf, "documents").select(
        (F.col("doc_id") + 1).alias("ordinal"),
        F.concat("source", F.lit("-"), X.seven(F.col("doc_id"))).alias("query_id"),
    )
    off = F.when(F.col("doc_id") % 40 == 0, F.lit(1_000_000_000)).otherwise(F.lit(0))
    indices = X.table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("split"),
        (F.col("doc_id") + 1 + off).alias("ordinal"),
    )
    return ids, indices


@query(
    "s2_index_annotations",
    f"""WITH {INDEX_SQL}
    SELECT split, ordinal, coalesce(query_id, '') AS query_id, query_id IS NOT NULL AS in_bounds
    FROM indices LEFT JOIN ids USING (ordinal)""",
)
def s2_index_annotations(spark, sf):
    ids, indices = index_lists(spark, sf)
    found, outside = tables.resolve_ordinals(ids, indices)
    columns = ["split", "ordinal", "query_id", "in_bounds"]
    return (
        found.withColumn("in_bounds", F.lit(True))
        .select(columns)
        .unionByName(outside.withColumns({"query_id": F.lit(""), "in_bounds": F.lit(False)}).select(columns))
    )


@query(
    "s2_annotation_audit",
    f"""WITH {INDEX_SQL}
    SELECT split, count(*) AS annotated, count(*) FILTER (WHERE query_id IS NULL) AS out_of_bounds,
           CAST(CASE split WHEN 'val' THEN 100 ELSE 300 END AS BIGINT) AS expected
    FROM indices LEFT JOIN ids USING (ordinal) GROUP BY split""",
)
def s2_annotation_audit(spark, sf):
    ids, indices = index_lists(spark, sf)
    return tables.annotation_audit(indices, ids, {"val": 100, "train": 300})


@query("s3_inventory_ids", f"SELECT DISTINCT {S.seven('l_orderkey')} AS id FROM lineitem")
def s3_inventory_ids(spark, sf):
    return tables.ids_from_paths(X.listing(spark, sf), ".jpg")


@query(
    "s4_manifest_read",
    f"""WITH {S.MANIFEST} SELECT * REPLACE ('/data/root/' || query_path AS query_path,
        '/data/root/' || satellite_path AS satellite_path) FROM manifest""",
)
def s4_manifest_read(spark, sf):
    path = scratch_path(spark, "manifest")
    tables.write_once(X.manifest(spark, sf), path, partition_by=("dataset", "split"))
    return tables.read_manifest(spark, path, "/data/root")


@query(
    "s5_write_once",
    f"WITH {S.MANIFEST} SELECT split, count(*) AS rows, true AS second_write_refused FROM manifest GROUP BY split",
)
def s5_write_once(spark, sf):
    path = scratch_path(spark, "manifest")
    manifest = X.manifest(spark, sf)
    tables.write_once(manifest, path, partition_by=("split",))
    try:
        tables.write_once(manifest, path, partition_by=("split",))
        refused = False
    except FileExistsError:
        refused = True
    counts = spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("second_write_refused", F.lit(refused))


COUNTED = (
    *("region", "nation", "customer", "supplier", "part", "orders", "lineitem"),
    *("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
)


@query(
    "s6_parquet_rows",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in COUNTED),
)
def s6_parquet_rows(spark, sf):
    counts = [
        tables.parquet_rows(spark, f"{sf}/{t}.parquet").select(F.lit(t).alias("table_name"), "rows") for t in COUNTED
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "p1_numeric_id",
    f"""WITH {PAIR_LIST_SQL}
    SELECT source_row, coalesce(nullif(regexp_extract(query_path, '([^/]+)\\.[^.]+$', 1), ''), '') AS query_stem,
           regexp_matches(annotation_path, '(^|/)[0-9]{{7}}\\.[^./]+$') AS annotation_ok FROM pair_rows""",
)
def p1_numeric_id(spark, sf):
    return pair_list(spark, sf).select(
        "source_row",
        F.coalesce(numeric_id(F.col("query_path")), F.lit("")).alias("query_stem"),
        numeric_id(F.col("annotation_path")).isNotNull().alias("annotation_ok"),
    )


@query(
    "p2_paths",
    f"""WITH {PAIR_LIST_SQL}, p AS (SELECT *, regexp_extract(satellite_path, '([0-9]+)\\.jpg$', 1) AS id FROM pair_rows)
    SELECT source_row, 'val/street/' || id || '_grd.jpg' AS filled,
           NOT starts_with(query_path, '/') AND NOT list_contains(string_split(query_path, '/'), '..') AS inside FROM p""",
)
def p2_paths(spark, sf):
    id_ = numeric_id(F.col("satellite_path"))
    return pair_list(spark, sf).select(
        "source_row",
        fill_template("{image_root}/street/{query_id}_grd.jpg", image_root=F.lit("val"), query_id=id_).alias("filled"),
        is_relative_inside(F.col("query_path")).alias("inside"),
    )


@query(
    "p3_triplet_violations",
    f"""WITH {PAIR_LIST_SQL}, f AS (SELECT *, regexp_extract(satellite_path, '([0-9]+)\\.jpg$', 1) AS sid,
        regexp_extract(query_path, '([0-9]+)\\.jpg$', 1) AS qid FROM pair_rows)
    SELECT source_row, CASE WHEN annotation_path = '' THEN 'malformed_id' WHEN sid <> qid THEN 'id_mismatch'
           ELSE 'path_escape' END AS reason
    FROM f WHERE annotation_path = '' OR sid <> qid OR query_path LIKE '../%'""",
)
def p3_triplet_violations(spark, sf):
    return audits.triplet_violations(pair_list(spark, sf)).select("source_row", "reason")


@query(
    "p15_canonical_json",
    f"""WITH {S.MANIFEST}, j AS (SELECT split, query_id,
        '{{"query_id":"' || query_id || '","source_mat_index":' || source_mat_index || ',"split":"' || split || '"}}' AS json
        FROM manifest)
    SELECT *, sha256(json) AS digest FROM j""",
)
def p15_canonical_json(spark, sf):
    names = ["split", "source_mat_index", "query_id"]
    return X.manifest(spark, sf).select(
        "split", "query_id", canonical_json(names).alias("json"), sha256_json(names).alias("digest")
    )


EXCLUSION_SQL = """
annotations AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'train' END AS split,
                       'd' || doc_id AS query_id, doc_id + 1 AS ordinal FROM labels),
exclusions AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'train' END AS split, 'd' || doc_id AS query_id,
         doc_id + CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS source_mat_index FROM labels WHERE toxic = 1
  UNION ALL
  SELECT 'val', 'p' || page_id, page_id FROM pages WHERE page_id % 50 = 0)"""


def exclusion_tables(spark, sf):
    labels = X.table(spark, sf, "labels")
    split = F.when(F.col("doc_id") % 2 == 0, "val").otherwise("train").alias("split")
    id_ = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id")
    annotations = labels.select(split, id_, (F.col("doc_id") + 1).alias("ordinal"))
    source = F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1)
    exclusions = labels.filter("toxic = 1").select(split, id_, source.alias("source_mat_index"))
    pages = X.table(spark, sf, "pages").filter("page_id % 50 = 0")
    extra = pages.select(
        F.lit("val").alias("split"),
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("query_id"),
        F.col("page_id").alias("source_mat_index"),
    )
    files = X.table(spark, sf, "pages").select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("id"))
    return annotations, exclusions.unionByName(extra), files


@query(
    "j1_exclusions",
    f"""WITH {EXCLUSION_SQL},
    files AS (SELECT 'd' || page_id AS id FROM pages)
    SELECT a.split, a.query_id, 'kept' AS outcome, false AS query_exists FROM annotations a
    WHERE NOT EXISTS (SELECT 1 FROM exclusions e WHERE e.split = a.split AND e.query_id = a.query_id)
    UNION ALL
    SELECT e.split, e.query_id, 'applied', e.query_id IN (SELECT id FROM files)
    FROM exclusions e JOIN annotations a USING (split, query_id)
    UNION ALL
    SELECT e.split, e.query_id, 'unmatched', false FROM exclusions e
    WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE e.split = a.split AND e.query_id = a.query_id)
    UNION ALL
    SELECT e.split, e.query_id, 'ordinal_mismatch', false
    FROM exclusions e JOIN annotations a USING (split, query_id) WHERE e.source_mat_index <> a.ordinal""",
)
def j1_exclusions(spark, sf):
    annotations, exclusions, files = exclusion_tables(spark, sf)
    result = audits.apply_exclusions(annotations, exclusions)
    applied = audits.with_existence_flags(result["applied"], files, files)

    def part(name, df):
        exists = F.col("query_exists") if name == "applied" else F.lit(False)
        return df.select("split", "query_id", F.lit(name).alias("outcome"), exists.alias("query_exists"))

    out = part("applied", applied)
    for name in ("kept", "unmatched", "ordinal_mismatch"):
        out = out.unionByName(part(name, result[name]))
    return out


@query(
    "j2_missing_pairs",
    f"""WITH {S.MANIFEST},{S.LISTING}
    SELECT split, query_id, 'satellite' AS side, satellite_path AS path FROM manifest
    WHERE satellite_path NOT IN (SELECT path FROM listing)
    UNION ALL SELECT split, query_id, 'query', query_path FROM manifest
    WHERE CAST(query_id AS BIGINT) NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 2)""",
)
def j2_missing_pairs(spark, sf):
    longer = X.table(spark, sf, "lineitem").filter("l_linenumber >= 2").select(X.seven(F.col("l_orderkey")).alias("id")).distinct()
    ground = longer.select(F.concat(F.lit("ground/"), F.col("id"), F.lit(".jpg")).alias("path"))
    return audits.missing_pairs(X.manifest(spark, sf), ground, X.listing(spark, sf))


@query(
    "j3_inventory_reconciliation",
    f"""WITH {S.MANIFEST},{S.LISTING}, l AS (SELECT path FROM listing),
    r AS (SELECT DISTINCT satellite_path AS path FROM manifest WHERE split <> 'train')
    SELECT (SELECT count(*) FROM l) AS listed, (SELECT count(*) FROM r) AS referenced,
           (SELECT count(*) FROM l WHERE path NOT IN (SELECT path FROM r)) AS extra,
           (SELECT count(*) FROM r WHERE path NOT IN (SELECT path FROM l)) AS missing""",
)
def j3_inventory_reconciliation(spark, sf):
    referenced = X.manifest(spark, sf).filter("split <> 'train'").select(F.col("satellite_path").alias("path"))
    return audits.reconcile(X.listing(spark, sf), referenced, "path")


@query(
    "j12_bank_alignment",
    f"""WITH {S.MANIFEST},
    bank AS (SELECT {S.seven('l_orderkey')} AS id FROM lineitem WHERE {S.seed("l_orderkey", "l_linenumber", "'bank'")} % 4 = 0),
    b AS (SELECT id, count(*) AS in_bank FROM bank GROUP BY id),
    m AS (SELECT satellite_id AS id, count(*) AS in_manifest FROM manifest GROUP BY 1),
    j AS (SELECT id, coalesce(in_bank, 0) AS in_bank, coalesce(in_manifest, 0) AS in_manifest
          FROM b FULL OUTER JOIN m USING (id))
    SELECT *, CASE WHEN in_bank = 0 THEN 'missing' WHEN in_manifest = 0 THEN 'extra' ELSE 'duplicate' END AS problem
    FROM j WHERE in_bank = 0 OR in_manifest = 0 OR in_bank > 1 OR in_manifest > 1""",
)
def j12_bank_alignment(spark, sf):
    # A bank with gaps and doubles: each line item of an order writes a descriptor unless a keyed draw drops it.
    lines = X.table(spark, sf, "lineitem").filter(stable_seed(F.col("l_orderkey"), F.col("l_linenumber"), "bank") % 4 == 0)
    return audits.alignment(lines.select(X.seven(F.col("l_orderkey")).alias("id")), X.manifest(spark, sf))


@query(
    "a1_bijection_audit",
    f"""WITH {S.MANIFEST} SELECT split, count(*) AS pairs, count(DISTINCT query_id) AS distinct_queries,
    count(DISTINCT satellite_id) AS distinct_satellites,
    count(*) FILTER (WHERE query_id <> satellite_id) AS broken_pairs FROM manifest GROUP BY split""",
)
def a1_bijection_audit(spark, sf):
    return audits.bijection_audit(X.manifest(spark, sf))


@query(
    "a1_duplicate_ids",
    f"""SELECT l_linestatus AS split, {S.seven('l_orderkey')} AS satellite_id, count(*) AS copies
    FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def a1_duplicate_ids(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("split"), X.seven(F.col("l_orderkey")).alias("satellite_id")
    )
    return audits.duplicate_ids(rows, "satellite_id")


@query(
    "a2_count_audit",
    f"""WITH {S.MANIFEST}, c AS (SELECT split, count(*) AS pairs FROM manifest GROUP BY split)
    SELECT split, pairs, CAST(CASE split WHEN 'train' THEN 9000 WHEN 'val' THEN 3000 ELSE 6000 END AS BIGINT) AS expected,
           pairs = CASE split WHEN 'train' THEN 9000 WHEN 'val' THEN 3000 ELSE 6000 END AS matches FROM c""",
)
def a2_count_audit(spark, sf):
    counts = X.manifest(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("pairs"))
    return audits.count_audit(counts, {"train": 9000, "val": 3000, "test": 6000})


@query(
    "a2_inventory_rollup",
    f"""WITH {S.MANIFEST} SELECT coalesce(dataset, '*') AS dataset, coalesce(split, '*') AS split, count(*) AS pairs,
    count(DISTINCT query_id) AS distinct_queries FROM manifest GROUP BY ROLLUP (dataset, split)""",
)
def a2_inventory_rollup(spark, sf):
    return audits.split_rollup(X.manifest(spark, sf)).fillna("*", ["dataset", "split"])


@query(
    "a3_manifest_fingerprint",
    f"""WITH {S.MANIFEST}
    SELECT split, count(*) AS rows, 'sha256_canonical_json' AS algorithm,
      sha256('[' || string_agg('{{"dataset":"' || dataset || '","query_id":"' || query_id || '","query_path":"' || query_path
        || '","satellite_id":"' || satellite_id || '","satellite_path":"' || satellite_path || '","split":"' || split || '"}}',
        ',' ORDER BY query_id, satellite_id) || ']') AS fingerprint
    FROM manifest GROUP BY split""",
)
def a3_manifest_fingerprint(spark, sf):
    return fingerprints.manifest_fingerprint(X.manifest(spark, sf), form=fingerprints.EXACT)


def _tree_sql(by: str = "") -> str:
    """Rows ``j(json, by...)`` to a digest tree of depth four, per ``by``."""
    also = f"{by}, " if by else ""
    return f"""
    digests AS (SELECT {also}sha256(json) AS d, count(*) AS n FROM j GROUP BY ALL),
    leaves AS (SELECT {also}substr(d, 1, 4) AS node, sum(n) AS n, sha256(string_agg(d || ':' || n, ',' ORDER BY d)) AS d
               FROM digests GROUP BY ALL),
    parents AS (SELECT {also}substr(node, 1, 2) AS node2, sum(n) AS n, sha256(string_agg(d, ',' ORDER BY d)) AS d
                FROM leaves GROUP BY ALL)
    SELECT {also}CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, ',' ORDER BY d)) AS fingerprint"""


@query(
    "a3_manifest_tree",
    f"""WITH {S.MANIFEST}, j AS (SELECT split, '{{"dataset":"' || dataset || '","query_id":"' || query_id || '","query_path":"'
        || query_path || '","satellite_id":"' || satellite_id || '","satellite_path":"' || satellite_path || '","split":"'
        || split || '"}}' AS json FROM manifest),{_tree_sql("split")}, 'sha256_tree_4' AS algorithm FROM parents GROUP BY ALL""",
)
def a3_manifest_tree(spark, sf):
    return fingerprints.manifest_fingerprint(X.manifest(spark, sf))


@query(
    "v3_table_hash",
    """WITH j AS (SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"'
    || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders),""" + _tree_sql() + " FROM parents",
)
def v3_table_hash(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return provenance.table_hash(orders)


@query(
    "x1_split_disjointness",
    f"""WITH {S.MANIFEST}, i AS (
      SELECT 'train+val' AS pair, count(*) AS shared FROM (SELECT query_id FROM manifest WHERE split = 'train'
        INTERSECT SELECT query_id FROM manifest WHERE split = 'val')
      UNION ALL SELECT 'train+test', count(*) FROM (SELECT query_id FROM manifest WHERE split = 'train'
        INTERSECT SELECT query_id FROM manifest WHERE split = 'test')
      UNION ALL SELECT 'val+test', count(*) FROM (SELECT query_id FROM manifest WHERE split = 'val'
        INTERSECT SELECT query_id FROM manifest WHERE split = 'test'))
    SELECT * FROM i""",
)
def x1_split_disjointness(spark, sf):
    manifest = X.manifest(spark, sf)
    parts = [
        audits.split_overlaps(manifest, a, b).agg(F.count(F.lit(1)).alias("shared")).select(F.lit(f"{a}+{b}").alias("pair"), "shared")
        for a, b in (("train", "val"), ("train", "test"), ("val", "test"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "x2_strict_subset",
    f"""WITH {S.MANIFEST}, v AS (SELECT query_id FROM manifest WHERE split = 'val'),
    t AS (SELECT query_id FROM manifest WHERE split = 'test'),
    c AS (SELECT (SELECT count(*) FROM (FROM v EXCEPT FROM t)) AS outside,
                 (SELECT count(*) FROM (FROM t EXCEPT FROM v)) AS outer_only)
    SELECT *, outside = 0 AND outer_only > 0 AS strict_subset FROM c""",
)
def x2_strict_subset(spark, sf):
    return audits.subset_audit(X.manifest(spark, sf), "val", "test")


@query(
    "x2_split_contract",
    f"""WITH {S.MANIFEST}, f AS (SELECT query_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS v,
      bool_or(split = 'test') AS t FROM manifest GROUP BY query_id)
    SELECT count(*) FILTER (WHERE a AND v) AS train_val, count(*) FILTER (WHERE a AND t) AS train_test,
           count(*) FILTER (WHERE v AND NOT t) AS val_outside_test, count(*) FILTER (WHERE t AND NOT v) AS test_only FROM f""",
)
def x2_split_contract(spark, sf):
    return audits.split_contract(X.manifest(spark, sf))


@query(
    "x3_split_union",
    f"""WITH {S.MANIFEST} SELECT query_id, source_mat_index FROM manifest WHERE split = 'train'
    UNION ALL SELECT query_id, source_mat_index FROM manifest WHERE split = 'val'
    UNION ALL SELECT query_id, source_mat_index FROM manifest WHERE split = 'test'""",
)
def x3_split_union(spark, sf):
    manifest = X.manifest(spark, sf).select("split", "query_id", "source_mat_index")
    parts = [manifest.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.select("query_id", F.col("source_mat_index").cast("bigint").alias("source_mat_index"))


V_SQL = f"""{S.PAIRS},
expected AS (SELECT id AS artifact, unnest(['tile_path', 'bucket']) AS key,
                    unnest(['tile/' || id, CAST(bucket AS VARCHAR)]) AS value FROM pairs),
recorded AS (
  SELECT artifact, key, CASE WHEN key = 'bucket' AND {S.seed("artifact", "'edit'")} % 97 = 0 THEN value || '!' ELSE value END AS value
  FROM expected WHERE {S.seed("artifact", "'drop'")} % 89 <> 0)"""


def metadata(spark, sf):
    rows = X.pairs(spark, sf).select("id", F.concat(F.lit("tile/"), F.col("id")).alias("tile_path"), "bucket")
    expected = provenance.long_metadata(rows, "id", ["tile_path", "bucket"])
    edited = (F.col("key") == "bucket") & (stable_seed(F.col("artifact"), "edit") % 97 == 0)
    value = F.when(edited, F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    recorded = expected.filter(stable_seed(F.col("artifact"), "drop") % 89 != 0).withColumn("value", value)
    return recorded, expected


@query(
    "v1_metadata_mismatches",
    f"""WITH {V_SQL} SELECT artifact, key, coalesce(r.value, '<none>') AS recorded, coalesce(e.value, '<none>') AS expected
    FROM recorded r FULL OUTER JOIN expected e USING (artifact, key) WHERE r.value IS DISTINCT FROM e.value""",
)
def v1_metadata_mismatches(spark, sf):
    return provenance.metadata_mismatches(*metadata(spark, sf)).fillna("<none>", ["recorded", "expected"])


@query(
    "v1_reusable_artifacts",
    f"""WITH {V_SQL} SELECT e.artifact FROM expected e LEFT JOIN recorded r USING (artifact, key)
    GROUP BY e.artifact HAVING bool_and(r.value IS NOT DISTINCT FROM e.value)""",
)
def v1_reusable_artifacts(spark, sf):
    return provenance.reusable_artifacts(*metadata(spark, sf))


LEDGER_TOTAL = S.q("list_sum(v)")


@query(
    "v1_artifact_ledger",
    f"""WITH {S.GALLERY}, t AS (SELECT vec_id % 4 AS part, count(*) AS n, sum({LEDGER_TOTAL}) AS total FROM gallery GROUP BY 1)
    SELECT 'part' || part AS artifact, part < 2 AS usable, CAST(CASE part WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS number,
           CASE WHEN part < 2 THEN n ELSE 0 END AS rows, CAST(CASE WHEN part < 2 THEN total ELSE 0 END AS BIGINT) AS total_q,
           CASE part WHEN 2 THEN 'artifact' ELSE '' END AS differing FROM t""",
)
def v1_artifact_ledger(spark, sf):
    """Four banks: one committed, one replaced by a newer version, one of another artifact, one that was never committed."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    gallery = X.gallery(spark, sf).select("id", "direction", (F.col("vec_id") % 4).alias("part"))
    expected = {"artifact": "new", "angular_bins": X.BINS}
    rows = {k: gallery.filter(F.col("part") == k).select("id", "direction") for k in range(4)}
    ledger.publish("bank", "part0", rows[0], expected)
    ledger.publish("bank", "part1", rows[1].limit(1), expected | {"artifact": "old"})
    ledger.publish("bank", "part1", rows[1], expected)
    ledger.publish("bank", "part2", rows[2], expected | {"artifact": "old"})
    rows[3].write.parquet(f"{ledger.root}/data/bank/part3/half")
    wanted = spark.createDataFrame([(f"part{k}", key, str(v)) for k in range(3) for key, v in expected.items()], "artifact string, key string, value string")
    differing = ledger.mismatches(wanted, "bank").groupBy("artifact").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("differing"))
    total = F.sum(quantise(F.aggregate("direction", F.lit(0.0), lambda a, x: a + x))).alias("total_q")
    found = None
    for k in range(4):
        try:
            held = ledger.open("bank", f"part{k}", expected)
            number = ledger.version("bank", f"part{k}").number
        except StaleArtifact:
            held, number = rows[k].limit(0), 0
        one = held.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).alias("total_q")).select(
            F.lit(f"part{k}").alias("artifact"), F.lit(number > 0).alias("usable"), F.lit(number).cast("bigint").alias("number"), "rows", "total_q"
        )
        found = one if found is None else found.unionByName(one)
    return found.join(differing, "artifact", "left").fillna("", ["differing"])


MERGE_SHARDS = 7


@query(
    "x3_shard_outputs",
    f"""WITH {S.PAIRS}, l AS (SELECT id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM pairs),
    s AS (SELECT *, ((i + 1) * {MERGE_SHARDS} - 1) // n AS shard FROM l),
    p AS (SELECT *, i - min(i) OVER (PARTITION BY shard) AS place, count(*) OVER (PARTITION BY shard) AS size FROM s),
    o AS (SELECT shard, CASE WHEN shard = 4 AND place IN (3, 4) THEN 7 - place ELSE place END AS place, id FROM p
          WHERE NOT (shard = 2 AND place = 10) AND shard <> 6
          UNION ALL SELECT shard, place, id FROM p WHERE shard = 5 AND place = size - 1)
    SELECT p.shard, CAST(max(coalesce(k.rows, 0)) AS BIGINT) AS rows, count(*) AS expected_rows,
           coalesce(max(k.rows) = count(*) AND max(k.places) = max(k.rows) AND max(k.last) = max(k.rows) - 1, false) AS contiguous,
           coalesce(max(k.rows) = count(*) AND max(k.places) = max(k.rows) AND max(k.last) = max(k.rows) - 1 AND max(k.moved) = 0, false) AS in_order
    FROM p LEFT JOIN (SELECT o.shard, count(*) AS rows, count(DISTINCT o.place) AS places, max(o.place) AS last,
                             count(*) FILTER (WHERE o.id <> q.id) AS moved
                      FROM o JOIN p q ON q.shard = o.shard AND q.place = o.place GROUP BY o.shard) k ON k.shard = p.shard
    GROUP BY p.shard""",
)
def x3_shard_outputs(spark, sf):
    """Seven shard outputs: one with a gap, one with two rows swapped, one with a row twice, one missing."""
    rows = X.table(spark, sf, "orders").count()
    listed = X.pairs(spark, sf).select((F.col("ordinal") - 1).cast("bigint").alias("index"), "id")
    low = F.element_at(F.array(*[F.lit(rows * r // MERGE_SHARDS) for r in range(MERGE_SHARDS)]), (F.col("shard") + 1).cast("int"))
    high = F.element_at(F.array(*[F.lit(rows * (r + 1) // MERGE_SHARDS) for r in range(MERGE_SHARDS)]), (F.col("shard") + 1).cast("int"))
    number = batches.shard_of_index(F.col("index"), rows, MERGE_SHARDS)
    placed = listed.withColumn("shard", number).withColumn("place", F.col("index") - low)
    kept = placed.filter(~((F.col("shard") == 2) & (F.col("place") == 10)) & (F.col("shard") != 6))
    swapped = (F.col("shard") == 4) & F.col("place").isin(3, 4)
    outputs = kept.select("shard", F.when(swapped, 7 - F.col("place")).otherwise(F.col("place")).alias("place"), "id")
    twice = placed.filter((F.col("shard") == 5) & (F.col("index") == high - 1)).select("shard", "place", "id")
    return audits.shard_outputs_audit(outputs.unionByName(twice), listed, rows, MERGE_SHARDS)


LINES_SQL = "lines AS (SELECT l_orderkey, l_linenumber AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


@query(
    "p15_map_keys",
    f"""WITH {LINES_SQL}, e AS (SELECT l_orderkey, CAST(k * 5 AS VARCHAR) AS k, max(q) AS q FROM lines GROUP BY ALL)
    SELECT l_orderkey, '{{' || string_agg('"' || k || '":' || q, ',' ORDER BY k) || '}}' AS json FROM e GROUP BY l_orderkey""",
)
def p15_map_keys(spark, sf):
    """Number keys become strings and are put in string order: 10 before 5."""
    lines = X.table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 5).alias("key")).agg(
        F.max(F.col("l_quantity").cast("bigint")).alias("value")
    )
    entries = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("key", "value")).alias("entries"))
    return entries.select("l_orderkey", canonical_map_json(F.col("entries")).alias("json"))


@query(
    "p15_colliding_keys",
    f"""WITH {LINES_SQL} SELECT l_orderkey, CAST(k // 2 AS VARCHAR) AS json_key, count(*) AS copies FROM lines
    GROUP BY ALL HAVING count(*) > 1""",
)
def p15_colliding_keys(spark, sf):
    """Keys that differ as numbers of two types and are equal as strings."""
    lines = X.table(spark, sf, "lineitem").select("l_orderkey", F.floor(F.col("l_linenumber") / 2).alias("key"))
    return colliding_keys(lines, ["l_orderkey"], "key")


@query(
    "v2_build_missing",
    f"""WITH {S.GALLERY} SELECT id, {S.q("list_sum(v)")} AS total_q, {S.seed("id", "'bank'")} % 3 = 0 AS reused FROM gallery""",
)
def v2_build_missing(spark, sf):
    gallery = X.gallery(spark, sf).select("id", "direction")
    total = quantise(F.aggregate("direction", F.lit(0.0), lambda a, x: a + x)).alias("total_q")

    def encode(rows):
        return rows.join(gallery, "id").select("id", total)

    in_bank = stable_seed(F.col("id"), "bank") % 3 == 0
    bank = encode(gallery.select("id").filter(in_bank))
    return provenance.build_missing(gallery.select("id"), bank, encode)


@query(
    "w2_lexical_rank",
    f"""WITH {S.PAIRS}, t AS (SELECT id, substr(sha256(id), 1, 12) AS name FROM pairs)
    SELECT name, row_number() OVER (ORDER BY name) - 1 AS lexical_rank FROM t""",
)
def w2_lexical_rank(spark, sf):
    names = X.table(spark, sf, "orders").select(
        F.substring(F.sha2(X.seven(F.col("o_orderkey")), 256), 1, 12).alias("name")
    )
    return index.lexical_rank(names, "name")

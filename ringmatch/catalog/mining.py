"""Signatures, coarse and exact mining, pools and descriptor banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringmatch.catalog import fixtures as X
from ringmatch.catalog import sql as S
from ringmatch.catalog.registry import query
from ringmatch.functions.seeds import stable_seed
from ringmatch.functions.vectors import quantise
from ringmatch.operators import mining
from ringmatch.session import scratch_path
from ringmatch.sources import banks

B, C = X.BINS, X.CHANNELS
FREQUENCIES = 3
COARSE, KEEP = 64, 32


def signature_sql(source: str, key: str) -> str:
    """Unnormalised and normalised signature of ``source(key..., v)`` by explicit Fourier sums."""
    return f"""
fourier AS (
  SELECT {key}, f, d, sum(v[a * 8 + d + 1] * cos(2 * pi() * f * a / 8)) AS re,
         sum(v[a * 8 + d + 1] * sin(2 * pi() * f * a / 8)) AS im
  FROM {source} CROSS JOIN range(3) t(f) CROSS JOIN range(8) u(d) CROSS JOIN range(8) w(a) GROUP BY {key}, f, d),
parts AS (SELECT {key}, f, d, CASE WHEN f = 0 THEN re ELSE sqrt(re * re + im * im) END AS x FROM fourier),
signed AS (SELECT {key}, f, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY {key})), 1e-12::DOUBLE) AS x FROM parts)"""


@query(
    "a15_signature",
    f"""WITH {S.GALLERY},{signature_sql("gallery", "id")}
    SELECT id, CAST(f AS BIGINT) AS frequency, CAST(d AS BIGINT) AS channel, {S.q("x")} AS value_q FROM signed""",
)
def a15_signature(spark, sf):
    signed = mining.with_signature(X.gallery(spark, sf).select("id", "direction"), B, C, FREQUENCIES)
    rows = signed.select("id", F.explode(mining.frequencies(F.col("signature"), C)).alias("s"))
    return rows.select(
        "id",
        F.col("s.frequency").cast("bigint").alias("frequency"),
        F.col("s.channel").cast("bigint").alias("channel"),
        quantise(F.col("s.value")).alias("value_q"),
    )


def _signature_list(source: str, key: str, name: str) -> str:
    body = signature_sql(source, key)
    for old in ("fourier", "parts", "signed"):
        body = body.replace(f"{old} AS", f"{name}_{old} AS").replace(f"FROM {old}", f"FROM {name}_{old}")
    return body + f""",
{name} AS (SELECT {key}, list(x ORDER BY f, d) AS sig FROM {name}_signed GROUP BY {key})"""


COARSE_SQL = f"""{S.QUERIES},{_signature_list("gallery", "id", "gsig")},{_signature_list("queries", "query_id, fov_deg", "qsig")},
coarse AS (
  SELECT query_id, fov_deg, id AS gallery_id, {S.q("list_inner_product(q.sig, g.sig)")} AS coarse_q
  FROM qsig q JOIN gsig g ON g.id <> q.query_id),
screened AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fov_deg ORDER BY coarse_q DESC, gallery_id) AS coarse_rank
                 FROM coarse) WHERE coarse_rank <= {COARSE})"""

POOL_SQL = f"""{COARSE_SQL},{S.ROTATED},
relogits AS (
  SELECT s.query_id, s.fov_deg, gid, k, {S.q("list_inner_product(q.v, rv) / nv")} AS s
  FROM screened s JOIN queries q ON q.query_id = s.query_id AND q.fov_deg = s.fov_deg
  JOIN rotated ON gid = gallery_id),
rescored AS (SELECT query_id, fov_deg, gid, max(s) AS s FROM relogits GROUP BY ALL),
pool AS (
  SELECT fov_deg, query_id AS anchor, rank, gid AS negative, s AS score_q FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, fov_deg ORDER BY s DESC, gid) AS rank FROM rescored)
  WHERE rank <= {KEEP})"""


def coarse(spark, sf):
    queries = mining.with_signature(X.queries(spark, sf), B, C, FREQUENCIES, "valid")
    gallery = mining.with_signature(X.gallery(spark, sf).select("id", "direction"), B, C, FREQUENCIES)
    return mining.coarse_candidates(queries, gallery, FREQUENCIES * C, COARSE, X.sizes(spark, sf))


def pool(spark, sf):
    return mining.mine(
        X.queries(spark, sf), X.gallery(spark, sf), B, C, FREQUENCIES, COARSE, KEEP, X.sizes(spark, sf)
    )


@query("w3_coarse_topk", f"WITH {COARSE_SQL} SELECT * FROM screened")
def w3_coarse_topk(spark, sf):
    return coarse(spark, sf).withColumn("coarse_rank", F.col("coarse_rank").cast("bigint"))


@query("w4_exact_rerank", f"WITH {POOL_SQL} SELECT * FROM pool")
def w4_exact_rerank(spark, sf):
    return pool(spark, sf)


@query(
    "a14_pool_audit",
    f"""WITH {POOL_SQL},
    dented AS (SELECT * FROM pool WHERE NOT ({S.seed("anchor", "'dent'")} % 13 = 0 AND rank = 5)
               UNION ALL SELECT fov_deg, anchor, 5, anchor, score_q FROM pool
               WHERE {S.seed("anchor", "'dent'")} % 13 = 0 AND rank = 5
               AND {S.seed("anchor", "'dent'")} % 2 = 0)
    SELECT fov_deg, anchor, count(*) AS negatives, count(DISTINCT negative) AS distinct_negatives,
           count(*) FILTER (WHERE negative = anchor) AS own_location, CAST(0 AS BIGINT) AS unknown,
           CAST(0 AS BIGINT) AS missing_scores, min(rank) = 1 AND max(rank) = {KEEP} AND count(*) = {KEEP} AS dense
    FROM dented GROUP BY fov_deg, anchor""",
)
def a14_pool_audit(spark, sf):
    rows = pool(spark, sf)
    draw = stable_seed(F.col("anchor"), "dent")
    dent = (draw % 13 == 0) & (F.col("rank") == 5)
    negative = F.when(dent, F.col("anchor")).otherwise(F.col("negative"))
    dented = rows.filter(~dent | (draw % 2 == 0)).withColumn("negative", negative)
    return mining.pool_audit(dented, X.gallery(spark, sf).select("id"), KEEP)


@query(
    "s10_pool_store",
    f"WITH {POOL_SQL} SELECT *, CAST(24 AS BIGINT) AS source_epoch FROM pool",
)
def s10_pool_store(spark, sf):
    path, target = scratch_path(spark, "pools"), scratch_path(spark, "newest")
    pool(spark, sf).write.parquet(scratch := scratch_path(spark, "mined"))
    rows = spark.read.parquet(scratch)
    banks.write_pool(rows.filter("rank <= 4"), path, 16)
    banks.write_pool(rows.filter("rank <= 2"), path, 24)
    banks.write_pool(rows, path, 24)
    return banks.read_pool(spark, target, banks.publish_newest(spark, path, target))


@query(
    "s9_descriptor_bank",
    f"""WITH {S.GALLERY} SELECT id, {S.q("list_sum(v)")} AS total_q FROM gallery""",
)
def s9_descriptor_bank(spark, sf):
    path = scratch_path(spark, "bank")
    gallery = X.gallery(spark, sf).select("id", "direction")
    turned = gallery.withColumn("direction", F.reverse("direction"))
    banks.write_bank(turned.unionByName(gallery), path, "val", "aaaa")
    banks.write_bank(turned, path, "val", "bbbb")
    banks.write_bank(gallery, path, "val", "aaaa")
    total = F.aggregate("direction", F.lit(0.0), lambda a, x: a + x)
    return banks.read_bank(spark, path, "val", "aaaa").select("id", quantise(total).alias("total_q"))

"""Shuffles, batch plans, assignment and epoch lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringmatch.catalog import fixtures as X
from ringmatch.catalog import mining as M
from ringmatch.catalog import sql as S
from ringmatch.catalog.registry import query
from ringmatch.functions.seeds import stable_seed
from ringmatch.operators import batches, index, lookups, mining
from ringmatch.plans.epoch import PlanSettings, hard_rows, plan_epoch

# Epoch ranges, hard-batch shares and refresh epochs of the default run.
STAGES = [
    {"name": "stage_a", "epoch_start": 1, "epoch_end": 8, "hard_batch_fraction": 0.0},
    {"name": "stage_b", "epoch_start": 9, "epoch_end": 16, "hard_batch_fraction": 0.0},
    {"name": "stage_c", "epoch_start": 17, "epoch_end": 48, "hard_batch_fraction": 0.25},
    {"name": "stage_d", "epoch_start": 49, "epoch_end": 56, "hard_batch_fraction": 0.25},
    {"name": "stage_e", "epoch_start": 57, "epoch_end": 64, "hard_batch_fraction": 0.25},
]
REFRESH = (16, 24, 32, 40, 48, 56)
INTERVAL = 8
FOVS = X.CROP_FOVS
SETTINGS = PlanSettings(stages=STAGES, refresh=REFRESH, fovs=FOVS)
POOL_SETTINGS = PlanSettings(stages=STAGES, refresh=REFRESH, fovs=X.BIN_FOVS, rank_range=(1, M.KEEP))

FOV_CASE = "CASE {} WHEN 0 THEN 360 WHEN 1 THEN 180 WHEN 2 THEN 90 ELSE 70 END"


def locations(spark, sf):
    return X.table(spark, sf, "orders").select(X.seven(F.col("o_orderkey")).alias("location"))


def seed_items(epoch):
    return (42, X.DATASET, "train", epoch)


def shuffled_sql(source: str, epoch: int, salt: str, ids: str = "location", name: str = "idx") -> str:
    key = S.seed("42", "'pano'", "'train'", str(epoch), f"'{salt}'", *ids.split(", "))
    return f"(SELECT *, row_number() OVER (ORDER BY {key}, {ids}) - 1 AS {name} FROM {source})"


LOC = f"""
locations AS (SELECT {S.seven('o_orderkey')} AS location FROM orders),
counts AS (SELECT count(*) // 64 AS steps FROM locations)"""


@query("w1_seeded_shuffle", f"WITH {LOC} SELECT location, idx AS shuffle_index FROM {shuffled_sql('locations', 1, 'w1')}")
def w1_seeded_shuffle(spark, sf):
    return index.shuffled_index(locations(spark, sf), [*seed_items(1), "w1"], ["location"])


HARD_EPOCH, NORMAL_EPOCH = 17, 3
ANCHORS_SQL = f"""{LOC},
anchors AS (
  SELECT 'hard' AS kind, idx // 4 AS batch, CAST({FOV_CASE.format("idx % 4")} AS BIGINT) AS fov_deg, location
  FROM {shuffled_sql('locations', HARD_EPOCH, 'hard_anchors')}
  WHERE idx < 4 * (SELECT CAST(round_even(steps * 0.25, 0) AS BIGINT) FROM counts))"""


def hard_count(spark, sf):
    return round(X.table(spark, sf, "orders").count() // 64 * 0.25)


@query("w5_hard_anchors", f"WITH {ANCHORS_SQL} SELECT * FROM anchors")
def w5_hard_anchors(spark, sf):
    anchors = batches.hard_anchors(locations(spark, sf), hard_count(spark, sf), FOVS, seed_items(HARD_EPOCH))
    return anchors.drop("offset")


def normal_sql(epoch: int, source: str, batch_count: str) -> str:
    return f"""
fill AS (
  SELECT 'normal' AS kind, idx // 64 AS batch, CAST({FOV_CASE.format("(idx // 16) % 4")} AS BIGINT) AS fov_deg,
         idx % 16 AS "offset", location
  FROM {shuffled_sql(source, epoch, 'normal_locations')} WHERE idx < 64 * {batch_count})"""


@query(
    "w6_normal_fill",
    f"""WITH {ANCHORS_SQL},
    free AS (SELECT location FROM locations WHERE location NOT IN (SELECT location FROM anchors)),
    {normal_sql(HARD_EPOCH, "free", "(SELECT steps - CAST(round_even(steps * 0.25, 0) AS BIGINT) FROM counts)")}
    SELECT * FROM fill""",
)
def w6_normal_fill(spark, sf):
    hard = hard_count(spark, sf)
    steps = X.table(spark, sf, "orders").count() // 64
    anchors = batches.hard_anchors(locations(spark, sf), hard, FOVS, seed_items(HARD_EPOCH))
    return batches.normal_fill(locations(spark, sf), anchors, steps - hard, 16, FOVS, seed_items(HARD_EPOCH))


def cycle_sql(epoch: int, source: str) -> str:
    key = S.seed("42", "'pano'", "'train'", str(epoch), "kind", "batch", "'fov_cycle'", "fov_deg")
    return f"""
cycles AS (
  SELECT kind, batch, fov_deg, row_number() OVER (PARTITION BY kind, batch ORDER BY {key}, fov_deg) - 1 AS cycle
  FROM (SELECT DISTINCT kind, batch, fov_deg FROM {source})),
placed AS (SELECT r.*, "offset" * 4 + cycle AS position FROM {source} r JOIN cycles USING (kind, batch, fov_deg))"""


PLACED_SQL = f"""{LOC},{normal_sql(NORMAL_EPOCH, "locations", "(SELECT steps FROM counts)")},{cycle_sql(NORMAL_EPOCH, "fill")}"""


def placed(spark, sf):
    steps = X.table(spark, sf, "orders").count() // 64
    fill = batches.normal_fill(locations(spark, sf), None, steps, 16, FOVS, seed_items(NORMAL_EPOCH))
    return batches.interleave(fill, FOVS, seed_items(NORMAL_EPOCH))


@query("w7_fov_interleave", f"WITH {PLACED_SQL} SELECT batch, position, fov_deg, location FROM placed")
def w7_fov_interleave(spark, sf):
    return placed(spark, sf).select("batch", "position", "fov_deg", "location")


@query(
    "w8_batch_schedule",
    f"""WITH {LOC}, c AS (SELECT steps, CAST(round_even(steps * 0.25, 0) AS BIGINT) AS hard FROM counts),
    b AS (SELECT CASE WHEN i < steps - hard THEN 'normal' ELSE 'hard' END AS kind,
                 CASE WHEN i < steps - hard THEN i ELSE i - (steps - hard) END AS batch
          FROM c CROSS JOIN (SELECT row_number() OVER () - 1 AS i FROM locations) WHERE i < steps)
    SELECT * FROM {shuffled_sql('b', HARD_EPOCH, 'batch_schedule', 'kind, batch', 'step')}""",
)
def w8_batch_schedule(spark, sf):
    hard = hard_count(spark, sf)
    steps = X.table(spark, sf, "orders").count() // 64
    return batches.batch_schedule(spark, steps - hard, hard, seed_items(HARD_EPOCH))


PLAN_SQL = f"""{PLACED_SQL},
order_of AS (SELECT * FROM {shuffled_sql("(SELECT DISTINCT kind, batch FROM placed)", NORMAL_EPOCH, 'batch_schedule', 'kind, batch', 'step')}),
plan AS (SELECT CAST({NORMAL_EPOCH} AS BIGINT) AS epoch, step, position, kind, batch, fov_deg, location
         FROM placed JOIN order_of USING (kind, batch))"""


def normal_plan(spark, sf):
    return plan_epoch(locations(spark, sf), NORMAL_EPOCH, SETTINGS)


@query("e4_plan_epoch", f"WITH {PLAN_SQL} SELECT *, 'train' AS orientation_mode FROM plan")
def e4_plan_epoch(spark, sf):
    return normal_plan(spark, sf).drop("source_epoch")


@query(
    "w9_batch_shards",
    f"""WITH {PLAN_SQL} SELECT step, position // 32 AS shard, position % 32 AS place, location, fov_deg FROM plan""",
)
def w9_batch_shards(spark, sf):
    position = F.col("position")
    return normal_plan(spark, sf).select(
        "step", batches.shard(position, 32).alias("shard"), (position % 32).alias("place"), "location", "fov_deg"
    )


@query(
    "w9_manifest_shards",
    """WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
    b AS (SELECT CAST(r AS BIGINT) AS shard, n * r // 7 AS lo, n * (r + 1) // 7 AS hi FROM n CROSS JOIN range(7) t(r))
    SELECT shard, count(*) AS rows, min(i) AS first, max(i) AS last FROM k JOIN b ON i >= lo AND i < hi GROUP BY shard""",
)
def w9_manifest_shards(spark, sf):
    rows = X.table(spark, sf, "orders").count()
    i = F.col("ordinal") - 1
    numbered = X.pairs(spark, sf).select(i.alias("i"), batches.shard_of_index(i, rows, 7).alias("shard"))
    return numbered.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.min("i").alias("first"), F.max("i").alias("last")
    )


@query(
    "a12_fov_buckets",
    f"""WITH {PLAN_SQL} SELECT step, fov_deg, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions,
    string_agg(location, ',' ORDER BY position) AS locations FROM plan GROUP BY step, fov_deg""",
)
def a12_fov_buckets(spark, sf):
    buckets = batches.fov_buckets(normal_plan(spark, sf))
    positions = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return buckets.select(
        "step", "fov_deg", positions.alias("positions"), F.array_join("locations", ",").alias("locations")
    )


@query(
    "a13_plan_audit",
    f"""WITH {PLAN_SQL}, s AS (SELECT step, position // 32 AS shard, count(*) FILTER (WHERE fov_deg = 360) AS a,
      count(*) FILTER (WHERE fov_deg = 180) AS b, count(*) FILTER (WHERE fov_deg = 90) AS c,
      count(*) FILTER (WHERE fov_deg = 70) AS d FROM plan GROUP BY ALL)
    SELECT count(DISTINCT step) AS steps, count(*) AS rows, count(DISTINCT location) AS distinct_locations,
      (SELECT count(*) FROM s WHERE a <> 8 OR b <> 8 OR c <> 8 OR d <> 8) AS unbalanced_shards FROM plan""",
)
def a13_plan_audit(spark, sf):
    return batches.plan_audit(normal_plan(spark, sf), FOVS, 16, shards=2)


@query(
    "a13_quota_counts",
    f"""WITH {PLAN_SQL} SELECT step, position // 16 AS shard, count(*) FILTER (WHERE fov_deg = 360) AS fov_360,
      count(*) FILTER (WHERE fov_deg = 180) AS fov_180, count(*) FILTER (WHERE fov_deg = 90) AS fov_90,
      count(*) FILTER (WHERE fov_deg = 70) AS fov_70 FROM plan GROUP BY ALL""",
)
def a13_quota_counts(spark, sf):
    return batches.quota_counts(normal_plan(spark, sf), FOVS, 4, 64)


@query(
    "p16_sample_requests",
    f"""WITH {ANCHORS_SQL}, k AS (SELECT kind, location FROM anchors UNION ALL
      SELECT 'normal', location FROM locations WHERE location NOT IN (SELECT location FROM anchors))
    SELECT location, CASE kind WHEN 'hard' THEN 'hard_train' ELSE 'train' END AS orientation_mode FROM k""",
)
def p16_sample_requests(spark, sf):
    anchors = batches.hard_anchors(locations(spark, sf), hard_count(spark, sf), FOVS, seed_items(HARD_EPOCH))
    rest = locations(spark, sf).join(anchors, "location", "left_anti")
    rows = anchors.select("kind", "location").unionByName(rest.select(F.lit("normal").alias("kind"), "location"))
    return batches.sample_requests(rows).select("location", "orientation_mode")


def gallery_locations(spark, sf):
    return X.gallery(spark, sf).select(F.col("id").alias("location"))


GALLERY_HARD = "CAST(round_even((SELECT count(*) // 64 FROM embeddings) * 0.25, 0) AS BIGINT)"
BIN_CASE = "CASE {} WHEN 0 THEN 360 WHEN 1 THEN 180 WHEN 2 THEN 90 ELSE 45 END"


def _hard_sql() -> str:
    """Serial greedy: anchors in priority order, each taking its first 15 unused candidates."""
    key = S.seed("42", "'pano'", "'train'", "17", "fov_deg", "location", "'fallback'")
    turns = ",".join(
        f"""
    f{r + 1} AS (SELECT priority, key, j, bits, b AS a, xor(a, {S.seed("key", str(r), "b")} % (1 << bits)) AS b FROM f{r})"""
        for r in range(4)
    )
    place = S.seed("42", "'pano'", "'train'", "17", "a.fov_deg", "a.location", "'pool_order'", "negative")
    return f"""WITH RECURSIVE {M.POOL_SQL},
    locations AS (SELECT id AS location FROM gallery),
    anchors AS (
      SELECT idx // 4 AS batch, idx % 4 AS f, CAST({BIN_CASE.format("idx % 4")} AS BIGINT) AS fov_deg, location,
             (idx % 4) * {GALLERY_HARD} + idx // 4 AS priority
      FROM {shuffled_sql('locations', HARD_EPOCH, 'hard_anchors')} WHERE idx < 4 * {GALLERY_HARD}),
    half AS (SELECT min(k) AS bits FROM range(1, 32) t(k) WHERE pow(4, k) >= (SELECT count(*) FROM locations)),
    f0 AS (SELECT priority, {key} AS key, j, bits, j >> bits AS a, j % (1 << bits) AS b
           FROM anchors CROSS JOIN half CROSS JOIN range((SELECT 1 << 2 * bits FROM half)) t(j)),{turns},
    fallback AS (SELECT priority, list(location ORDER BY j) AS everyone
                 FROM f4 JOIN {shuffled_sql('locations', HARD_EPOCH, 'fallback_order')} o ON o.idx = (a << bits) + b GROUP BY priority),
    pools AS (
      SELECT a.priority, list(negative ORDER BY {place}, negative) AS picks
      FROM anchors a JOIN pool p ON p.fov_deg = a.fov_deg AND p.anchor = a.location GROUP BY a.priority),
    prefs AS (
      SELECT priority, list_concat(picks, everyone) AS picks FROM pools JOIN fallback USING (priority)),
    greedy AS (
      SELECT CAST(-1 AS BIGINT) AS priority, (SELECT list(location) FROM anchors) AS used, CAST([] AS VARCHAR[]) AS taken
      UNION ALL
      SELECT priority, list_concat(used, taken), taken FROM (
        SELECT p.priority, g.used, list_filter(p.picks, lambda x, i: NOT list_contains(g.used, x)
                 AND list_position(p.picks, x) = i)[1:15] AS taken
        FROM greedy g JOIN prefs p ON p.priority = g.priority + 1)),
    neighbours AS (SELECT priority, unnest(taken) AS location, generate_subscripts(taken, 1) AS "offset" FROM greedy WHERE priority >= 0),
    hard AS (
      SELECT 'hard' AS kind, batch, fov_deg, CAST("offset" AS BIGINT) AS "offset", n.location
      FROM neighbours n JOIN anchors USING (priority)
      UNION ALL SELECT 'hard', batch, fov_deg, 0, location FROM anchors)"""


@query("h1_neighbour_assignment", f"""{_hard_sql()} SELECT batch, fov_deg, "offset", location FROM hard""")
def h1_neighbour_assignment(spark, sf):
    rows = X.table(spark, sf, "embeddings").count()
    hard = round(rows // 64 * 0.25)
    assigned = hard_rows(
        gallery_locations(spark, sf), M.pool(spark, sf), hard, POOL_SETTINGS, seed_items(HARD_EPOCH), rows
    )
    return assigned.select("batch", "fov_deg", "offset", "location")


def mined_pool(spark, sf):
    return M.pool(spark, sf).withColumn("source_epoch", F.lit(16).cast("bigint"))


@query(
    "e4_pool_mismatch",
    f"""WITH {M.POOL_SQL}, p AS (SELECT fov_deg, {S.seed("anchor", "'stale'")} % 5 = 0 AND fov_deg = 90 AS stale FROM pool
      WHERE fov_deg <> 45)
    SELECT CAST(f.fov AS BIGINT) AS fov_deg, count(p.fov_deg) AS rows, count(*) FILTER (WHERE stale) AS foreign
    FROM (VALUES (360), (180), (90), (45)) f(fov) LEFT JOIN p ON p.fov_deg = f.fov GROUP BY 1
    HAVING count(p.fov_deg) = 0 OR count(*) FILTER (WHERE stale) > 0""".replace(" AS foreign", ' AS "foreign"'),
)
def e4_pool_mismatch(spark, sf):
    stale = (stable_seed(F.col("anchor"), "stale") % 5 == 0) & (F.col("fov_deg") == 90)
    pool = M.pool(spark, sf).filter("fov_deg <> 45").withColumn("source_epoch", F.when(stale, 8).otherwise(16))
    return mining.pool_mismatch(pool, 16, X.BIN_FOVS)


@query(
    "e3_missing_anchors",
    f"""WITH {S.GALLERY} SELECT CAST(180 AS BIGINT) AS fov_deg, id AS anchor FROM gallery WHERE {S.seed("id", "'lost'")} % 7 = 0""",
)
def e3_missing_anchors(spark, sf):
    lost = (stable_seed(F.col("anchor"), "lost") % 7 == 0) & (F.col("fov_deg") == 180)
    return mining.missing_anchors(M.pool(spark, sf).filter(~lost), X.gallery(spark, sf).select("id"), X.BIN_FOVS)


@query(
    "e4_plan_epoch_hard_audit",
    f"""WITH c AS (SELECT count(*) // 64 AS steps FROM embeddings)
    SELECT steps, steps * 64 AS rows, steps * 64 AS distinct_locations, CAST(0 AS BIGINT) AS unbalanced_shards FROM c""",
)
def e4_plan_epoch_hard_audit(spark, sf):
    plan = plan_epoch(gallery_locations(spark, sf), HARD_EPOCH, POOL_SETTINGS, mined_pool(spark, sf))
    return batches.plan_audit(plan, X.BIN_FOVS, 16, shards=2)


def _hard_plan_sql() -> str:
    fill = normal_sql(HARD_EPOCH, "free", f"((SELECT count(*) // 64 FROM embeddings) - {GALLERY_HARD})")
    schedule = shuffled_sql("(SELECT DISTINCT kind, batch FROM placed)", HARD_EPOCH, "batch_schedule", "kind, batch", "step")
    return f"""{_hard_sql()},
    free AS (SELECT location FROM locations WHERE location NOT IN (SELECT location FROM hard)),
    {fill.replace("ELSE 70", "ELSE 45")},
    everything AS (SELECT * FROM hard UNION ALL SELECT * FROM fill),{cycle_sql(HARD_EPOCH, "everything")},
    order_of AS (SELECT * FROM {schedule})
    SELECT CAST({HARD_EPOCH} AS BIGINT) AS epoch, step, position, kind, batch, fov_deg, location,
           CAST(CASE kind WHEN 'hard' THEN 16 ELSE -1 END AS BIGINT) AS source_epoch,
           CASE kind WHEN 'hard' THEN 'hard_train' ELSE 'train' END AS orientation_mode
    FROM placed JOIN order_of USING (kind, batch)"""


@query("e4_plan_epoch_hard", _hard_plan_sql())
def e4_plan_epoch_hard(spark, sf):
    plan = plan_epoch(gallery_locations(spark, sf), HARD_EPOCH, POOL_SETTINGS, mined_pool(spark, sf))
    return plan.fillna(-1, ["source_epoch"])


EPOCH_SQL = "e AS (SELECT event_id, event_id % 70 + 1 AS epoch FROM events)"
STAGE_VALUES = "(VALUES " + ", ".join(
    f"('{s['name']}', {s['epoch_start']}, {s['epoch_end']}, {s['hard_batch_fraction']})" for s in STAGES
) + ") s(stage, lo, hi, share)"
REFRESH_VALUES = "(VALUES " + ", ".join(f"({r})" for r in REFRESH) + ") r(refresh)"


def epochs(spark, sf):
    return X.table(spark, sf, "events").select("event_id", (F.col("event_id") % 70 + 1).alias("epoch"))


@query(
    "j10_stage_lookup",
    f"""WITH {EPOCH_SQL} SELECT event_id, epoch, coalesce(stage, '') AS stage,
    CAST(CASE WHEN stage IS NULL THEN 0 ELSE 1 END AS BIGINT) AS stage_matches, coalesce(CAST(share * 100 AS BIGINT), 0) AS hard_pct
    FROM e LEFT JOIN {STAGE_VALUES} ON epoch BETWEEN lo AND hi""",
)
def j10_stage_lookup(spark, sf):
    staged = lookups.with_stage(epochs(spark, sf), STAGES)
    return staged.select(
        "event_id",
        "epoch",
        F.coalesce("stage", F.lit("")).alias("stage"),
        "stage_matches",
        F.coalesce((F.col("hard_batch_fraction") * 100).cast("bigint"), F.lit(0)).alias("hard_pct"),
    )


@query(
    "j11_refresh_asof",
    f"""WITH {EPOCH_SQL} SELECT event_id, epoch, coalesce((SELECT max(refresh) FROM {REFRESH_VALUES} WHERE refresh < epoch), -1)::BIGINT
    AS source_epoch FROM e""",
)
def j11_refresh_asof(spark, sf):
    source = F.coalesce(lookups.latest_before(F.col("epoch"), REFRESH), F.lit(-1))
    return epochs(spark, sf).withColumn("source_epoch", source.cast("bigint"))


@query(
    "w11_cadence",
    f"""WITH {EPOCH_SQL} SELECT event_id, epoch, epoch % 8 = 0 AS validate, epoch IN (16, 24, 32, 40, 48, 56) AS refresh FROM e
    WHERE epoch % 8 = 0 OR epoch IN (16, 24, 32, 40, 48, 56)""",
)
def w11_cadence(spark, sf):
    epoch = F.col("epoch")
    flagged = epochs(spark, sf).withColumns(
        {"validate": lookups.validation_due(epoch, INTERVAL), "refresh": lookups.refresh_due(epoch, REFRESH)}
    )
    return flagged.filter("validate OR refresh")

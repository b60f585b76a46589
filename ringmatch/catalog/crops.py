"""Seeds, crop plans, FoV geometry and recorded schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringmatch.catalog import fixtures as X
from ringmatch.catalog import sql as S
from ringmatch.catalog.registry import query
from ringmatch.functions import crops
from ringmatch.functions.seeds import UINT32_RANGE, bernoulli, stable_seed, uniform
from ringmatch.functions.vectors import circular_slice, pad_directions, quantise, valid_mask
from ringmatch.operators import fingerprints, schedules
from ringmatch.session import scratch_path

W = X.PANORAMA_WIDTH
GEOMETRY_FOVS = (360, 180, 90, 70, 270, 120)
# Registered input width, patch columns and directions per FoV. Fixed values.
REGISTERED = {360: (756, 54, 36), 180: (378, 27, 18), 90: (196, 14, 9), 70: (154, 11, 7)}

IDS = f"ids AS (SELECT {S.seven('o_orderkey')} AS id FROM orders)"
VAL = f"""{S.PAIRS},
val AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS loc_idx, id AS query_id FROM pairs WHERE bucket = 0)"""


def fov_values(fovs) -> str:
    return "(VALUES " + ", ".join(f"({f})" for f in fovs) + ") f(fov)"


def ids(spark, sf):
    return X.table(spark, sf, "orders").select(X.seven(F.col("o_orderkey")).alias("id"))


def ids_fovs(spark, sf, fovs=X.CROP_FOVS):
    return ids(spark, sf).withColumn("fov_deg", F.explode(X.fov_list(fovs)))


@query("p4_stable_seed", f"WITH {IDS} SELECT id, {S.seed('42', 'id', chr(39) + 'x' + chr(39))} AS seed FROM ids")
def p4_stable_seed(spark, sf):
    return ids(spark, sf).select("id", stable_seed(42, F.col("id"), "x").alias("seed"))


@query(
    "p5_orientation_pixels",
    f"""WITH {IDS}, s AS (SELECT id, {S.seed('id')} AS u FROM ids),
    c AS (SELECT *, u * {W} // {UINT32_RANGE} AS center_px FROM s),
    b AS (SELECT *, (center_px * {UINT32_RANGE} + {W - 1}) // {W} AS smallest_u32 FROM c)
    SELECT id, center_px, smallest_u32, smallest_u32 * {W} // {UINT32_RANGE} AS again_px FROM b""",
)
def p5_orientation_pixels(spark, sf):
    center = crops.orientation_to_center_px(stable_seed(F.col("id")), W)
    rows = ids(spark, sf).withColumn("center_px", center)
    rows = rows.withColumn("smallest_u32", crops.center_px_to_orientation(F.col("center_px"), W))
    return rows.withColumn("again_px", crops.orientation_to_center_px(F.col("smallest_u32"), W))


def seeded_crop_sql(salt: str, epoch: int) -> str:
    seed = S.seed("42", "'pano'", "'train'", str(epoch), "id", f"'{salt}'")
    return f"""WITH {IDS}, s AS (SELECT id, {seed} AS u FROM ids)
    SELECT id, CAST(fov AS BIGINT) AS fov_deg, u AS orientation_u32, u * {W} // {UINT32_RANGE} AS center_px,
           CAST({W} * fov // 360 AS BIGINT) AS width, CAST({W} AS BIGINT) AS panorama_width
    FROM s CROSS JOIN {fov_values(X.CROP_FOVS)}"""


@query("p6_train_crop", seeded_crop_sql("train_orientation", 3))
def p6_train_crop(spark, sf):
    crop = crops.train_crop(X.SEED, 3, F.col("id"), F.col("fov_deg"), W, X.DATASET)
    return ids_fovs(spark, sf).select("id", "fov_deg", crop.alias("c")).select("id", "fov_deg", "c.*")


@query("p7_hard_mining_crop", seeded_crop_sql("hard_mining_orientation", 16))
def p7_hard_mining_crop(spark, sf):
    crop = crops.hard_mining_crop(X.SEED, 16, F.col("id"), F.col("fov_deg"), W, X.DATASET)
    return ids_fovs(spark, sf).select("id", "fov_deg", crop.alias("c")).select("id", "fov_deg", "c.*")


@query(
    "p7_shared_orientation",
    f"""WITH {IDS} SELECT id, CAST(4 AS BIGINT) AS fovs, CAST(1 AS BIGINT) AS orientations FROM ids""",
)
def p7_shared_orientation(spark, sf):
    crop = crops.hard_mining_crop(X.SEED, 16, F.col("id"), F.col("fov_deg"), W, X.DATASET)
    rows = ids_fovs(spark, sf).select("id", crop["orientation_u32"].alias("u"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("fovs"), F.count_distinct("u").alias("orientations"))


RANDOM_CROP_SQL = f"""{VAL},
rolls AS (SELECT query_id, CAST(fov AS BIGINT) AS fov_deg, {S.seed("'draw-1'", "query_id", "fov")} % 360 AS roll
          FROM val CROSS JOIN {fov_values(X.CROP_FOVS)}),
starts AS (SELECT *, CAST({W} * fov_deg // 360 AS BIGINT) AS width, ({W} - roll * {W} // 360) % {W} AS start FROM rolls),
crops AS (SELECT *, (start + width // 2) % {W} AS center_px FROM starts)"""


def val_long(spark, sf):
    wide = schedules.draw_schedule(X.split_ids(spark, sf, "val"), "val", X.CROP_FOVS, "draw-1")
    return schedules.long_schedule(wide, X.CROP_FOVS)


@query(
    "p8_random_crop",
    f"""WITH {RANDOM_CROP_SQL} SELECT query_id, fov_deg, roll AS roll_deg, center_px, width,
    (center_px * {UINT32_RANGE} + {W - 1}) // {W} AS orientation_u32 FROM crops""",
)
def p8_random_crop(spark, sf):
    crop = crops.random_crop(F.col("roll_deg"), F.col("fov_deg"), W)
    rows = val_long(spark, sf).select("query_id", "fov_deg", "roll_deg", crop.alias("c"))
    return rows.select("query_id", "fov_deg", "roll_deg", "c.center_px", "c.width", "c.orientation_u32")


@query(
    "p9_crop_interval",
    f"""WITH {RANDOM_CROP_SQL} SELECT query_id, fov_deg, center_px - width // 2 AS left_px,
    center_px + (width + 1) // 2 AS right_px,
    {S.q(f"360.0::DOUBLE * ((center_px * {UINT32_RANGE} + {W - 1}) // {W}) / {UINT32_RANGE}.0::DOUBLE")} AS heading_q
    FROM crops""",
)
def p9_crop_interval(spark, sf):
    crop = crops.random_crop(F.col("roll_deg"), F.col("fov_deg"), W)
    rows = val_long(spark, sf).select("query_id", "fov_deg", crop.alias("c"))
    left, right = crops.crop_interval(F.col("c.center_px"), F.col("c.width"))
    heading = quantise(crops.heading_deg(F.col("c.orientation_u32")))
    return rows.select(
        "query_id", "fov_deg", left.alias("left_px"), right.alias("right_px"), heading.alias("heading_q")
    )


@query(
    "p10_fov_geometry",
    f"""WITH {IDS}, g AS (SELECT id AS query_id, CAST(fov AS BIGINT) AS fov_deg, CAST({W} * fov // 360 AS BIGINT) AS physical
        FROM ids CROSS JOIN {fov_values(GEOMETRY_FOVS)}),
    a AS (SELECT *, CASE fov_deg WHEN 360 THEN 756 WHEN 180 THEN 378 WHEN 90 THEN 196 WHEN 70 THEN 154
          ELSE (physical + 13) // 14 * 14 END AS aligned FROM g)
    SELECT query_id, fov_deg, physical AS physical_crop_width, aligned AS aligned_input_width,
           aligned // 14 AS source_patch_columns, 36 * fov_deg // 360 AS target_direction_bins FROM a""",
)
def p10_fov_geometry(spark, sf):
    sizes = crops.fov_sizes(GEOMETRY_FOVS, W, 14, 36, REGISTERED)
    rows = ids_fovs(spark, sf, GEOMETRY_FOVS).withColumnRenamed("id", "query_id")
    geometry = crops.fov_geometry(F.col("fov_deg"), W, 14, 36, {f: s.input_px for f, s in sizes.items()})
    return rows.select("query_id", "fov_deg", *[c.alias(n) for n, c in geometry.items()])


@query(
    "p11_circular_slice",
    f"""WITH {S.GALLERY}, s AS (SELECT id, v, {S.seed("id", "'slice'")} % 64 AS center, 5 + vec_id % 20 AS width FROM gallery)
    SELECT id, CAST(k AS BIGINT) AS position, {S.q("v[((center - width // 2 + k + 64) % 64) + 1]")} AS value_q
    FROM s CROSS JOIN range(30) t(k) WHERE k < width""",
)
def p11_circular_slice(spark, sf):
    center = stable_seed(F.col("id"), "slice") % 64
    part = circular_slice(F.col("direction"), center, F.col("vec_id") % 20 + 5)
    rows = X.gallery(spark, sf).select("id", F.posexplode(part).alias("position", "value"))
    return rows.select("id", F.col("position").cast("bigint").alias("position"), quantise(F.col("value")).alias("value_q"))


@query(
    "p12_keyed_draws",
    f"""WITH {IDS} SELECT id, {S.seed("42", "id", "'flip'")} / 4294967296.0::DOUBLE < 0.3::DOUBLE AS flipped,
    {S.q("0.5::DOUBLE + 1.5::DOUBLE * (" + S.seed("42", "id", "'scale'") + " / 4294967296.0::DOUBLE)")} AS scale_q FROM ids""",
)
def p12_keyed_draws(spark, sf):
    return ids(spark, sf).select(
        "id",
        bernoulli(0.3, 42, F.col("id"), "flip").alias("flipped"),
        quantise(uniform(0.5, 2.0, 42, F.col("id"), "scale")).alias("scale_q"),
    )


@query(
    "p13_pad_and_mask",
    f"""WITH {S.GALLERY}, s AS (SELECT id, v, vec_id % 8 + 1 AS bins FROM gallery)
    SELECT id, CAST(a AS BIGINT) AS bin, a < bins AS valid,
           {S.q("CASE WHEN a < bins THEN list_sum(v[a * 8 + 1:a * 8 + 8]) ELSE 0.0::DOUBLE END")} AS total_q
    FROM s CROSS JOIN range(8) t(a)""",
)
def p13_pad_and_mask(spark, sf):
    bins = (F.col("vec_id") % 8 + 1).cast("int")
    padded = X.gallery(spark, sf).select(
        "id",
        pad_directions(F.slice("direction", F.lit(1), bins * 8), 8, 8).alias("p"),
        F.posexplode(valid_mask(bins, 8)).alias("bin", "valid"),
    )
    total = F.aggregate(F.slice("p", F.col("bin") * 8 + 1, F.lit(8)), F.lit(0.0), lambda a, x: a + x)
    return padded.select("id", F.col("bin").cast("bigint").alias("bin"), "valid", quantise(total).alias("total_q"))


WIDE_SQL = f"""{VAL},
schedule AS (SELECT loc_idx, 'val' AS split, query_id, """ + ", ".join(
    f"CAST({S.seed(chr(39) + 'draw-1' + chr(39), 'query_id', str(f))} % 360 AS BIGINT) AS roll_angle_deg_{f}"
    for f in X.CROP_FOVS
) + " FROM val)"


def wide(spark, sf):
    return schedules.draw_schedule(X.split_ids(spark, sf, "val"), "val", X.CROP_FOVS, "draw-1")


def as_bigint(schedule):
    return schedule.withColumns({c: F.col(c).cast("bigint") for c in schedule.columns if c.startswith("roll_angle")})


@query("u4_schedule_draw", f"WITH {WIDE_SQL} SELECT * FROM schedule")
def u4_schedule_draw(spark, sf):
    return as_bigint(wide(spark, sf))


@query("s8_schedule_replay", f"WITH {WIDE_SQL} SELECT * FROM schedule")
def s8_schedule_replay(spark, sf):
    path = scratch_path(spark, "schedule")
    wide(spark, sf).write.parquet(path)
    queries = X.split_ids(spark, sf, "val")
    return as_bigint(schedules.replay_schedule(spark, path, queries, "val", X.CROP_FOVS))


@query(
    "j9_schedule_violations",
    f"""WITH {WIDE_SQL},
    bad AS (SELECT * REPLACE (CASE WHEN {S.seed("query_id", "'angle'")} % 97 = 0 THEN roll_angle_deg_90 + 360
            ELSE roll_angle_deg_90 END AS roll_angle_deg_90,
            CASE WHEN {S.seed("query_id", "'split'")} % 83 = 0 THEN 'test' ELSE split END AS split)
            FROM schedule WHERE {S.seed("query_id", "'drop'")} % 89 <> 0)
    SELECT loc_idx, query_id, 'missing' AS reason FROM val WHERE query_id NOT IN (SELECT query_id FROM bad)
    UNION ALL SELECT loc_idx, query_id, 'split' FROM bad WHERE split <> 'val'
    UNION ALL SELECT loc_idx, query_id, 'angle_90' FROM bad WHERE roll_angle_deg_90 > 359""",
)
def j9_schedule_violations(spark, sf):
    id_ = F.col("query_id")
    angle = F.col("roll_angle_deg_90")
    bad = wide(spark, sf).filter(stable_seed(id_, "drop") % 89 != 0)
    bad = bad.withColumn("roll_angle_deg_90", F.when(stable_seed(id_, "angle") % 97 == 0, angle + 360).otherwise(angle))
    bad = bad.withColumn("split", F.when(stable_seed(id_, "split") % 83 == 0, "test").otherwise(F.col("split")))
    return schedules.schedule_violations(bad, X.split_ids(spark, sf, "val"), "val", X.CROP_FOVS)


@query(
    "a4_schedule_hash",
    f"""WITH {WIDE_SQL}
    SELECT count(*) AS rows, 'sha256_canonical_json' AS algorithm,
      sha256('{{"protocol":"independent_random_roll_then_left_crop_v1","query_ids":[' ||
        string_agg('"' || query_id || '"', ',' ORDER BY loc_idx) || '],"roll_angles_deg":{{"180":[' ||
        string_agg(roll_angle_deg_180::VARCHAR, ',' ORDER BY loc_idx) || '],"360":[' ||
        string_agg(roll_angle_deg_360::VARCHAR, ',' ORDER BY loc_idx) || '],"70":[' ||
        string_agg(roll_angle_deg_70::VARCHAR, ',' ORDER BY loc_idx) || '],"90":[' ||
        string_agg(roll_angle_deg_90::VARCHAR, ',' ORDER BY loc_idx) || ']}},"split":"val"}}') AS fingerprint
    FROM schedule""",
)
def a4_schedule_hash(spark, sf):
    return fingerprints.schedule_fingerprint(wide(spark, sf), "val", X.CROP_FOVS, fingerprints.EXACT)

import hashlib

import pytest
from pyspark.sql import functions as F

from ringmatch.functions import crops
from ringmatch.functions.paths import file_stem, fill_template, is_relative_inside, numeric_id
from ringmatch.functions.seeds import bernoulli, stable_seed
from ringmatch.functions.vectors import circular_slice


def seed(*items):
    payload = "::".join(map(str, items)).encode()
    return int.from_bytes(hashlib.sha256(payload).digest()[:8], "little") % 2**32


def test_stable_seed_matches_the_digest_definition(spark):
    rows = spark.range(300).select("id", stable_seed(42, "train", F.col("id"), "x").alias("s")).collect()
    assert all(r.s == seed(42, "train", r.id, "x") for r in rows)


def test_pixels_survive_the_round_trip_through_a_heading(spark):
    u = crops.center_px_to_orientation(F.col("id"), 756)
    rows = spark.range(756).select("id", crops.orientation_to_center_px(u, 756).alias("px")).collect()
    assert all(r.id == r.px for r in rows)


def test_rolled_crops_begin_where_a_rolled_list_begins(spark):
    """Against Python: turn the list of pixels to the right by the roll, then take a crop's width from its front."""
    width = 504
    rows = spark.createDataFrame([(r, f) for r in range(0, 360, 23) for f in (360, 225, 100, 45, 5)], "roll int, fov bigint")
    crop = crops.random_crop(F.col("roll"), F.col("fov"), width)
    left, right = crops.crop_interval(F.col("c.center_px"), F.col("c.width"))
    for r in rows.select("roll", "fov", crop.alias("c")).select("roll", "fov", left.alias("l"), right.alias("r")).collect():
        pixels = list(range(width))
        by = r.roll * width // 360
        turned = pixels[-by:] + pixels[:-by] if by else pixels
        assert [x % width for x in range(r.l, r.r)] == turned[: r.fov * width // 360]


def test_training_crops_share_a_center_and_change_with_the_epoch(spark):
    df = spark.createDataFrame([("q1", f) for f in (360, 180, 90, 70)], "q string, fov bigint")
    a = crops.train_crop(42, 3, F.col("q"), F.col("fov"), 756, "pano")
    b = crops.train_crop(42, 4, F.col("q"), F.col("fov"), 756, "pano")
    h = crops.hard_mining_crop(42, 3, F.col("q"), F.col("fov"), 756, "pano")
    rows = df.select(a["center_px"].alias("a"), b["center_px"].alias("b"), h["center_px"].alias("h")).distinct().collect()
    assert len(rows) == 1 and len({rows[0].a, rows[0].b, rows[0].h}) > 1
    assert rows[0].a == seed(42, "pano", "train", 3, "q1", "train_orientation") * 756 // 2**32


def test_widths_that_are_not_whole_pixels_are_null(spark):
    row = spark.range(1).select(crops.crop_width(F.lit(75), 756).alias("w"), crops.crop_width(F.lit(70), 756).alias("v")).first()
    assert row.w is None and row.v == 147


@pytest.mark.parametrize("fovs", [(360, 360), (0,), (361,), (77,), (5,)])
def test_unusable_fov_lists_are_refused(fovs):
    with pytest.raises(ValueError):
        crops.validate_fovs(fovs, 756, 36)


def test_sizes_of_fovs_are_checked_against_the_registered_ones():
    known = {90: (196, 14, 9), 70: (154, 11, 7)}
    sizes = crops.fov_sizes((360, 120, 90, 70), 756, 14, 36, known)
    assert sizes[90] == (189, 196, 14, 9) and sizes[120] == (252, 252, 18, 12) and sizes[70].patch_columns == 11
    for wrong in ({90: (196, 13, 9)}, {90: (196, 14, 8)}, {90: (195, 14, 9)}, {90: (210, 14, 9)}):
        with pytest.raises(ValueError):
            crops.fov_sizes((90,), 756, 14, 36, wrong)


def test_circular_slice_wraps(spark):
    arr = F.array(*[F.lit(i) for i in range(10)])
    df = spark.createDataFrame([(0, 4), (9, 5), (5, 10)], "c bigint, w bigint")
    rows = df.select("c", "w", circular_slice(arr, F.col("c"), F.col("w")).alias("s")).collect()
    for r in rows:
        assert r.s == [(r.c - r.w // 2 + k) % 10 for k in range(r.w)]


def test_paths(spark):
    df = spark.createDataFrame(
        [("a/b/0000001.jpg",), ("0000001",), ("a/000001.jpg",), ("a/0000001.tar.gz",), ("/x/0000001.jpg",), ("a/../0000002.jpg",)],
        "p string",
    )
    rows = df.select("p", numeric_id(F.col("p")).alias("id"), file_stem(F.col("p")).alias("stem"), is_relative_inside(F.col("p")).alias("ok")).collect()
    assert [r.id for r in rows] == ["0000001", "0000001", None, None, "0000001", "0000002"]
    assert rows[3].stem == "0000001.tar"
    assert [r.ok for r in rows] == [True, True, True, True, False, False]
    assert df.limit(1).select(fill_template("{r}/s/{q}_g.jpg", r=F.lit("v"), q=F.lit("7"))).first()[0] == "v/s/7_g.jpg"


def test_keyed_coin_has_its_probability(spark):
    share = spark.range(20_000).select(F.avg(bernoulli(0.3, 1, F.col("id")).cast("double"))).first()[0]
    assert abs(share - 0.3) < 0.02

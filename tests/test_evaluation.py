"""Evaluation and mining refuse input that would quietly lose queries or anchors."""

import pytest
from pyspark.sql import functions as F

from ringmatch.catalog import fixtures as X
from ringmatch.catalog import geometry as CG
from ringmatch.catalog.jobs import SETTINGS
from ringmatch.operators import mining
from ringmatch.plans.evaluate import evaluate_retrieval


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    gallery = X.gallery(spark, sf_dir)
    queries = gallery.select(F.col("vec_id").alias("loc_idx"), F.col("id").alias("query_id"))
    panoramas = gallery.select(F.col("id").alias("query_id"), F.col("direction").alias("tokens"))
    return queries, panoramas, CG.tiles(spark, sf_dir)


def test_missing_and_doubled_sides_are_refused(spark, sides, tmp_path):
    queries, panoramas, tiles = sides
    lost = F.col("query_id") != "0000003"
    cases = {
        "without a panorama": (queries, panoramas.filter(lost), tiles),
        "without a tile": (queries, panoramas, tiles.filter("id <> '0000003'")),
        "tile id occurs twice": (queries, panoramas, tiles.unionByName(tiles.filter("id = '0000003'"))),
        "query id occurs twice": (queries.unionByName(queries.filter(~lost)), panoramas, tiles),
    }
    for message, (q, p, t) in cases.items():
        with pytest.raises(Exception, match=message):
            evaluate_retrieval(spark, p, t, q, "val", SETTINGS, str(tmp_path), "v1", draw_seed="x")


def test_absent_anchors_and_foreign_pools_show(spark):
    pool = spark.createDataFrame([(360, "a", 16), (360, "b", 16), (90, "a", 8)], "fov_deg long, anchor string, source_epoch long")
    locations = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in mining.missing_anchors(pool, locations, (360, 90)).collect()] == [(90, "b")]
    found = {r["fov_deg"]: (r["rows"], r["foreign"]) for r in mining.pool_mismatch(pool, 16, (360, 90, 70)).collect()}
    assert found == {90: (1, 1), 70: (0, 0)}

"""The artifact ledger, banks and pools in it, and tables that are replaced whole."""

import pytest
from pyspark.sql import functions as F

from ringmatch.catalog import fixtures as X
from ringmatch.catalog import geometry as CG
from ringmatch.catalog.jobs import SETTINGS
from ringmatch.plans.evaluate import bank_metadata, ensure_bank, mine_hard_negatives, open_pool, pool_metadata
from ringmatch.plans.epoch import PlanSettings, plan_epoch
from ringmatch.sources.ledger import Ledger, StaleArtifact
from ringmatch.sources.tables import write_once


def failing(df):
    return df.withColumn("id", F.when(F.col("id") >= 0, F.raise_error("no more")).otherwise(F.col("id")).cast("long"))


def test_only_committed_versions_count(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.range(10)
    assert ledger.version("bank", "a") is None and ledger.commits().count() == 0
    with pytest.raises(StaleArtifact, match="nothing is committed"):
        ledger.open("bank", "a", {})
    ledger.publish("bank", "a", rows, {"bins": 8, "hash": "x"})
    with pytest.raises(Exception, match="no more"):
        ledger.publish("bank", "a", failing(rows), {"bins": 8, "hash": "y"})
    assert ledger.open("bank", "a", {"hash": "x", "bins": 8}).count() == 10
    for other, key in (({"bins": 8, "hash": "y"}, "hash: x instead of y"), ({"bins": 8}, "hash"), ({"bins": 8, "hash": "x", "more": 1}, "more")):
        with pytest.raises(StaleArtifact, match=key):
            ledger.open("bank", "a", other)
    ledger.publish("bank", "a", spark.range(3), {"bins": 9})
    assert ledger.version("bank", "a").number == 2 and ledger.open("bank", "a", {"bins": 9}).count() == 3
    path = ledger.version("bank", "a").path
    spark.range(1).write.mode("overwrite").parquet(path)
    with pytest.raises(StaleArtifact, match="rows: 1 instead of 3"):
        ledger.open("bank", "a", {"bins": 9})


def test_banks_are_used_again_only_if_they_fit(spark, sf_dir, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "banks"))
    tiles = CG.tiles(spark, sf_dir)
    some = tiles.filter("id < '0000020'")
    first, store = ensure_bank(spark, some, ledger, "val", "v1", SETTINGS)
    assert first.count() == store.rows == some.count()
    version = lambda: ledger.version("bank", "pano-val").number
    ensure_bank(spark, some, ledger, "val", "v1", SETTINGS)
    assert version() == 1
    whole, store = ensure_bank(spark, tiles, ledger, "val", "v1", SETTINGS)
    assert version() == 2 and whole.count() == store.rows == tiles.count()
    assert whole.join(first, "id").filter(whole["direction"] != first["direction"]).count() == 0
    other, _ = ensure_bank(spark, some, ledger, "val", "v2", SETTINGS)
    assert version() == 3 and other.count() == some.count()
    with pytest.raises(StaleArtifact, match="artifact: v2 instead of v1"):
        ledger.open("bank", "pano-val", bank_metadata(SETTINGS, "v1"))


def test_pools_of_other_settings_are_refused(spark, sf_dir, tmp_path):
    tiles = CG.tiles(spark, sf_dir)
    panoramas = X.gallery(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("direction").alias("tokens"))
    gallery = CG.encoded_tiles(spark, sf_dir)
    pool = mine_hard_negatives(spark, panoramas, gallery, SETTINGS, 16, str(tmp_path), 3, 32, 16, "v1")
    count = tiles.count()
    expected = pool_metadata(SETTINGS, 16, "v1", 3, 32, 16, count)
    root = str(tmp_path / "pools")
    assert open_pool(spark, root, 16, expected).exceptAll(pool).count() == 0
    for change in ({"artifact": "v2"}, {"coarse_keep": 64}, {"fovs": "360"}, {"locations": count + 1}):
        with pytest.raises(StaleArtifact, match=next(iter(change))):
            open_pool(spark, root, 16, expected | change)
    with pytest.raises(StaleArtifact, match="nothing is committed"):
        open_pool(spark, root, 24, expected)
    stages = [{"name": "a", "epoch_start": 1, "epoch_end": 20, "hard_batch_fraction": 0.25}]
    settings = PlanSettings(stages=stages, refresh=(16,), fovs=SETTINGS.fovs, per_fov=4, rank_range=(1, 16))
    locations = tiles.select(F.col("id").alias("location"))
    plan = plan_epoch(locations, 17, settings, pool_root=root, pool_metadata=expected)
    assert plan.filter("kind = 'hard' AND source_epoch = 16").count() > 0
    with pytest.raises(StaleArtifact, match="seed"):
        plan_epoch(locations, 17, settings, pool_root=root, pool_metadata=expected | {"seed": 7})


def test_a_failing_replacement_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    write_once(spark.range(5), path)
    with pytest.raises(FileExistsError):
        write_once(spark.range(6), path)
    with pytest.raises(Exception, match="no more"):
        write_once(failing(spark.range(6)), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5
    # The new rows may come from the old table.
    write_once(spark.read.parquet(path).selectExpr("id", "id % 2 AS part"), path, overwrite=True, partition_by=("part",))
    assert spark.read.parquet(path).filter("part = 0").count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["table"]

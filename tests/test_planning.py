import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ringmatch.functions.seeds import keyed_permutation, permutation_bits
from ringmatch.operators import assignment, batches, index, lookups, schedules
from ringmatch.plans.epoch import PlanSettings, check_plan, plan_epoch

ITEMS = (42, "pano", "train", 17)


def seed(*items):
    return int.from_bytes(hashlib.sha256("::".join(map(str, items)).encode()).digest()[:4], "little")


def own_shuffle(key, count):
    """Every number below ``count`` once, in the order that belongs to the key."""
    bits = permutation_bits(count)
    for place in range(4**bits):
        a, b = place >> bits, place % 2**bits
        for turn in range(4):
            a, b = b, a ^ seed(key, turn, b) % 2**bits
        if a * 2**bits + b < count:
            yield a * 2**bits + b


def serial_greedy(anchors, pool, locations, need, low, high):
    """One anchor after the other, first free candidates of its shuffled pool, then its own shuffle of all."""
    everyone = sorted(locations, key=lambda x: (seed(*ITEMS, "fallback_order", x), x))
    used = {a[2] for a in anchors}
    out = {}
    for priority, fov, anchor in sorted(anchors):
        picks = [n for r, n in pool.get((fov, anchor), ()) if low <= r <= high]
        picks.sort(key=lambda n: (seed(*ITEMS, fov, anchor, "pool_order", n), n))
        fallback = (everyone[i] for i in own_shuffle(seed(*ITEMS, fov, anchor, "fallback"), len(everyone)))
        taken = []
        for c in itertools.chain(picks, fallback):
            if c not in used:
                used.add(c)
                taken.append(c)
                if len(taken) == need:
                    break
        out[priority] = taken
    return out


@pytest.mark.parametrize("count", [1, 2, 3, 16, 17, 500])
def test_keyed_permutations_are_one_to_one(spark, count):
    bits = permutation_bits(count)
    assert count <= 4**bits < max(4 * count, 5)
    rows = spark.range(4**bits).crossJoin(spark.range(3).withColumnRenamed("id", "key"))
    got = rows.select("id", "key", keyed_permutation(F.col("id"), F.col("key"), bits).alias("x")).collect()
    orders = [[r.x for r in sorted(got, key=lambda r: r.id) if r.key == k] for k in range(3)]
    for k, order in enumerate(orders):
        assert sorted(order) == list(range(4**bits))
        assert [x for x in order if x < count] == list(own_shuffle(k, count))
    assert count < 17 or orders[0] != orders[1]


def test_ten_thousand_anchors_without_a_pool(spark):
    """All neighbours come from the fallback; the last anchors find two thirds of all locations taken."""
    count, need, size = 10_000, 3, 60_000
    locations = [f"l{i:05d}" for i in range(size)]
    anchors = [(p, 360, locations[(7 * p) % size]) for p in range(count)]
    anchor_df = spark.createDataFrame(anchors, "priority bigint, fov_deg bigint, location string")
    none = spark.createDataFrame([], "priority bigint, place bigint, candidate string")
    location_df = spark.createDataFrame([(x,) for x in locations], "location string")
    found = {}
    for r in assignment.assign_neighbours(anchor_df, none, location_df, need, 0, ITEMS, size).collect():
        found.setdefault(r.priority, {})[r.offset] = r.location
    want = serial_greedy(anchors, {}, locations, need, 1, 0)
    assert {p: [held[k] for k in sorted(held)] for p, held in found.items()} == want


@pytest.mark.parametrize("case", range(4))
def test_rounds_equal_the_serial_greedy(spark, case):
    rng = random.Random(case)
    size, need, width = (80, 80, 80, 28)[case], 3, 8
    locations = [f"l{i:03d}" for i in range(size)]
    count = (10, 15, 18, 7)[case]  # the last one uses every location
    popular = locations[:12]
    anchors = [(p, (360, 90)[p % 2], a) for p, a in enumerate(rng.sample(locations, count))]
    pool = {}
    for _, fov, a in anchors:
        base = popular if case % 2 else locations
        others = [x for x in base if x != a]
        pool[(fov, a)] = list(enumerate(rng.sample(others, min(width, len(others))), start=1))
    rows = [(f, a, r, n) for (f, a), ns in pool.items() for r, n in ns]
    anchor_df = spark.createDataFrame(anchors, "priority bigint, fov_deg bigint, location string")
    pool_df = spark.createDataFrame(rows, "fov_deg bigint, anchor string, rank int, negative string")
    location_df = spark.createDataFrame([(x,) for x in locations], "location string")
    preferences = assignment.shuffled_preferences(anchor_df, pool_df, (1, width), ITEMS)
    got = assignment.assign_neighbours(anchor_df, preferences, location_df, need, width, ITEMS, size)
    found = {}
    for r in got.orderBy("priority", "offset").collect():
        found.setdefault(r.priority, []).append(r.location)
    assert found == serial_greedy(anchors, pool, locations, need, 1, width)


def test_too_few_locations_are_reported(spark):
    anchors = spark.createDataFrame([(0, 360, "a"), (1, 360, "b")], "priority bigint, fov_deg bigint, location string")
    prefs = spark.createDataFrame([(0, 1, "c"), (1, 1, "c")], "priority bigint, place bigint, candidate string")
    locations = spark.createDataFrame([(x,) for x in "abcd"], "location string")
    with pytest.raises(RuntimeError, match="cannot be given"):
        assignment.assign_neighbours(anchors, prefs, locations, 2, 1, ITEMS, 4)


STAGES = [
    {"name": "a", "epoch_start": 1, "epoch_end": 8, "hard_batch_fraction": 0.0},
    {"name": "b", "epoch_start": 9, "epoch_end": 20, "hard_batch_fraction": 0.25},
]


@pytest.fixture(scope="module")
def settings():
    return PlanSettings(stages=STAGES, refresh=(8, 16), fovs=(360, 180, 90, 70), per_fov=4, rank_range=(1, 8))


@pytest.fixture(scope="module")
def plan_inputs(spark):
    rng = random.Random(1)
    names = [f"l{i:03d}" for i in range(170)]
    locations = spark.createDataFrame([(n,) for n in names], "location string")
    rows = [(f, a, r, n) for f in (360, 180, 90, 70) for a in names for r, n in enumerate(rng.sample([x for x in names if x != a], 8), 1)]
    pool = spark.createDataFrame(rows, "fov_deg bigint, anchor string, rank int, negative string")
    return locations, pool.withColumn("source_epoch", F.lit(16).cast("bigint"))


@pytest.mark.parametrize("epoch,hard", [(3, 0), (17, 2)])
def test_plans_are_balanced_and_never_reuse_a_location(spark, settings, plan_inputs, epoch, hard):
    locations, pool = plan_inputs
    plan = plan_epoch(locations, epoch, settings, pool)
    rows = plan.collect()
    frame = spark.createDataFrame(rows, plan.schema)
    check_plan(frame, 10, settings, shards=2)
    assert len({r.batch for r in rows if r.kind == "hard"}) == hard
    assert {r.orientation_mode for r in rows if r.kind == "hard"} <= {"hard_train"}
    assert {r.source_epoch for r in rows} == ({None, 16} if hard else {None})
    again = {(r.step, r.position, r.location) for r in plan_epoch(locations.repartition(7), epoch, settings, pool.repartition(3)).collect()}
    assert again == {(r.step, r.position, r.location) for r in rows}
    by_step = {}
    for r in rows:
        by_step.setdefault(r.step, {})[r.position] = (r.location, r.fov_deg)
    for whole in by_step.values():
        ordered = [whole[i] for i in range(16)]
        assert [x for s in (0, 1) for x in ordered[s * 8 : s * 8 + 8]] == ordered
        for s in (0, 1):
            assert sorted(f for _, f in ordered[s * 8 : s * 8 + 8]) == sorted((360, 180, 90, 70) * 2)


def test_plan_faults_are_found(spark, settings, plan_inputs):
    plan = plan_epoch(plan_inputs[0], 3, settings)
    twice = plan.withColumn("location", F.when(F.col("step") == 1, F.lit("l000")).otherwise(F.col("location")))
    with pytest.raises(RuntimeError, match="reuses"):
        check_plan(twice, 10, settings)
    with pytest.raises(RuntimeError, match="wrong length"):
        check_plan(plan.filter("step < 9"), 10, settings)
    with pytest.raises(RuntimeError, match="not FoV-balanced"):
        check_plan(plan.withColumn("fov_deg", F.lit(360).cast("bigint")), 10, settings)


def test_epochs_and_geometry_are_checked(spark, settings, plan_inputs):
    locations, _ = plan_inputs
    with pytest.raises(ValueError, match="0 stages"):
        plan_epoch(locations, 99, settings)
    with pytest.raises(FileNotFoundError):
        plan_epoch(locations, 17, settings)
    wrong = PlanSettings(stages=STAGES, refresh=(8,), per_fov=4, stage_steps={"a": 11})
    with pytest.raises(ValueError, match="expects 11 steps"):
        plan_epoch(locations, 1, wrong)
    early = PlanSettings(stages=[{**STAGES[0], "hard_batch_fraction": 0.5}], refresh=(8,), per_fov=4)
    with pytest.raises(ValueError, match="No pool"):
        plan_epoch(locations, 8, early)


def test_foreign_pools_are_refused(spark, settings, plan_inputs):
    locations, pool = plan_inputs
    for foreign in (pool.filter("fov_deg <> 90"), pool.withColumn("source_epoch", F.lit(8).cast("bigint"))):
        with pytest.raises(Exception, match="not that of epoch 16"):
            plan_epoch(locations, 17, settings, foreign)


def test_lookups(spark):
    df = spark.range(0, 25).withColumnRenamed("id", "epoch")
    rows = lookups.with_stage(df, STAGES).withColumn("src", lookups.latest_before(F.col("epoch"), (8, 16))).collect()
    for r in rows:
        assert r.stage == ("a" if 1 <= r.epoch <= 8 else "b" if 9 <= r.epoch <= 20 else None)
        assert r.stage_matches == (1 if 1 <= r.epoch <= 20 else 0)
        assert r.src == (None if r.epoch <= 8 else 8 if r.epoch <= 16 else 16)
    twice = [*STAGES, {"name": "c", "epoch_start": 5, "epoch_end": 6, "hard_batch_fraction": 0.0}]
    assert lookups.with_stage(df, twice).filter("stage_matches = 2 AND stage IS NULL").count() == 2


@pytest.mark.parametrize("rows,shards", [(10, 3), (7, 7), (5, 8), (1000, 6)])
def test_shard_ranges_cover_everything_once(spark, rows, shards):
    bounds = batches.shard_bounds(rows, shards)
    assert [b for lo, hi in bounds for b in range(lo, hi)] == list(range(rows))
    got = spark.range(rows).select("id", batches.shard_of_index(F.col("id"), rows, shards).alias("s")).collect()
    assert all(bounds[r.s][0] <= r.id < bounds[r.s][1] for r in got)


def test_shuffle_is_a_permutation_in_seed_order(spark):
    df = spark.range(500).select(F.concat(F.lit("x"), F.col("id")).alias("k"))
    got = {r.k: r.shuffle_index for r in index.shuffled_index(df, [1, "s"], ["k"]).collect()}
    want = sorted(got, key=lambda k: (seed(1, "s", k), k))
    assert [got[k] for k in want] == list(range(500))


def test_lexical_rank(spark):
    names = [hashlib.md5(str(i).encode()).hexdigest()[:8] for i in range(3000)] + ["é", "Z", "a b"]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(5)
    got = {r.n: r.lexical_rank for r in index.lexical_rank(df, "n", block_rows=100).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(names)


def test_blocked_values_on_one_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.randint(0, 1000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint").repartition(9)
    block = (F.col("i") / 50).cast("bigint")
    numbered = {r.i: r.n for r in index.blocked_row_number(df, ["i"], block, ["g"], "n").collect()}
    previous = {r.i: r.p for r in index.blocked_previous_max(df, "v", ["i"], block, ["g"], "p").collect()}
    seen = {}
    for g, i, v in rows:
        count, peak = seen.get(g, (0, None))
        assert numbered[i] == count + 1 and previous[i] == peak
        seen[g] = (count + 1, v if peak is None else max(peak, v))


def test_schedules_replay_or_are_refused(spark, tmp_path):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(32)], "loc_idx bigint, query_id string")
    fovs = (360, 180, 90, 70)
    first, second = (schedules.draw_schedule(queries, "val", fovs, s) for s in ("a", "b"))
    assert first.exceptAll(schedules.draw_schedule(queries.repartition(4), "val", fovs, "a")).count() == 0
    assert first.exceptAll(second).count() > 0
    path = str(tmp_path / "s")
    first.write.parquet(path)
    assert schedules.replay_schedule(spark, path, queries, "val", fovs).exceptAll(first).count() == 0
    with pytest.raises(ValueError, match="extra"):
        schedules.replay_schedule(spark, path, queries.filter("loc_idx < 31"), "val", fovs)
    with pytest.raises(ValueError, match="split"):
        schedules.replay_schedule(spark, path, queries, "test", fovs)
    with pytest.raises(ValueError, match="columns"):
        schedules.replay_schedule(spark, path, queries, "val", (360, 180))
    doubled = first.unionByName(first.limit(1))
    assert [r.reason for r in schedules.schedule_violations(doubled, queries, "val", fovs).collect()] == ["duplicate"]
    swapped = queries.withColumn("query_id", F.concat(F.lit("q"), F.lit(31) - F.col("loc_idx")))
    assert schedules.schedule_violations(first, swapped, "val", fovs).count() == 64
    values = first.select(F.min("roll_angle_deg_90"), F.max("roll_angle_deg_90")).first()
    assert 0 <= values[0] and values[1] <= 359
    half = first.withColumn("roll_angle_deg_70", F.col("roll_angle_deg_70") + F.lit(0.5))
    assert schedules.schedule_violations(half, queries, "val", fovs).select("reason").distinct().collect()[0][0] == "angle_70"

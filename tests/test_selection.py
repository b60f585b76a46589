import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringmatch.operators import recall, selection
from ringmatch.plans.selection import incomplete_validations, select_best
from ringmatch.sources import logs
from ringmatch.streaming import best, snapshot, validations

FOVS = (360, 180, 90, 70)


def ranks(spark, values):
    return spark.createDataFrame([(360, v) for v in values], "fov_deg bigint, rank bigint")


def test_one_percent_follows_the_configured_rounding(spark):
    placed = [1, 12, 13, 14, 700]
    low = recall.recall_table(ranks(spark, placed), 1250, rounding="floor").first()
    high = recall.recall_table(ranks(spark, placed), 1250).first()
    assert (low.threshold_floor, low.threshold_ceil) == (12, 13)
    assert low.recall_1pct == pytest.approx(0.4) and high.recall_1pct == pytest.approx(0.6)
    assert recall.one_percent_thresholds(7) == (1, 1)
    with pytest.raises(ValueError):
        recall.recall_table(ranks(spark, [1]), 10, rounding="round")
    assert recall.recall_table(ranks(spark, [0, 1, 11]), 10).first().out_of_range == 2


def validation(spark, rows):
    """rows: run, epoch, {fov: recall}."""
    data = [(run, epoch, "validation", {str(f): {"R@1": v} for f, v in values.items()}) for run, epoch, values in rows]
    schema = T.StructType([f for f in logs.LOG_SCHEMA if f.name in ("run", "epoch", "record_type", "fovs")])
    order = ["run", "epoch", "record_type", "fovs"]
    return spark.createDataFrame(data, T.StructType([schema[c] for c in order]))


def same(value):
    return dict.fromkeys(FOVS, value)


def test_best_keeps_the_earliest_tie_and_needs_every_fov(spark, tmp_path):
    path = str(tmp_path / "log")
    tied = dict(zip(FOVS, (0.31, 0.77, 0.12, 0.4)))
    logs.append_log(validation(spark, [("a", 3, tied), ("b", 3, same(0.21))]), path)
    logs.append_log(validation(spark, [("a", 5, dict(reversed(tied.items()))), ("b", 5, same(0.93)), ("b", 7, same(0.2))]), path)
    steps = spark.createDataFrame([("a", 3, "train_step", 0.1)], "run string, epoch bigint, record_type string, loss double")
    logs.append_log(steps, path)
    want = {"a": (3, pytest.approx(0.4)), "b": (5, pytest.approx(0.93))}
    assert {r.run: (r.best_epoch, r.best_macro_recall) for r in select_best(spark, path, FOVS).collect()} == want
    logs.append_log(validation(spark, [("b", 9, {360: 1.0, 180: 1.0}), ("a", 9, same(float("nan")))]), path)
    with pytest.raises(Exception, match="not complete"):
        select_best(spark, path, FOVS)
    assert {(r.run, r.epoch) for r in incomplete_validations(spark, path, FOVS).collect()} == {("a", 9), ("b", 9)}
    left = select_best(spark, path, FOVS, skip_incomplete=True)
    assert {r.run: (r.best_epoch, r.best_macro_recall) for r in left.collect()} == want


def test_unusable_scores_are_never_best(spark):
    rows = [("a", 1, 0.5), ("a", 2, float("nan")), ("a", 3, 0.9), ("a", 4, None), ("b", 1, float("nan"))]
    frame = spark.createDataFrame(rows, "run string, epoch bigint, score double")
    flags = {(r.run, r.epoch): r.new_best for r in selection.mark_new_best(frame, "score").collect()}
    assert flags == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("b", 1): False}
    assert [tuple(r) for r in selection.best_records(frame, "score").collect()] == [("a", 0.9, 3)]


def test_new_best_flags(spark):
    rows = [("a", e, s) for e, s in ((8, 0.5), (16, 0.5), (200, 0.6), (208, 0.4), (300, 0.7))]
    frame = spark.createDataFrame(rows, "run string, epoch bigint, score double")
    flags = {r.epoch: r.new_best for r in selection.mark_new_best(frame, "score").collect()}
    assert flags == {8: True, 16: False, 200: True, 208: False, 300: True}


def test_log_lines_have_sorted_keys(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(validation(spark, [("a", 8, same(0.5))]), path)
    text = spark.read.text(path).first()[0]
    assert text.index('"epoch"') < text.index('"fovs"') < text.index('"record_type"') < text.index('"run"')


def test_stream_replay_equals_the_batch_result(spark, tmp_path):
    log, state, check = (str(tmp_path / n) for n in ("log", "state", "check"))
    schema = "run string, epoch bigint, loss double"
    typed = T.StructType([logs.LOG_SCHEMA[c] for c in ("epoch", "loss", "run")])
    everything = []
    for part in range(3):
        rows = [(f"r{i % 4}", 100 * (2 - part) + i, float((i * 37 + part * 11) % 50)) for i in range(60)]
        everything += rows
        logs.append_log(spark.createDataFrame(rows, schema).repartition(3), log)
        stream = logs.stream_log(spark, log, typed, files_per_trigger=2)
        best.start_best_stream(stream, "loss", state, check).awaitTermination()
    got = {tuple(r) for r in best.read_best(spark, state, "loss").collect()}
    want = {tuple(r) for r in selection.best_records(spark.createDataFrame(everything, schema), "loss").collect()}
    assert got == want and len(got) == 4


def test_streamed_validations_equal_the_batch_result(spark, tmp_path):
    """FoVs one by one over many batches, one doubled after it was complete, one not finite; restarts; few files."""
    log, state, check = (str(tmp_path / n) for n in ("log", "state", "check"))
    whole = [(f"r{k % 3}", k, f, ((k * 7 + f) % 11) / 11) for k in range(12) for f in FOVS]
    late = [("r0", 0, 360, 0.9), ("r1", 1, 180, float("nan")), ("r2", 50, 360, 1.0), ("r1", 4, 90, 0.5)]
    records = [(run, epoch, {fov: value}) for run, epoch, fov, value in whole if (run, epoch, fov) != ("r1", 1, 180)]
    parts = [records[i::4] for i in range(4)] + [[(run, epoch, {fov: value})] for run, epoch, fov, value in late]
    for part in parts:
        logs.append_log(validation(spark, part).coalesce(1), log)
        stream = logs.stream_log(spark, log, files_per_trigger=1)
        validations.start_validation_stream(stream, FOVS, state, check).awaitTermination()
        held = {tuple(r) for r in validations.read_best_validations(spark, state).collect()}
        assert held == {tuple(r) for r in select_best(spark, log, FOVS, skip_incomplete=True).collect()}
    found = {(r.run, r.epoch) for r in validations.read_validations(spark, state).collect()}
    assert found == {(f"r{k % 3}", k) for k in range(12)} - {("r0", 0), ("r1", 1), ("r1", 4)}
    versions = snapshot.Snapshot(spark, state).versions()
    assert len(versions) == 2 and len(list((tmp_path / "state").iterdir())) == 2
    # The same batch again, as after a failure between the write and the stream's own commit.
    before = sorted(map(tuple, snapshot.Snapshot(spark, state).read().collect()))
    again = spark.read.parquet(f"{state}/v={versions[-1]}").filter(F.col("batch") == versions[-1])
    again.write.parquet(str(tmp_path / "again"))
    rows = spark.read.parquet(str(tmp_path / "again"))
    newest = lambda m: m.orderBy(F.desc("batch")).dropDuplicates(["run", "epoch"])
    snapshot.Snapshot(spark, state).merge(rows, versions[-1], newest)
    assert sorted(map(tuple, snapshot.Snapshot(spark, state).read().collect())) == before


def test_step_rollup_and_fov_totals(spark):
    schema = T.StructType([logs.LOG_SCHEMA[c] for c in ("run", "epoch", "step", "record_type", "batch_kind", "loss", "joint_in_batch_accuracy", "fov_counts")])
    rows = [("a", 1, s, "train_step", "hard" if s % 2 else "normal", float(s), s / 10, {"360": 8, "70": s}) for s in range(1, 6)]
    frame = spark.createDataFrame(rows, schema)
    r = selection.step_rollup(frame).first()
    assert (r.records, r.mean_loss, r.latest_loss, r.hard_batches, r.normal_batches) == (5, 3.0, 5.0, 3, 2)
    assert {x.fov_deg: x.rows for x in selection.fov_totals(frame).collect()} == {360: 40, 70: 15}
    macro = recall.macro_recall(spark.createDataFrame([(1, f, 0.5) for f in FOVS[:3]], "epoch int, fov_deg bigint, recall_at_1 double"), FOVS, ["epoch"]).first()
    assert macro.macro_recall is None and not macro.complete
    assert selection.best_records(frame.select("run", "epoch", F.col("loss").alias("s")), "s").first().best_s == 5.0


def test_a_snapshot_is_reduced_by_many_tasks_and_written_as_few_files(spark, tmp_path, monkeypatch):
    """The task that writes takes part in no reduction, so its memory does not grow with the partitions."""
    rows = spark.createDataFrame([(f"r{k}", float(k % 7)) for k in range(40)], "run string, s double")
    state = snapshot.Snapshot(spark, str(tmp_path / "state"))

    def best(merged):
        return merged.repartition(5, "run").withColumn("task", F.spark_partition_id())

    def files(version):
        return list((tmp_path / "state" / f"v={version}").glob("*.parquet"))

    state.merge(rows, 0, best)
    assert len(files(0)) == 1 and len({r.task for r in state.read().collect()}) > 1
    monkeypatch.setattr(snapshot, "FILE_ROWS", 20)
    state.merge(rows.withColumn("task", F.lit(0)), 1, lambda m: m.groupBy("run", "s").agg(F.max("task").alias("task")))
    assert len(files(1)) == 3 and state.read().count() == 40

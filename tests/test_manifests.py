import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ringmatch.functions.canonical import canonical_json, canonical_map_json, colliding_keys
from ringmatch.operators import audits, fingerprints, provenance
from ringmatch.plans.manifest import build_from_index, build_from_pair_lists
from ringmatch.sources import banks, tables


def sha(value):
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def line(i, note=None):
    return f"tile/{i}.jpg,ground/{i}.jpg,{f'notes/{i}.png' if note is None else note}\n"


def files(spark, side, ids):
    return spark.createDataFrame([(f"{side}/{i}.jpg",) for i in ids], "path string")


@pytest.fixture
def lists(tmp_path):
    (tmp_path / "train.csv").write_text("".join(line(f"{i:07d}") for i in (5, 3, 9)))
    (tmp_path / "val.csv").write_text(line("0000002"))
    return {s: str(tmp_path / f"{s}.csv") for s in ("train", "val")}, str(tmp_path / "out")


def build(spark, lists, out, present=("0000005", "0000003", "0000009", "0000002"), expected=None, **kw):
    return build_from_pair_lists(
        spark, lists, files(spark, "ground", present), files(spark, "tile", present), out, expected or {"train": 3, "val": 1}, "pano", "v1", **kw
    )


def test_pair_lists_become_a_manifest_in_source_order(spark, lists):
    paths = build(spark, *lists)
    rows = tables.read_manifest(spark, paths["manifest"], "/root").filter("split = 'train'").orderBy("source_mat_index").collect()
    assert [r.query_id for r in rows] == ["0000005", "0000003", "0000009"]
    assert rows[0].query_path == "/root/ground/0000005.jpg" and rows[0].source_mat_index == 1
    meta = {(r.artifact, r.key): r.value for r in spark.read.parquet(paths["metadata"]).collect()}
    assert len(meta[("manifest_sha256", "train")]) == 64 and meta[("protocol_version", "*")] == "v1"
    with pytest.raises(FileExistsError):
        build(spark, *lists)
    build(spark, *lists, overwrite=True)


@pytest.mark.parametrize(
    "change,message",
    [
        ({"present": ("0000005", "0000003", "0000009")}, "Missing image files"),
        ({"present": ("0000005", "0000003", "0000009", "0000002", "0000077")}, "inventory differs"),
        ({"expected": {"train": 4, "val": 1}}, "Unexpected final count"),
        ({"expected": {"train": 3, "val": 1, "test": 1}}, "Unexpected final count of test"),
        ({"expected": {"train": 3, "test": 1}}, "train and val"),
    ],
)
def test_nothing_is_published_when_an_audit_fails(spark, lists, change, message):
    with pytest.raises(ValueError, match=message):
        build(spark, *lists, **change)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{lists[1]}/manifest")


@pytest.mark.parametrize(
    "text,message",
    [
        ("tile/0000001.jpg,ground/0000001.jpg\n", "three columns"),
        ("tile/0000001.jpg,ground/0000001.jpg,notes/0000001.png,more\n", "three columns"),
        ("tile/0000001.jpg,ground/0000002.jpg,notes/0000001.png\n", "id_mismatch"),
        ("tile/0000001.jpg,../ground/0000001.jpg,notes/0000001.png\n", "path_escape"),
        ("tile/1.jpg,ground/1.jpg,notes/1.png\n", "malformed_id"),
        (line("0000002"), "disjoint"),
    ],
)
def test_broken_pair_lists_are_refused(spark, lists, tmp_path, text, message):
    (tmp_path / "train.csv").write_text(text)
    with pytest.raises(ValueError, match=message):
        build(spark, *lists, present=("0000001", "0000002"), expected={"train": 1, "val": 1})


def test_source_rows_are_counted_across_many_files_and_splits(spark, tmp_path):
    ids = [f"{i:07d}" for i in range(5000)]
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        chunk = ids[part * 2000 : (part + 1) * 2000]
        (folder / f"part-{part}.csv").write_text("".join(line(i, "" if i.endswith("7") else None) for i in chunk))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = tables.read_pair_list(spark, str(folder)).orderBy("source_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.source_row for r in rows] == list(range(1, 5001))
    assert [r.satellite_path for r in rows] == [f"tile/{i}.jpg" for i in ids]
    assert all((r.annotation_path == "") == r.satellite_path.endswith("7.jpg") for r in rows)


def index_inputs(spark, keep=(1, 2, 3, 4, 5)):
    ids = spark.createDataFrame([(i, f"s{i}") for i in range(1, 7)], "ordinal bigint, query_id string")
    rows = [("train", 1), ("train", 2), ("val", 3), ("test", 3), ("test", 4), ("train", 6)]
    indices = spark.createDataFrame(rows, "split string, ordinal bigint")
    present = [f"s{i}" for i in keep]
    return ids, indices, files(spark, "g", present), files(spark, "t", present)


def index_build(spark, out, exclusions, keep=(1, 2, 3, 4, 5), annotated=None, final=None, indices=None):
    ids, default, query_files, tile_files = index_inputs(spark, keep)
    frame = spark.createDataFrame(exclusions, "split string, query_id string, source_mat_index bigint, reason string")
    return build_from_index(
        spark, ids, default if indices is None else indices, frame, query_files, tile_files, out,
        annotated or {"train": 3, "val": 1, "test": 2}, final or {"train": 2, "val": 1, "test": 2}, "pano", "v1",
        "g/{query_id}.jpg", "t/{query_id}.jpg", inventory_split=None,
    )


def test_index_lists_become_a_manifest_with_recorded_exclusions(spark, tmp_path):
    paths = index_build(spark, str(tmp_path / "o"), [("train", "s6", 6, "no files")])
    rows = {(r.split, r.query_id) for r in spark.read.parquet(paths["manifest"]).collect()}
    assert rows == {("train", "s1"), ("train", "s2"), ("val", "s3"), ("test", "s3"), ("test", "s4")}
    applied = spark.read.parquet(paths["exclusions"]).collect()
    assert [(r.query_id, r.query_exists, r.satellite_exists) for r in applied] == [("s6", False, False)]


@pytest.mark.parametrize(
    "exclusions,message",
    [
        ([], "Unapproved missing"),
        ([("train", "s6", 5, "x")], "ordinal_mismatch"),
        ([("train", "s6", 6, "x"), ("train", "s6", 6, "x")], "duplicate"),
        ([("train", "s6", 6, "x"), ("val", "s9", 9, "x")], "unmatched"),
    ],
)
def test_exclusions_must_be_exact(spark, tmp_path, exclusions, message):
    with pytest.raises(ValueError, match=message):
        index_build(spark, str(tmp_path / "o"), exclusions)


def test_ordinals_outside_the_id_list_are_refused(spark, tmp_path):
    indices = spark.createDataFrame([("train", 1), ("train", 99), ("val", 3)], "split string, ordinal bigint")
    with pytest.raises(ValueError, match="outside the id list"):
        index_build(spark, str(tmp_path / "o"), [], indices=indices, annotated={"train": 2, "val": 1}, final={"train": 2, "val": 1})


def test_paths_stay_below_the_root(spark, tmp_path):
    row = spark.createDataFrame([("d", "val", "q", "/abs/q.jpg", "q", "t/q.jpg", "s", 1)], tables.MANIFEST_SCHEMA)
    tables.write_once(row, str(tmp_path / "m"))
    with pytest.raises(Exception, match="below the root"):
        tables.read_manifest(spark, str(tmp_path / "m"), "/root").collect()
    tables.write_once(row.drop("query_id"), str(tmp_path / "n"))
    with pytest.raises(ValueError, match="Not in the manifest"):
        tables.read_manifest(spark, str(tmp_path / "n"), "/root")
    df = spark.createDataFrame([("/r/data/a.jpg",)], "p string")
    assert tables.relative_to_root(df, "p", "/r").first().p == "data/a.jpg"
    with pytest.raises(Exception, match="inside the root"):
        tables.relative_to_root(spark.createDataFrame([("/other/a.jpg",)], "p string"), "p", "/r").collect()


def test_file_listing(spark, tmp_path):
    for name in ("a_grd.jpg", "b_grd.jpg", "c_sat.jpg", "d.JPG"):
        (tmp_path / name).write_bytes(b"x")
    listed = tables.list_files(spark, str(tmp_path), "_grd.jpg")
    assert sorted(r.id for r in tables.ids_from_paths(listed, "_grd.jpg").collect()) == ["a", "b"]
    every = tables.list_files(spark, str(tmp_path), "")
    assert sorted(r.id for r in tables.stems_with_extension(every, ".jpg").collect()) == ["a_grd", "b_grd", "c_sat", "d"]


def test_fingerprint_is_the_canonical_hash_whatever_the_row_order(spark):
    rows = [("pano", "val", f"q{i}", f'g/é"{i}.jpg', f"q{i}", "t\\x", "s", i) for i in range(50)]
    frame = spark.createDataFrame(rows, tables.MANIFEST_SCHEMA)
    names = fingerprints.FINGERPRINT_COLUMNS
    records = sorted((dict(zip(tables.MANIFEST_COLUMNS, r)) for r in rows), key=lambda r: (r["query_id"], r["satellite_id"]))
    want = sha([{n: r[n] for n in names} for r in records])
    for parts in (1, 4, 16):
        got = fingerprints.manifest_fingerprint(frame.repartition(parts), form=fingerprints.EXACT).first()
        assert (got.fingerprint, got.rows, got.algorithm) == (want, 50, fingerprints.EXACT)


def test_tree_fingerprint_depends_on_its_own_group_only(spark):
    def frame(train):
        rows = [("pano", s, f"q{i}", "g", f"q{i}", "t", "s", i) for s, n in (("val", 10), ("train", train)) for i in range(n)]
        return spark.createDataFrame(rows, tables.MANIFEST_SCHEMA)

    prints = [
        {r.split: (r.fingerprint, r.rows, r.algorithm) for r in fingerprints.manifest_fingerprint(frame(n).repartition(p)).collect()}
        for n, p in ((900, 1), (1_100, 7), (4_000, 3))
    ]
    assert len({p["val"] for p in prints}) == 1 and len({p["train"] for p in prints}) == 3
    assert prints[0]["val"][1:] == (10, "sha256_tree_4")
    changed = frame(900).withColumn("query_path", F.when(F.col("query_id") == "q7", "h").otherwise(F.col("query_path")))
    assert fingerprints.manifest_fingerprint(changed).filter("split = 'val'").first().fingerprint != prints[0]["val"][0]
    with pytest.raises(ValueError):
        fingerprints.algorithm("md5")


def test_tree_counts_copies_without_gathering_them(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"))
    a, b = (provenance.table_hash(x, depth=3).first() for x in (df, df.union(df.limit(1))))
    assert a.rows == 1000 and b.rows == 1001 and a.fingerprint != b.fingerprint


def test_schedule_hash_is_the_canonical_hash(spark):
    rows = [(i, "val", f'q"{i}é', (i * 7) % 360, i % 360) for i in range(40)]
    frame = spark.createDataFrame(rows, "loc_idx bigint, split string, query_id string, roll_angle_deg_90 smallint, roll_angle_deg_360 smallint")
    want = sha(
        {
            "protocol": fingerprints.SCHEDULE_PROTOCOL,
            "split": "val",
            "query_ids": [r[2] for r in rows],
            "roll_angles_deg": {"90": [r[3] for r in rows], "360": [r[4] for r in rows]},
        }
    )
    assert fingerprints.schedule_fingerprint(frame.repartition(5), "val", (360, 90), fingerprints.EXACT).first().fingerprint == want
    other = fingerprints.schedule_fingerprint(frame, "val", (360, 90)).first()
    assert other.algorithm == "sha256_tree_4" and other.fingerprint != want


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, 'é"\\', None)], "b int, a string, c string")
    assert df.select(canonical_json(df.columns)).first()[0] == json.dumps({"a": 'é"\\', "b": 1, "c": None}, separators=(",", ":"), ensure_ascii=False)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in ((90, 1), (360, 2), (70, 3))])
    assert spark.range(1).select(canonical_map_json(entries)).first()[0] == '{"360":2,"70":3,"90":1}'
    twice = spark.createDataFrame([(1, "90"), (1, "90"), (1, "360")], "r int, k string")
    assert [r.json_key for r in colliding_keys(twice, ["r"], "k").collect()] == ["90"]


def test_reuse_needs_every_key_to_match(spark):
    expected = spark.createDataFrame([("a", "k", "1"), ("a", "l", "2"), ("b", "k", "1"), ("c", "k", "1")], "artifact string, key string, value string")
    recorded = spark.createDataFrame([("a", "k", "1"), ("a", "l", "2"), ("b", "k", "9"), ("d", "k", "1")], "artifact string, key string, value string")
    assert [r.artifact for r in provenance.reusable_artifacts(recorded, expected).collect()] == ["a"]
    assert sorted(r.artifact for r in provenance.metadata_mismatches(recorded, expected).collect()) == ["b", "c", "d"]


def test_alignment_and_contract_audits(spark):
    bank = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "id string")
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "satellite_id string")
    assert {r.id: r.problem for r in audits.alignment(bank, manifest).collect()} == {"b": "duplicate", "x": "extra", "c": "missing"}
    rows = [("train", "a"), ("val", "b"), ("test", "b"), ("test", "c"), ("val", "a")]
    got = audits.split_contract(spark.createDataFrame(rows, "split string, query_id string")).first()
    assert tuple(got) == (1, 0, 1, 1)


def test_bank_and_pool_stores_replace_only_their_partition(spark, tmp_path):
    bank = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, direction array<double>")
    path = str(tmp_path / "bank")
    banks.write_bank(bank, path, "val", "h1")
    banks.write_bank(bank.limit(1), path, "val", "h2")
    banks.write_bank(bank.limit(1), path, "train", "h1")
    assert banks.read_bank(spark, path, "val", "h1").count() == 2
    pool = spark.createDataFrame([(360, "a", 1, "b", 5), (90, "a", 1, "b", 4)], "fov_deg bigint, anchor string, rank bigint, negative string, score_q bigint")
    path = str(tmp_path / "pools")
    banks.write_pool(pool, path, 16)
    banks.write_pool(pool.limit(1), path, 24)
    assert banks.pool_epochs(spark, path) == [16, 24]
    assert banks.publish_newest(spark, path, str(tmp_path / "new")) == 24
    assert banks.pool_epochs(spark, str(tmp_path / "new")) == [24]


def test_shard_outputs_are_compared_by_place(spark):
    from ringmatch.operators import audits

    names = [f"x{i:02d}" for i in range(20)]
    listed = spark.createDataFrame(list(enumerate(names)), "index bigint, id string")
    whole = [(0, p, names[p]) for p in range(6)] + [(1, p, names[6 + p]) for p in range(7)] + [(2, p, names[13 + p]) for p in range(7)]

    def found(rows):
        frame = spark.createDataFrame(rows, "shard int, place bigint, id string").repartition(4)
        return {r.shard: (r.contiguous, r.in_order) for r in audits.shard_outputs_audit(frame, listed, 20, 3).collect()}

    assert set(found(whole).values()) == {(True, True)}
    swapped = [(s, {2: 3, 3: 2}.get(p, p) if s == 1 else p, i) for s, p, i in whole]
    assert found(swapped) == {0: (True, True), 1: (True, False), 2: (True, True)}
    assert found(whole[1:])[0] == (False, False) and found(whole[:13])[2] == (False, False)
    assert found(whole + whole[-1:])[2] == found(whole + 2 * whole[-1:])[2] == (False, False)
    assert found([*whole[:-1], (2, 6, "other")])[2] == (True, False)

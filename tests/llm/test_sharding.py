"""Byte shards against one running sum in Python."""

import random
import zlib

import pytest

from ringmatch.llm import sharding
from tests.llm.helpers import AWKWARD, documents, prose, rows_of

COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def placed(rows, shards):
    """Brute force; rows in the operator's order."""
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    total, before, out, held = sum(sizes), 0, [], {}
    for (doc_id, text), size in zip(rows, sizes):
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        slot = held.get(shard, 0)
        held[shard] = slot + 1
        out.append((doc_id, size, zlib.crc32((text or "").encode()), "bytes", shard, slot, None))
        before += size
    return out


@pytest.mark.parametrize("part_rows", [16_384, 7])
def test_equals_a_running_sum(spark, part_rows):
    draw = random.Random(3)
    rows = [(k, prose(k, draw.choice((1, 5, 50, 400)))) for k in range(300)] + [(400, "é" * 60_000), (401, None), (402, "")]
    shuffled = rows[:]
    draw.shuffle(shuffled)
    docs = documents(spark, shuffled).repartition(5)
    got = sharding.place(docs, 40, part_rows=part_rows)
    want = placed(sorted(rows), 40)
    assert rows_of(got, "doc_id", "size", "text_crc32", "shard", "slot") == sorted(((*r[:3], *r[4:6]) for r in want), key=repr)


def test_hot_and_null_ids_are_spread(spark):
    """A third of the rows has no id and one text, a third one id; both lie over several partitions."""
    rows = [(None, "the same text")] * 400 + [(5, prose(k % 40, 20)) for k in range(400)] + [(k, "x" * k) for k in range(400)]
    got = sharding.place(documents(spark, rows).repartition(3), 40, part_rows=50).collect()
    assert len(got) == len(rows)
    held = {}
    for row in got:
        held.setdefault(row["shard"], []).append((row["slot"], row["size"]))
    total = sum(r["size"] for r in got)
    for slots in held.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
        assert abs(sum(n for _, n in slots) - total / 40) <= max(r["size"] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) > 1


def test_awkward_rows(spark):
    got = rows_of(sharding.shard_table(documents(spark, AWKWARD), 4), *COLUMNS)
    assert [r[0] for r in got].count(98) == 2 and len(got) == len(AWKWARD)
    null = next(r for r in got if r[0] == 90)
    assert null[1:3] == (16, 0)
    empty = sharding.shard_table(documents(spark, []))
    assert empty.collect() == [] and tuple(empty.columns) == COLUMNS


def test_written_shards_hold_the_documents(spark):
    rows = [(k, prose(k, 30)) for k in range(200)]
    docs = documents(spark, rows).selectExpr("*", "'mine' as shard", "7 as slot")
    back = spark.read.parquet(sharding.write_shards(docs, shards=8))
    assert set(back.columns) == {*docs.columns, "_shard", "_slot"}
    assert rows_of(back, "doc_id", "text", "shard", "slot") == sorted(((*r, "mine", 7) for r in rows), key=repr)
    got = rows_of(back, "doc_id", "_shard", "_slot")
    assert got == sorted(((r[0], r[4], r[5]) for r in placed(rows, 8)), key=repr)

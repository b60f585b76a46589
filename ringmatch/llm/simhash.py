"""SimHash near-duplicates by deletion-variant signatures.

Three differing bits over two halves leave one half with at most one. So each half is indexed under
its 32 variants with one bit masked out: fingerprints whose half differs in that bit, or in none,
meet under an equal key. Keys are joined by a shuffle, pairs are verified on all 64 bits in the
task, and only spanning links of a key's group are kept. Copies of a fingerprint are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import durable, each_slice, frugal, ship_package, texts_of
from ringmatch.llm.components import components

#: A key with more fingerprints is cut further by eight bits of the other half before comparing.
GROUP = 4_096


def _fingerprint(text: str, words_per_shingle: int) -> int:
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and the six ASCII separators
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < words_per_shingle:
        return digest(b" ".join(words), 42)
    total = len(words) - words_per_shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    block = 65_536
    for start in range(0, total, block):
        part = words[start : start + block + words_per_shingle - 1]
        shingles = zip(*(part[k:] for k in range(words_per_shingle)))
        hashes = np.fromiter((digest(b" ".join(s), 42) for s in shingles), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a signed long) of every whole text; null text: zero."""
    ship_package(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches):
            bits = np.array([_fingerprint(t, words_per_shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(bits.view(np.int64))], ["doc_id", "fingerprint"])

    return texts_of(docs).mapInArrow(frugal(make), "doc_id long, fingerprint long")


def _half(fingerprint: Column, wild: Column) -> Column:
    return F.when(wild < 32, fingerprint.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fingerprint, 32))


def signatures(distinct: DataFrame) -> DataFrame:
    """``key, fingerprint``: for each half and each of its bits the half without that bit."""
    rows = distinct.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("wild"))
    bit = F.expr("shiftleft(1L, wild % 32)")
    masked = _half(F.col("fingerprint"), F.col("wild")).bitwiseAND(F.bitwise_not(bit))
    return rows.select(F.expr("shiftleft(cast(wild as bigint), 32)").bitwiseOR(masked).alias("key"), "fingerprint")


def spanning_labels(values: np.ndarray, most: int) -> np.ndarray:
    """For each value the index of its component's first one; links are at most ``most`` differing bits."""
    n = len(values)
    labels = np.arange(n)
    step = max(1, 4_000_000 // n)
    while True:
        new = labels.copy()
        for s in range(0, n, step):
            near = np.bitwise_count(values[s : s + step, None] ^ values[None, :]) <= most
            new[s : s + step] = np.where(near, labels[None, :], n).min(axis=1)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def _compare(most: int, group: int | None):
    """Rows sorted by key become links ``(a, b, null)``; groups over ``group`` come back as ``(key, fp, piece)``."""

    def links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        labels = spanning_labels(values, most)
        other = labels != np.arange(len(values))
        return values[other], values[labels[other]]

    def batch(a: list[np.ndarray], b: list[np.ndarray], piece: list[np.ndarray] | None) -> pa.RecordBatch:
        def column(parts: list[np.ndarray], kind: str) -> np.ndarray:
            return np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)

        first, second = column(a, "u8").view("i8"), column(b, "u8").view("i8")
        third = pa.nulls(len(first), pa.int32()) if piece is None else pa.array(column(piece, "i4"))
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), third], ["a", "b", "piece"])

    def deferred(key: int, values: np.ndarray) -> pa.RecordBatch:
        # key >> 32 is the masked bit's number: below 32 the low half is shared, so cut by the high one.
        other = values >> np.uint64(32) if (key >> 32) < 32 else values & np.uint64(0xFFFFFFFF)
        pieces = [(k << 8) | ((other >> np.uint64(8 * k)) & np.uint64(255)).astype("i4") for k in range(4)]
        keys = np.full(4 * len(values), key, dtype="i8").view("u8")
        return batch([keys], [np.tile(values, 4)], pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, over = None, np.empty(0, "u8"), False
        for rows in batches:
            if not rows.num_rows:
                continue
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            values = rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False).view("u8")
            if rows.num_columns == 3:  # the second pass: key, piece, fingerprint
                keys = (keys >> 32) * 1024 + rows.column(1).to_numpy(zero_copy_only=False) + (keys & 0xFFFFFFFF) * (1 << 20)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            a, b = [], []
            for at, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                last = at == len(starts) - 1
                part = values[s:e]
                if held_key is not None:
                    if keys[s] == held_key:
                        part = np.concatenate([held, part])
                    else:
                        if not over and len(held) > 1:
                            x, y = links(held)
                            a.append(x), b.append(y)
                        over = False
                    held_key = None
                else:
                    over = False
                if group is not None and (over or len(part) > group):
                    yield deferred(int(keys[s]), part)
                    part, over = part[:0], True
                if last:
                    held_key, held = keys[s], part.copy()
                elif len(part) > 1:
                    x, y = links(part)
                    a.append(x), b.append(y)
            yield batch(a, b, None)
        if held_key is not None and not over and len(held) > 1:
            x, y = links(held)
            yield batch([x], [y], None)

    return run


def near_links(distinct: DataFrame, most: int = 3, group: int = GROUP) -> DataFrame:
    """``a, b``: links that span the groups of distinct fingerprints at most ``most`` (3 or fewer) bits apart."""
    if not 0 <= most <= 3:
        raise ValueError("Two halves with one free bit cover at most three differing bits")
    ship_package(distinct.sparkSession)
    schema = "a long, b long, piece int"
    first = signatures(distinct).repartition(F.col("key")).sortWithinPartitions("key", "fingerprint")
    found = durable(first.mapInArrow(_compare(most, group), schema))
    # Large groups: the other half has at most three differing bits, so one of its four bytes is equal.
    # Such a key fixes 39 bits; a group cannot hold more than 2^25 fingerprints.
    rest = found.where("piece is not null").select(F.col("a").alias("key"), "piece", F.col("b").alias("fingerprint"))
    rest = rest.repartition(F.col("key"), F.col("piece")).sortWithinPartitions("key", "piece", "fingerprint")
    more = rest.mapInArrow(_compare(most, None), schema)
    return found.where("piece is null").unionByName(more).select("a", "b")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, most: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest ``doc_id`` reachable over links
    of at most ``most`` differing bits, its own included. A null or blank text has fingerprint zero
    and is linked like any other. Repeated rows and rows with a null id get their own row; a
    component that holds null ids only has a null id. No documents give no rows; other columns are
    ignored.
    """
    marked = durable(fingerprints(docs, words_per_shingle))
    distinct = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct.select("fingerprint"), most))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = durable(rooted)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = durable(rooted.join(smallest, "root").select("fingerprint", "component_id"))
    return marked.join(by_print, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )

"""Bounded-space best-fit packing of token sequences.

Documents become token pieces in one pass. Pieces are dealt by hash into buckets of a fixed mean
size, and each bucket is packed online: a fixed number of open bins, a bitset over free space to
find the tightest fit, and the fullest bin closes when a new one is needed. A bucket is read as a
stream; only its open bins are held.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.llm import words
from ringmatch.llm.common import durable, each_run, each_slice, frugal, ship_package, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces in a bucket on average. A bucket leaves at most its open bins unfilled.
BUCKET_PIECES = 100_000
OPEN_BINS = 512
#: Words whose ids a task keeps, in each of the cache's two generations.
CACHED_WORDS = 200_000


_ENCODERS: dict[int, tuple[words.Words, words.Words]] = {}


def _after_space(encode) -> words.Words:
    """Ids of a word that follows a single space; a closing mark after a letter is a word of its own."""
    closing = {c: encode(c) for c in ".,;:!?"}

    def make(word: str) -> bytes:
        if word[-1] in closing and word[-2:-1].isalpha():
            return cache[word[:-1]] + closing[word[-1]]
        return encode(" " + word)

    cache = words.Words(make, CACHED_WORDS)
    return cache


def _ids_of_text(tokenizer_text: str):
    """A function that gives the ids of a text as bytes (unsigned 32 bit, little endian)."""
    tokenizer = words.load(tokenizer_text)

    def encode(text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    key = hash(tokenizer_text)
    if key not in _ENCODERS:
        fast = words.rank_encoder(tokenizer_text)
        word = encode if fast is None else lambda w: array("I", fast(w)).tobytes()
        _ENCODERS[key] = (_after_space(word), words.Words(word, 50_000))
    spaced, first = _ENCODERS[key]
    step = json.loads(tokenizer_text).get("pre_tokenizer") or {}
    by_words = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
    by_words = by_words and not json.loads(tokenizer_text).get("normalizer")
    special = words.special_strings(tokenizer_text)
    newline = encode("\n")

    def ids(text: str) -> bytes:
        # Single spaces and single line ends between words: no word depends on another one.
        plain = by_words and text.replace("\n", " ").split(" ") == text.split()
        if not plain or any(s in text for s in special) or any(c in text for c in words.SEPARATORS):
            return encode(text)
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(first[head] + b"".join(map(spaced.__getitem__, rest)))
        return newline.join(lines)

    return ids


def forget_words(tokenizer_text: str) -> None:
    """Empty this worker's word caches; the tokenizer stays loaded."""
    for cache in _ENCODERS.get(hash(tokenizer_text), ()):
        cache.forget()


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids plus ``end_id``, cut into pieces of at most ``size`` tokens.

    Only longer documents are cut, and then from the end, so that only the first piece is shorter.
    Columns: ``doc_id, piece, start, length, ids_crc32``. A null text counts as empty (one piece
    with the end id). Repeated rows and null ids each get their pieces.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids_of_text(tokenizer.value)
        try:
            for batch in each_slice(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = encode(text) + end
                    total, start, piece = len(ids) // 4, 0, 0
                    while start < total:
                        stop = start + ((total - start) % size or size)
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, piece = stop, piece + 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            forget_words(tokenizer.value)

    return texts_of(docs).mapInArrow(frugal(cut), PIECES)


class OpenBins:
    """At most ``most`` open bins; ``bits`` has bit f set while a bin with f free places is open."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece and the piece's offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            chosen, free = self.made, self.size
            self.made += 1
            if length < self.size and self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(chosen)
            self.open += 1
        return chosen, self.size - free


def pack(
    pieces: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS, bucket_pieces: int = BUCKET_PIECES
) -> DataFrame:
    """Every piece with its ``sequence_id`` and gapless ``offset``; no sequence is longer than ``size``.

    ``pieces`` is durable (it is counted and read again). Order inside a bucket is by hash, then by
    content, so a task that runs again gives the same places. No pieces give no rows.
    """
    buckets = max(1, round(pieces.count() / bucket_pieces))
    order = F.xxhash64("doc_id", "piece", "start")
    dealt = pieces.withColumn("__bucket", F.pmod(order, F.lit(buckets))).withColumn("__order", F.shiftright(order, 20))
    dealt = dealt.repartition(buckets, "__bucket").sortWithinPartitions(
        "__bucket", "__order", "doc_id", "piece", "length", "ids_crc32"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in each_run(batches, "__bucket"):
            bins = OpenBins(size, open_bins)
            for part in parts:
                placed = [bins.place(n) for n in part.column("length").to_pylist()]
                columns = [part.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                columns.append(pa.array([bucket << 40 | b for b, _ in placed], pa.int64()))
                columns.append(pa.array([o for _, o in placed], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                )

    return dealt.mapInArrow(frugal(place), PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack: one row per piece, see :func:`token_pieces` and :func:`pack`."""
    return pack(durable(token_pieces(docs, tokenizer_path, size, end_id)), size)

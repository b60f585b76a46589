"""Substring dedup: paragraphs and passages that repeat across documents.

Two kinds of text pieces are compared.

* Paragraphs: every line with at least one shingle of ``SHINGLE_WORDS`` words, and blocks of consecutive short lines,
  which are cut where a line's own digest says so and so begin and end at the same lines in every copy. Copies
  collapse, MinHash bands of word shingles bring similar ones together, and colliding paragraphs are verified by exact
  Jaccard similarity of their shingles.
* Windows inside texts, for passages that stand in the middle of other paragraphs: windows of
  ``WINDOW_WORDS`` words begin where a hash of three words is the least among ``SPREAD``
  neighbours, so a shared passage has the same windows wherever it stands. Any run of
  ``WINDOW_WORDS + SPREAD - 1`` words that two documents share holds a common window.

One document keeps each passage: the smallest ``doc_id`` of the paragraph's component, or of the
window's holders. Its other occurrences are removals, if what repeats there in a row is long enough: a window,
neighbouring paragraphs of ``PASSAGE_WORDS`` words together, or the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import durable, each_slice, frugal, ship_package, texts_of, written
from ringmatch.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Repeated paragraphs in a row that hold fewer words together are left where they are.
PASSAGE_WORDS = 50
#: A line with fewer words is short; a block of short lines holds so many at least, and four or so times as many at most.
LINE_WORDS = 50
WINDOW_WORDS = 36
SPREAD = 16
GRAM_WORDS = 3
#: A pair at similarity s shares a band with probability 1 - (1 - s^2)^7: 0.999 at 0.8.
BANDS, ROWS = 7, 2
#: Pieces of one digest beyond which it is looked up in a broadcast table instead of meeting in one task.
HEAVY = 4_096
#: Paragraphs of a band bucket compared in one block.
BLOCK = 1_024

#: Texts of about so many characters are hashed in one go: few calls, and arrays that stay in a core's cache.
TOGETHER = 60_000
#: Buckets of at most so many paragraphs meet where their smallest one is, so that a text they share is hashed once.
SMALL = 64

_WHITE = np.zeros(0x3002, dtype=bool)
_WHITE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept up to a bounded length."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        steps = np.ones((2, size), dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _POWERS, _INVERSES = np.multiply.accumulate(steps, axis=1)
    return _POWERS[:n], _INVERSES[:n]


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop (code points) of every word; words stand between white space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    white = np.ones(len(points) + 2, dtype=bool)
    white[1:-1] = _WHITE.take(points, mode="clip")
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    sums[1:] = points
    sums[1:] += np.uint64(1)
    sums[1:] *= power[1:]
    np.cumsum(sums[1:], out=sums[1:])
    return _mixed((sums[stops] - sums[starts]) * inverse[starts]), starts, stops


def _together(texts: list[str], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters together."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text) + 1
        if size >= most or at + 1 == len(texts):
            yield first, at + 1
            first, size = at + 1, 0


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of every word of many texts, as if each stood alone; where each text's words begin; whose each is."""
    hashes, starts, stops = word_hashes("\n".join(texts))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    bounds = np.searchsorted(starts, begin)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return hashes, starts - begin[owner], stops - begin[owner], bounds, owner


def window_starts(
    hashes: np.ndarray, window: int, spread: int, gram: int = GRAM_WORDS, bounds: np.ndarray | None = None
) -> np.ndarray:
    """Words at which windows begin: the first least gram of every ``spread`` neighbouring ones.

    ``bounds``: where each text's words begin, and their number, if the words are those of many texts.
    """
    bounds = np.array([0, len(hashes)]) if bounds is None else bounds
    n = len(hashes) - gram + 1
    sizes = np.diff(bounds)
    if n < 1 or not (sizes >= window).any():
        return np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        grams *= np.uint64(_BASE)
        grams += hashes[k : k + n]
    grams = _mixed(grams)
    # Texts of less than ``spread`` grams have one run.
    few = np.flatnonzero((sizes >= max(window, gram)) & (sizes - gram + 1 < spread)).tolist()
    single = [bounds[t] + grams[bounds[t] : bounds[t + 1] - gram + 1].argmin() for t in few]
    # Least gram and its place in runs of 1, 2, 4, ... up to ``spread`` neighbours; ties: the first.
    place, span = np.arange(n), 1
    while span < spread and len(place):
        step = min(span, spread - span)
        left = grams[:-step] <= grams[step:]
        grams = np.where(left, grams[:-step], grams[step:])
        place = np.where(left, place[:-step], place[step:])
        span += step
    # A run's last word is in the text of its first one.
    place = place[owner[: len(place)] == owner[gram + spread - 2 :][: len(place)]]
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = place[1:] != place[:-1]
    chosen = np.sort(np.concatenate([place[fresh], np.array(single, dtype=np.int64)]))
    return chosen[chosen + window <= bounds[1:][owner[chosen]]]


#: A place: the piece's words ``[word, word + words)`` of a document with ``total`` words, and its code points.
PLACE = "doc_id long, start int, stop int, word int, words int, total int"


def _rows_of(places: list, digests: list[bytes], texts: list[str] | None = None) -> pa.RecordBatch:
    """Places (a list per column of ``PLACE``, or of its first ones) with their digests, and texts where there are any."""
    columns = [pa.array(x, pa.int32() if k else pa.int64()) for k, x in enumerate(places)] + [pa.array(digests, pa.binary())]
    names = [*["doc_id", "start", "stop", "word", "words", "total"][: len(places)], "digest"]
    if texts is not None:
        columns, names = [*columns, pa.array(texts, pa.string())], [*names, "text"]
    return pa.RecordBatch.from_arrays(columns, names)


def windows(docs: DataFrame, window: int = WINDOW_WORDS, spread: int = SPREAD, placed: bool = True) -> DataFrame:
    """Places and 96-bit digests of every window of every whole text; only ``doc_id, digest`` if not ``placed``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in each_slice(batches):
            doc_ids, texts = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
            digests, parts = [], []
            for low, high in _together(texts):
                hashes, first, last, bounds, owner = words_of(texts[low:high])
                at = window_starts(hashes, window, spread, bounds=bounds)
                data = memoryview(hashes.tobytes())
                digests += [xxhash.xxh3_128_digest(data[a : a + 8 * window])[:12] for a in (8 * at).tolist()]
                of = owner[at]
                place = [doc_ids[low + of]]
                if placed:
                    place += [first[at], last[at + window - 1], at - bounds[of], np.full(len(at), window), np.diff(bounds)[of]]
                parts.append(place)
            if digests:
                yield _rows_of([np.concatenate(x) for x in zip(*parts)], digests)

    texts = texts_of(docs).where(F.col("doc_id").isNotNull())
    return texts.mapInArrow(frugal(cut), f"{PLACE if placed else 'doc_id long'}, digest binary")


def _places_of(places: DataFrame, shared: DataFrame) -> DataFrame:
    """The places whose digest is in ``shared`` (``digest, keeper, held``), with the keeper.

    Digests that more than ``HEAVY`` pieces and a 4,096th of all pieces have, so at most 4,096 of them, are copied, and
    their pieces are dealt over the copies; a broadcast table says how many there are. The places are cut once.
    """
    most = max(HEAVY, (shared.agg(F.sum("held")).first()[0] or 0) // 4_096)
    copies = F.greatest(F.lit(1), F.ceil(F.col("held") / most).cast("int"))
    shared = shared.select(F.col("digest").alias("__digest"), "keeper", copies.alias("copies"))
    heavy = shared.where("copies > 1").select(F.col("__digest").alias("__heavy"), F.col("copies").alias("__copies"))
    number = F.lit(0)
    if not heavy.isEmpty():
        places = places.join(F.broadcast(heavy), F.col("digest") == F.col("__heavy"), "left")
        number = F.pmod(F.xxhash64("doc_id", "start"), F.coalesce("__copies", F.lit(1))).cast("int")
    dealt = shared.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    met = (F.col("digest") == F.col("__digest")) & (F.col("__number") == F.col("__copy"))
    columns = ["doc_id", "start", "stop", "word", "words", "total", "keeper"]
    return places.withColumn("__number", number).join(dealt, met).select(*columns)


def window_repeats(docs: DataFrame) -> DataFrame:
    """Places of all windows that stand in more than one document, with who keeps them."""
    # Windows are many and quickly cut, so they are cut twice instead of being stored.
    held = windows(docs, placed=False).groupBy("digest").agg(
        F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("held")
    )
    shared = written(held.where("keeper <> last").drop("last"), "shared")
    return _places_of(windows(docs), shared).withColumn("exact", F.lit(True))


def _pieces(text: str) -> tuple[int, list[tuple[int, int, int, int, str]]]:
    """Words of a text, and its paragraphs ``(start, stop, word, words, joined)``: lines and blocks of short lines."""
    import xxhash

    out, at, word = [], 0, 0
    block: list[tuple[int, int, int, str]] = []

    def close() -> None:
        if len(block) > 1 and held >= LINE_WORDS:
            out.append((block[0][0], block[-1][1], block[0][2], held, " ".join(b[3] for b in block)))
        block.clear()

    held = 0
    for line in text.split("\n"):
        words = line.split()
        count = len(words)
        joined = " ".join(words)
        if count >= SHINGLE_WORDS:
            out.append((at, at + len(line), word, count, joined))
        if not 0 < count < LINE_WORDS:
            close()
            held = 0
        else:
            block.append((at, at + len(line), word, joined))
            held += count
            # A block ends at a line of its own choice, so that copies end alike whatever stands before.
            if held >= 4 * LINE_WORDS or held >= LINE_WORDS and xxhash.xxh3_64_intdigest(joined.encode("utf-8", "surrogatepass")) % 4 == 0:
                close()
                held = 0
        at += len(line) + 1
        word += count
    close()
    return word, out


def paragraphs(docs: DataFrame, placed: bool = True, texts: bool = True) -> DataFrame:
    """Places, digests and texts (words joined by single spaces) of all paragraphs.

    Only ``doc_id`` of the place if not ``placed``; no texts if not ``texts``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in each_slice(batches):
            pieces, owners, totals = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                total, found = _pieces(text)
                pieces += found
                owners += [doc_id] * len(found)
                totals += [total] * len(found)
            if pieces:
                start, stop, word, words, joined = zip(*pieces)
                digests = [xxhash.xxh3_128_digest(j.encode("utf-8", "surrogatepass")) for j in joined]
                places = [owners, start, stop, word, words, totals] if placed else [owners]
                yield _rows_of(places, digests, joined if texts else None)

    read = texts_of(docs).where(F.col("doc_id").isNotNull())
    return read.mapInArrow(frugal(cut), f"{PLACE if placed else 'doc_id long'}, digest binary" + ", text string" * texts)


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the text's word shingles, sorted; a shorter text is one shingle."""
    hashes = word_hashes(text)[0]
    n = max(1, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(hashes))):
        out = out * np.uint64(_BASE) + hashes[k : k + n]
    return np.unique(_mixed(out))


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of all word shingles of many texts, in order, repeats included; a shorter text is one shingle."""
    hashes, _, _, bounds, owner = words_of(texts)
    n = max(0, len(hashes) - SHINGLE_WORDS + 1)
    shingles = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        shingles *= np.uint64(_BASE)
        shingles += hashes[k : k + n]
    inside = np.flatnonzero(owner[:n] == owner[SHINGLE_WORDS - 1 :][:n])
    values, of = _mixed(shingles[inside]), owner[inside]
    short = np.flatnonzero(np.diff(bounds) < SHINGLE_WORDS)
    if len(short):
        values = np.concatenate([values, *(shingle_set(texts[t]) for t in short.tolist())])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        values, of = values[order], of[order]
    return values, of


def _least_hashes(texts: list[str], factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """``[texts, factors]``: the least hash of each text's shingles under every factor, many texts in one go."""
    shingles, owner = _shingles(texts)
    first = np.searchsorted(owner, np.arange(len(texts)))
    out = np.zeros((len(texts), len(factor)), dtype=np.uint64)
    for k in range(len(factor)):
        # The shingle hashes are mixed already, so one multiplication and one addition order them anew.
        out[:, k] = np.minimum.reduceat(shingles * factor[k] + shift[k], first)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    draw = np.random.default_rng(1)
    factor = draw.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    shift = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    for batch in each_slice(batches, 2_000):
        texts, keys = batch.column("text").to_pylist(), []
        for low, high in _together(texts):
            least = _least_hashes(texts[low:high], factor, shift).reshape(high - low, BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (high - low, BANDS))
            for row in range(ROWS):
                key = _mixed(key * np.uint64(_BASE) + least[:, :, row])
            keys.append(key.view(np.int64).ravel())
        if keys:
            lines = np.repeat(batch.column("line").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(np.concatenate(keys))], ["line", "key"])


def linked_roots(sets: list[np.ndarray], similarity: float, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of its component's first one, over links of exact Jaccard ``similarity`` or more.

    A leader is compared with all others at once. Sets that it links need no comparison among each
    other; every set that is left is compared with all, so no link between components is lost.
    ``sides``: only pairs on different sides are compared.
    """
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    labels = np.arange(len(sets))
    covered = np.zeros(len(sets), dtype=bool)
    for leader in range(len(sets)):
        if covered[leader]:
            continue
        place = np.searchsorted(sets[leader], flat)
        hit = sets[leader][np.minimum(place, sizes[leader] - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), bounds)
        near = common >= similarity * (sizes + sizes[leader] - common)
        if sides is not None:
            near &= sides != sides[leader]
        near[leader] = True
        root = labels[near].min()
        labels[np.isin(labels, labels[near])] = root
        if sides is None and not covered.any():
            covered |= near  # the first leader's partners hang together already
    return labels


def _sorted_runs(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort each run of the values in place."""
    ends = bounds.tolist()
    for low, high in zip(ends, ends[1:]):
        values[low:high].sort()


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of many texts one after the other, sorted per text, and where each text's begin."""
    values, of = _shingles(texts)
    _sorted_runs(values, np.searchsorted(of, np.arange(len(texts) + 1)))
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[fresh], np.searchsorted(of[fresh], np.arange(len(texts) + 1))


def _group_starts(held: pa.Table) -> np.ndarray:
    """Rows at which another group begins, the first one included."""
    fresh = np.zeros(held.num_rows, dtype=bool)
    fresh[:1] = True
    for name in ("key", "low", "high"):
        column = held.column(name).to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def _verified(held: pa.Table, first: np.ndarray, similarity: float) -> pa.RecordBatch:
    """Links of many groups, which begin at the rows ``first``: pairs all at once, larger groups one by one."""
    counts = np.diff(np.append(first, held.num_rows))
    lines, blocks = held.column("line").to_numpy(), held.column("block").to_numpy()
    across = (held.column("low").to_numpy() != held.column("high").to_numpy())[first]
    # A text that stands in several groups is hashed once; one that is alone in its group, not at all.
    met = np.flatnonzero(np.repeat(counts, counts) > 1)
    _, at, which = np.unique(lines[met], return_index=True, return_inverse=True)
    texts = held.column("text").take(pa.array(met[at])).to_pylist()
    parts = [shingle_sets(texts[low:high]) for low, high in _together(texts)]
    values = np.concatenate([v for v, _ in parts] or [np.zeros(0, dtype=np.uint64)])
    sizes = np.concatenate([np.diff(b) for _, b in parts] or [np.zeros(0, dtype=np.int64)])
    ends = np.cumsum(sizes)
    place = np.full(held.num_rows, -1)
    place[met] = which

    def sets_of(rows: np.ndarray) -> list[np.ndarray]:
        of = place[rows]
        return [values[low:high] for low, high in zip((ends[of] - sizes[of]).tolist(), ends[of].tolist())]

    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    pairs = first[counts == 2]
    if len(pairs):
        both = np.concatenate(sets_of(np.stack([pairs, pairs + 1], axis=1).ravel()))
        total = sizes[place[pairs]] + sizes[place[pairs + 1]]
        bounds = np.concatenate([[0], np.cumsum(total)])
        _sorted_runs(both, bounds)
        twice = np.zeros(len(both), dtype=np.int64)
        twice[1:] = both[1:] == both[:-1]
        twice[bounds[:-1]] = 0
        common = np.add.reduceat(twice, bounds[:-1])
        near = common >= similarity * (total - common)
        near &= ~across[counts == 2] | (blocks[pairs] != blocks[pairs + 1])
        a.append(lines[pairs[near] + 1])
        b.append(lines[pairs[near]])
    for number in np.flatnonzero(counts > 2).tolist():
        rows = np.arange(first[number], first[number] + counts[number])
        labels = linked_roots(sets_of(rows), similarity, blocks[rows] if across[number] else None)
        other = np.flatnonzero(labels != np.arange(len(labels)))
        a.append(lines[rows[other]])
        b.append(lines[rows[labels[other]]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _verify(similarity: float, together: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size, enough = 0, together
        for batch in each_slice(batches):
            waiting.append(batch)
            size += batch.column("text").nbytes + 100 * batch.num_rows
            if size < enough:
                continue
            # The last group may go on in the next batch.
            held = pa.Table.from_batches(waiting).combine_chunks()
            first = _group_starts(held)
            if len(first) > 1:
                yield _verified(held.slice(0, first[-1]), first[:-1], similarity)
                held = held.slice(first[-1])
            waiting = held.to_batches()
            size = held.column("text").nbytes + 100 * held.num_rows
            enough = max(together, 2 * size)
        if waiting:
            held = pa.Table.from_batches(waiting).combine_chunks()
            if held.num_rows:
                yield _verified(held, _group_starts(held), similarity)

    return run


def similar_paragraphs(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: spanning links between distinct paragraphs (``line, text``) that are similar enough."""
    keys = distinct.select("line", "text").mapInArrow(frugal(_bands), "line long, key long")
    keys = written(keys, "bands", compact=True)
    # Most keys have one paragraph. Those that meet in one band mostly meet in others too: of buckets with the
    # same members (equal count and two equal 64-bit member hashes) one is verified.
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select(F.col("key").alias("__many"))
    keys = written(keys.join(many, F.col("key") == F.col("__many")).select("line", "key"), "met")
    sizes = keys.groupBy("key").agg(
        F.count("*").alias("held"),
        F.min("line").alias("least"),
        F.bit_xor(F.xxhash64("line")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("two"), F.col("line"))).alias("two"),
    )
    sizes = sizes.groupBy("held", "one", "two").agg(F.min("key").alias("key"), F.min("least").alias("least"))
    # A paragraph is the smallest of at most one bucket per band, so no more than that many small ones meet.
    near = F.when(F.col("held") <= SMALL, F.col("least")).otherwise(F.col("key")).alias("near")
    sizes = sizes.select(F.col("key").alias("__key"), near, F.ceil(F.col("held") / BLOCK).cast("int").alias("parts"))
    placed = keys.join(sizes, F.col("key") == F.col("__key")).withColumn(
        "block", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "line", "near", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    full = met.join(distinct.select("line", "text"), "line")
    dealt = full.repartition("near", "low", "high").sortWithinPartitions("near", "low", "high", "key", "line")
    return dealt.select("key", "line", "block", "low", "high", "text").mapInArrow(frugal(_verify(similarity)), "a long, b long")


def paragraph_repeats(docs: DataFrame) -> DataFrame:
    """Places of paragraphs whose component stands in more than one document, with who keeps them."""
    lines = paragraphs(docs, placed=False)
    # Copies collapse before anything is compared; the smallest and largest holder tell whether they repeat.
    holders = lines.groupBy("digest").agg(
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"),
        F.count(F.lit(1)).alias("held"),
        F.first("text").alias("text"),
    )
    distinct = written(holders.withColumn("line", F.monotonically_increasing_id()), "paragraphs", compact=True)
    roots = components(durable(similar_paragraphs(distinct)))
    rooted = distinct.select("digest", "line", "first", "last", "held").join(roots, F.col("line") == F.col("node"), "left")
    rooted = durable(rooted.select("digest", "first", "last", "held", F.coalesce("root", "line").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("keeper"), F.max("last").alias("until"))
    kept = kept.where("keeper <> until").select(F.col("root").alias("__root"), "keeper")
    shared = rooted.join(kept, F.col("root") == F.col("__root")).select("digest", "keeper", "held")
    return _places_of(paragraphs(docs, texts=False), written(shared, "repeated")).withColumn("exact", F.lit(False))


def _long_enough(spans: list[dict], least: int) -> list[dict]:
    """The places that stand in a row of repeated words with a window in it, of ``least`` words, or of all words."""
    out: list[dict] = []
    row: list[dict] = []
    end = 0

    def close() -> None:
        if row and (any(s["exact"] for s in row) or end - row[0]["word"] >= min(least, row[0]["total"])):
            out.extend(row)

    for span in sorted(spans, key=lambda s: s["word"]):
        if row and span["word"] > end:
            close()
            row, end = [], 0
        row.append(span)
        end = max(end, span["word"] + span["words"])
    close()
    return out


def _merged(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, spans in zip(batch["doc_id"], batch["spans"]):
                joined: list | None = None
                for s in sorted(_long_enough(spans, least), key=lambda s: (s["keeper"], s["word"], s["words"])):
                    if joined is not None and s["keeper"] == joined[3] and s["word"] <= joined[5]:
                        joined[2] = max(joined[2], s["stop"])
                        joined[5] = max(joined[5], s["word"] + s["words"])
                        continue
                    if joined is not None:
                        out.append(tuple(joined[:5]))
                    joined = [doc_id, s["start"], s["stop"], s["keeper"], s["keeper"] == doc_id, s["word"] + s["words"]]
                if joined is not None:
                    out.append(tuple(joined[:5]))
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "keeper_id", "kept"])

    return run


def removals(passages: DataFrame) -> DataFrame:
    """``doc_id, spans``: what is cut from each document, as sorted and disjoint ``start, stop``."""
    start = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        meets = (F.size(done) > 0) & (span["start"] <= last["stop"])
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    spans = F.array_sort(F.collect_list(F.struct("start", "stop")))
    return passages.where("not kept").groupBy("doc_id").agg(F.aggregate(spans, start, step).alias("spans"))


def repeated_passages(docs: DataFrame, least: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, start, stop, keeper_id, kept``: the passages of each document that others repeat.

    Spans are in code points, the end exclusive; overlapping and neighbouring spans with one keeper are joined, and those
    with different keepers are rows of their own, so no keeper is lost. Repeated paragraphs in a row that hold fewer
    than ``least`` words together have no row, unless they are the whole document. ``kept`` rows stand in the document that keeps the passage, all
    others are removals. A document with neither has no row. Repeats inside one document alone are
    left. Null and blank texts have no passages, rows with a null id neither keep nor lose any, rows
    that share an id count as one document, an empty table gives no rows, other columns are ignored.
    """
    ship_package(docs.sparkSession)
    spans = window_repeats(docs).unionByName(paragraph_repeats(docs))
    place = F.struct("start", "stop", "word", "words", "total", "keeper", "exact")
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(place).alias("spans"))
    return durable(per_doc.mapInPandas(frugal(_merged(least)), "doc_id long, start long, stop long, keeper_id long, kept boolean"))


def clustered(passages: DataFrame) -> DataFrame:
    """The passages with ``component_id``: the smallest ``doc_id`` reachable over shared passages."""
    edges = passages.select(F.col("doc_id").alias("a"), F.col("keeper_id").alias("b"))
    roots = components(edges)
    joined = passages.join(roots, F.col("doc_id") == F.col("node"), "left")
    return joined.select(*passages.columns, F.coalesce("root", "doc_id").alias("component_id"))


def without(text: Column, spans: Column) -> Column:
    """The text without ``spans`` (sorted, disjoint ``start, stop``); white space around a cut is not doubled."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, span: Column) -> Column:
        part = F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        return F.struct(span["stop"].alias("at"), F.concat(done["out"], F.array(part)).alias("out"))

    def finish(done: Column) -> Column:
        rest = F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(done["out"], F.array(rest))

    parts = F.aggregate(spans, start, step, finish)
    return F.array_join(F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" "))), lambda p: p != ""), " ")

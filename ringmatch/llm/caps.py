"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a random product code: a direction is one codeword per block of coordinates,
so a few hundred codewords span many thousand directions, and a vector finds all directions within
its cap by list-decoding block by block. Vectors that share a filter are compared by sketches of a byte per
coordinate, with a bound on what those leave out; the few that may have a partner there are then compared
exactly. So only those bring vectors and lists of filters along. A pair is counted in the first filter that
both share, so nothing has to be made distinct afterwards. Copies of a vector are one row.

Vectors with directions in common would crowd into the same filters. Directions that a bounded sample shows to be
common are left out of the coordinates that are filtered: what two near vectors differ by does not grow by that, so
they stay near in the rest, by a bound that follows from the length of their rest. Vectors with a shorter rest than
planned are compared with all others in blocks. How many directions go, how long the rest must be and how large the
caps are is what costs least by the sample's cosines; links are decided on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import durable, each_run, ship_package
from ringmatch.llm.components import components
from ringmatch.llm.vectors import matrix, usable, usable_vectors

#: Unrelated vectors in a filter on average that are tried; the cap's height follows from it.
FILTER_ROWS = (64, 16, 4)
#: Vectors in the sample that the plan is made from, and numbers of common directions that are tried.
SAMPLE = 4_096
COMMON = (0, 1, 2, 4, 8)
#: Shares of vectors whose rest may be shorter than planned, so that they are compared with all.
SHORT = (0.0, 0.001, 0.01)
#: Putting a vector into one more filter costs as much as comparing it with so many.
MEMBER_ROWS = 40
#: Filters per code that two vectors at the least similarity share on average. Several turned codes miss far
#: fewer pairs than one of the same total size.
SHARED = 2
#: Codes are added until of so many random pairs at the least similarity each shares ``LEAST_SHARED`` filters.
PAIRS = 4_000
LEAST_SHARED = 3
MOST_CODES = 256
#: Codewords per block at most; more directions take more blocks.
CODEWORDS = 512
#: A filter with more vectors is compared in pairs of blocks of about this size.
BLOCK = 1_024
#: Groups of up to so many vectors are compared many at a time, and so many values at once.
SMALL_GROUP, VALUES = 256, 1 << 21
#: More than single precision errs in the cosine of two sketches.
SKETCH_SLACK = 1e-4


@lru_cache(maxsize=32)
def sphere_tail(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, rising, and the share of the unit sphere that has at least this cosine to a direction."""
    if dimension < 2:
        return np.array([-1.0, np.nextafter(-1.0, 0.0), 1.0]), np.array([1.0, 0.5, 0.5])
    angle = np.linspace(0, math.pi, 200_001)
    middle = (angle[1:] + angle[:-1]) / 2
    weight = np.exp((dimension - 2) * np.log(np.sin(middle)))
    share = np.concatenate([[0.0], np.cumsum(weight)])
    return np.cos(angle)[::-1], (share / share[-1])[::-1]


def cap_height(dimension: int, share: float, similarity: float) -> float:
    """The cosine above which a vector meets a direction with probability ``share``.

    Not above ``similarity``: in few dimensions smaller caps would hold hardly any of the near pairs.
    """
    cosine, tail = sphere_tail(dimension)
    return min(similarity, float(np.interp(share, tail[::-1], cosine[::-1])))


def both_above(dimension: int, height: float, similarity: float) -> float:
    """Probability that two vectors of this cosine both have cosine ``height`` or more to a random direction."""
    cosine, tail = sphere_tail(dimension)
    if dimension < 2:
        return 0.5
    other, other_tail = sphere_tail(dimension - 1)
    middle, share = (cosine[1:] + cosine[:-1]) / 2, tail[:-1] - tail[1:]
    high = middle >= height
    middle, share = middle[high], share[high]
    spread = np.sqrt(np.maximum(1e-12, (1 - similarity**2) * (1 - middle * middle)))
    return float((share * np.interp((height - similarity * middle) / spread, other, other_tail)).sum())


def pairs_at(dimension: int, similarity: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at this cosine (in one dimension: equal ones)."""
    draw = np.random.default_rng(seed)
    a = _unit(draw.standard_normal((count, dimension)))
    if dimension < 2:
        return a, a
    b = draw.standard_normal(a.shape)
    b = _unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    return a, similarity * a + math.sqrt(max(0.0, 1 - similarity**2)) * b


class ProductCode:
    """Directions as products of codewords; fixed by its arguments."""

    def __init__(self, dimension: int, blocks: int, width: int, height: float, seed: int):
        self.made_from = (dimension, blocks, width, height, seed)
        self.blocks, self.width, self.height = blocks, width, height
        draw = np.random.default_rng(seed)
        # The signs make every rotation equally likely, so a pair's chances depend on its cosine alone.
        q, r = np.linalg.qr(draw.standard_normal((dimension, dimension)))
        self.turn = q * np.where(np.diag(r) < 0, -1.0, 1.0)
        self.parts = np.array_split(np.arange(dimension), self.blocks)
        self.words = []
        for part in self.parts:
            word = draw.standard_normal((self.width, len(part)))
            # Scaled so that a block's product deviates as its share of a Gaussian direction does.
            word *= math.sqrt(len(part)) / np.linalg.norm(word, axis=1, keepdims=True)
            self.words.append(word)

    def __reduce__(self):
        return ProductCode, self.made_from

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and direction numbers of all caps that hold the unit vectors."""
        turned = unit @ self.turn
        products = [turned[:, p] @ w.T for p, w in zip(self.parts, self.words)]
        best_left = np.zeros((self.blocks + 1, len(unit)))
        for b in range(self.blocks - 1, -1, -1):
            best_left[b] = best_left[b + 1] + products[b].max(axis=1)
        row = np.arange(len(unit))
        code = np.zeros(len(unit), dtype=np.int64)
        total = np.zeros(len(unit))
        for b in range(self.blocks):
            rows, codes, totals = [], [], []
            step = max(1, 4_000_000 // self.width)
            for s in range(0, len(row), step):
                r = row[s : s + step]
                grown = total[s : s + step, None] + products[b][r]
                at, word = np.nonzero(grown + best_left[b + 1][r][:, None] >= self.height)
                rows.append(r[at])
                codes.append(code[s : s + step][at] * self.width + word)
                totals.append(grown[at, word])
            row, code, total = np.concatenate(rows), np.concatenate(codes), np.concatenate(totals)
        return row, code

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many directions hold both ``a[k]`` and ``b[k]``."""
        size = self.width**self.blocks
        (row, x), (other, y) = self.decode(a), self.decode(b)
        return np.bincount(np.intersect1d(row * size + x, other * size + y) // size, minlength=len(a))


class Filters:
    """All codes; a filter's number tells its code.

    How many codes it takes is measured: products of codewords are no independent directions, and the
    sphere's tails depend on the dimension. As the codes are turned at random, what random pairs of a
    cosine show holds for the pairs of any table. ``whole`` is false if too few of the pairs meet with as many codes
    as there may be; then filters are no way to find them.
    """

    def __init__(self, dimension: int, rows: int, similarity: float, filter_rows: float = FILTER_ROWS[0]):
        cosine = cap_height(dimension, min(0.25, filter_rows / max(rows, 1)), similarity)
        wanted = max(64.0, SHARED / max(1e-12, both_above(dimension, cosine, similarity)))
        blocks = min(dimension, max(2, math.ceil(math.log(wanted) / math.log(CODEWORDS))))
        width = min(CODEWORDS, math.ceil(wanted ** (1 / blocks)))
        a, b = pairs_at(dimension, similarity, PAIRS, 11)
        shared = np.zeros(PAIRS, dtype=np.int64)
        self.codes = []
        while shared.min() < LEAST_SHARED and len(self.codes) < MOST_CODES:
            code = ProductCode(dimension, blocks, width, cosine * math.sqrt(dimension), len(self.codes))
            self.codes.append(code)
            shared += code.shared(a, b)
        self.whole = bool(shared.all())
        self.per_code = width**blocks
        #: Numbers of filters take 64 bits where 32 do not hold them.
        self.number = np.int32 if self.per_code * len(self.codes) < 1 << 31 else np.int64

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per row and, row by row, the ascending numbers of the filters that hold it."""
        rows, numbers = [], []
        for k, code in enumerate(self.codes):
            row, number = code.decode(unit)
            rows.append(row)
            numbers.append(number + k * self.per_code)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        order = np.lexsort((number, row))
        offsets = np.searchsorted(row[order], np.arange(len(unit) + 1))
        return offsets.astype(np.int32), number[order].astype(self.number)


class Plan:
    """The coordinates that are filtered, the least length of a vector in them, and the filters."""

    def __init__(self, sample: np.ndarray, rows: int, similarity: float):
        dimension = sample.shape[1]
        unit = _unit(sample)
        _, turned = np.linalg.eigh(unit.T @ unit)
        draw = np.random.default_rng(3)
        i, j = draw.integers(0, len(unit), (2, 20_000))
        i, j = i[i != j], j[i != j]
        least = None
        for common in COMMON:
            if common and (dimension - common < 8 or len(unit) < 64):
                break
            rest = unit @ turned[:, : dimension - common]
            length = np.sqrt((rest * rest).sum(axis=1))
            fine = length > 1e-6
            cosine = ((rest[i] * rest[j]).sum(axis=1) / np.maximum(length[i] * length[j], 1e-12))[fine[i] & fine[j]]
            for short in SHORT if common else SHORT[:1]:
                reach = float(np.quantile(length, short)) if common else 1.0
                near = 1 - (1 - similarity) / max(reach * reach, 1e-9)
                if common and near < 0.5:
                    continue
                for filter_rows in FILTER_ROWS:
                    cost = self._cost(dimension - common, rows, near, filter_rows, cosine) + short * rows
                    if least is None or cost < least[0]:
                        least = (cost, common, reach if common else 0.0, near, filter_rows)
        _, common, self.reach, near, filter_rows = least
        self.turn = None if not common else np.ascontiguousarray(turned[:, : dimension - common])
        self.filters = Filters(dimension - common, rows, near if common else similarity, filter_rows)
        if not self.filters.whole:
            self.reach = math.inf  # no filters: all are compared with all

    @staticmethod
    def _cost(dimension: int, rows: int, near: float, filter_rows: float, cosine: np.ndarray) -> float:
        """Vectors that one is compared with, filters that it is put into counted along."""
        height = cap_height(dimension, min(0.25, filter_rows / max(rows, 1)), near)
        steps = np.linspace(-0.3, 1.0, 14)
        met = np.array([both_above(dimension, height, x) for x in steps.tolist()])
        filters = 3 * LEAST_SHARED / max(1e-12, both_above(dimension, height, near))
        share = both_above(dimension, height, 1.0)
        unrelated = float(np.interp(cosine, steps, met).mean()) if len(cosine) else share * share
        return filters * (unrelated * rows + MEMBER_ROWS * share)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets and filters as :meth:`Filters.decode`, and which rows are compared with all instead."""
        unit = _unit(x)
        if self.turn is not None:
            unit = unit @ self.turn
        length = np.sqrt((unit * unit).sum(axis=1))
        short = length < self.reach
        if short.all():
            return np.zeros(len(x) + 1, dtype=np.int32), np.zeros(0, dtype=self.filters.number), short
        row = np.flatnonzero(~short)
        offsets, numbers = self.filters.decode(unit[row] / length[row, None])
        sizes = np.zeros(len(x), dtype=np.int32)
        sizes[row] = np.diff(offsets)
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), numbers, short


def _decode(plan: Plan, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                x = matrix(part.column(1), dimension)
                offsets, numbers, short = plan.decode(x)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers))
                columns = [part.column(0), lists, pa.array(short), pa.array(list(map(bytes, sketches(x))), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["class_id", "filters", "short", "sketch"])

    return run


def sketches(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: two single-precision numbers, the step and the error, then a signed byte per coordinate.

    Step times bytes is no farther from the unit vector than the error. The error's square is added to it, so that the
    cosine of two vectors is at most that of their sketches plus both errors.
    """
    unit = _unit(x)
    step = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    small = np.rint(unit / step[:, None]).clip(-127, 127)
    rest = unit - small * step[:, None].astype(np.float64)
    error = np.sqrt((rest * rest).sum(axis=1))
    head = np.stack([step, (error + error * error).astype(np.float32)], axis=1)
    return np.concatenate([head.view(np.uint8), small.astype(np.int8).view(np.uint8)], axis=1)


def may_link(sketch: np.ndarray, side: np.ndarray, starts: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows may reach ``similarity`` with another row of their group; groups begin at ``starts``.

    ``side`` 0: with any row of the group; else only with rows of the other side.
    """
    sizes = np.diff(np.append(starts, len(sketch)))
    head = np.ascontiguousarray(sketch[:, :8]).view(np.float32)
    unit = sketch[:, 8:].view(np.int8) * head[:, :1]
    error, found = head[:, 1], np.zeros(len(sketch), dtype=bool)
    least = np.float32(similarity - SKETCH_SLACK)
    # Groups of about one size, filled up to the largest, are one array.
    width = np.where(sizes > SMALL_GROUP, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64))
    for wide in np.unique(width[sizes > 1]).tolist():
        groups = np.flatnonzero((width == wide) & (sizes > 1))
        step = max(1, VALUES // (wide * max(wide, unit.shape[1])))
        for s in range(0, len(groups), step):
            first, size = starts[groups[s : s + step]], sizes[groups[s : s + step]]
            there = np.arange(wide) < size[:, None]
            row = np.where(there, first[:, None] + np.arange(wide), first[:, None])
            held = unit[row]
            cosine = np.matmul(held, held.transpose(0, 2, 1))
            near = cosine + error[row][:, :, None] >= least - error[row][:, None, :]
            if side.any():
                of = side[row]
                near &= (of[:, :, None] != of[:, None, :]) | (of[:, :, None] == 0)
            near &= there[:, None, :]
            near[:, np.arange(wide), np.arange(wide)] = False
            found[row[near.any(axis=2) & there]] = True
    return found


def _may_link(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            data = rows.column("sketch").combine_chunks()
            width = len(data[0].as_py())
            sketch = np.frombuffer(data.buffers()[2], dtype=np.uint8)[data.offset * width :][: len(data) * width]
            some = may_link(sketch.reshape(-1, width), rows.column("side").to_numpy(), starts, similarity)
            kept = rows.select(["filter", "class_id"]).filter(pa.array(some)).combine_chunks()
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], ["filter", "class_id"])

        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks()
            keys = [rows.column(c).to_numpy() for c in ("filter", "pair")]
            new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
            starts = np.flatnonzero(new)
            # The last group may go on in the next batch.
            waiting = rows.slice(int(starts[-1]))
            if len(starts) > 1:
                yield found(rows.slice(0, int(starts[-1])).combine_chunks(), starts[:-1])
        if waiting is not None:
            yield found(waiting.combine_chunks(), np.zeros(1, dtype=np.int64))

    return run


def _open_members(lists: DataFrame, kind: str, similarity: float) -> DataFrame:
    """``filter, class_id``: vectors that may have a partner in the filter, by their sketches."""
    held = lists.select("class_id", "sketch", F.explode("filters").alias("filter"))
    large = held.groupBy("filter").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK)
    large = durable(large.select(F.col("filter").alias("__filter"), F.ceil(F.col("held") / BLOCK).cast("int").alias("parts")))
    zero = F.lit(0).cast("byte")
    if large.isEmpty():
        met = held.select("filter", F.lit(0).cast("long").alias("pair"), zero.alias("side"), "class_id", "sketch")
    else:
        # A block meets itself and every other block of its filter.
        parts = F.coalesce("parts", F.lit(1))
        block = F.pmod(F.xxhash64("class_id"), parts).cast("long")
        placed = held.join(large, F.col("filter") == F.col("__filter"), "left").withColumn("block", block)
        met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).select(
            "filter",
            (F.least("block", "other") * parts + F.greatest("block", "other")).alias("pair"),
            F.when(F.col("block") < F.col("other"), 1).when(F.col("block") > F.col("other"), 2).otherwise(0).cast("byte").alias("side"),
            "class_id",
            "sketch",
        )
    dealt = met.repartition("filter", "pair").sortWithinPartitions("filter", "pair")
    return dealt.mapInArrow(_may_link(similarity), f"filter {kind}, class_id long").distinct()


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


LINKS = "class_id long, links long, root long"


def link_group(
    number: int,
    ids: np.ndarray,
    x: np.ndarray,
    weight: np.ndarray,
    filters: list[np.ndarray],
    block: np.ndarray,
    only_across: bool,
    similarity: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links found in one filter: per linked row its partners' weight, counted here first, and a root.

    ``only_across``: just pairs between the two blocks (pairs inside a block are another group's).
    """
    unit = _unit(x)
    near = unit @ unit.T >= similarity
    if only_across:
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, False)
    linked = np.flatnonzero(near.any(axis=1))
    if not len(linked):
        return None
    near = near[np.ix_(linked, linked)]
    ids, weight = ids[linked], weight[linked]
    # Pairs that share a smaller filter were counted there.
    earlier = [filters[k][filters[k] < number] for k in linked]
    known, place = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(known):
        held = np.zeros((len(linked), len(known)), dtype=np.float32)
        held[np.repeat(np.arange(len(linked)), [len(e) for e in earlier]), place] = 1
        near &= held @ held.T < 0.5
    counted = (near * weight[None, :]).sum(axis=1)
    labels = np.arange(len(linked))
    order = np.argsort(ids, kind="stable")
    near = near[np.ix_(order, order)]
    while True:
        new = np.minimum(labels, np.where(near, labels[None, :], len(linked)).min(axis=1))
        new = new[new]
        if np.array_equal(new, labels):
            break
        labels = new
    root = np.empty_like(ids)
    root[order] = ids[order][labels]
    some = counted > 0
    return (ids[some], counted[some], root[some]) if some.any() else None


def _link(dimension: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in each_run(batches, "group"):
            held = pa.Table.from_batches(list(parts)).combine_chunks()
            if held.num_rows < 2:
                continue
            lists = held.column("filters").combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = link_group(
                held.column("filter")[0].as_py(),
                held.column("class_id").to_numpy(),
                matrix(held.column("embedding").combine_chunks(), dimension),
                held.column("n").to_numpy(),
                [flat[s:e] for s, e in zip(offsets, offsets[1:])],
                held.column("block").to_numpy(),
                held.column("low")[0].as_py() != held.column("high")[0].as_py(),
                similarity,
            )
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["class_id", "links", "root"])

    return run


def _link_short(dimension: int, similarity: float):
    """Groups of a block of short vectors and a block of all: links of the former to the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in each_run(batches, "group"):
            held = pa.Table.from_batches(list(parts)).combine_chunks()
            asks = held.column("asks").to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            ids, n = held.column("class_id").to_numpy(), held.column("n").to_numpy()
            short = held.column("short").to_numpy(zero_copy_only=False)
            unit = _unit(matrix(held.column("embedding").combine_chunks(), dimension))
            near = (unit[asks] @ unit[~asks].T >= similarity) & (ids[asks][:, None] != ids[~asks][None, :])
            row, column = np.nonzero(near)
            if not len(row):
                continue
            a, b = ids[asks][row], ids[~asks][column]
            # A pair of two short ones is met from both sides and counted for the one that asks.
            back = ~short[~asks][column]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, b[back]])),
                    pa.array(np.concatenate([n[~asks][column], n[asks][row[back]]])),
                    pa.array(np.concatenate([b, a[back]])),
                ],
                ["class_id", "links", "root"],
            )

    return run


def _short_links(full: DataFrame, total: int, dimension: int, similarity: float) -> DataFrame | None:
    """Links of the short vectors to all others, block by block; None if there are none."""
    asking = full.where("short")
    count = asking.count()
    if not count:
        return None
    blocks, asked = max(1, math.ceil(total / BLOCK)), max(1, math.ceil(count / BLOCK))
    columns = ["class_id", "embedding", "n", "short"]

    def side(rows: DataFrame, own: int, others: int, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("class_id"), F.lit(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        placed = rows.select(*columns, mine.alias("mine"), each.alias("other"), F.lit(asks).alias("asks"))
        return placed.withColumn("group", F.concat_ws(":", *(("mine", "other") if asks else ("other", "mine"))))

    both = side(asking, asked, blocks, True).unionByName(side(full, blocks, asked, False))
    dealt = both.repartition(F.col("group")).sortWithinPartitions("group")
    return dealt.select("group", *columns, "asks").mapInArrow(_link_short(dimension, similarity), LINKS)


def near_vectors(vectors: DataFrame, similarity: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Two vectors link if a shared filter finds them and their cosine in double precision is at least
    ``similarity``; copies always link. ``component_id`` is the smallest ``vec_id`` reachable. Null,
    zero and non-finite vectors, and those of another dimension than most, link with nothing, nor do
    rows with a null id (their ``component_id`` is null and ``kept`` false). A repeated row counts
    as a vector of its own. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows, dimension = usable_vectors(vectors)
    classes = durable(rows.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")))
    total = classes.count()
    alone = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not total:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    share = min(1.0, 2 * SAMPLE / total)
    picked = classes.where(F.pmod(F.xxhash64("class_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = [r["embedding"] for r in picked.orderBy(F.xxhash64("class_id")).limit(SAMPLE).select("embedding").collect()]
    if not sample:
        sample = [classes.first()["embedding"]]
    plan = Plan(np.array(sample, dtype=np.float64), total, similarity)
    kind = "int" if plan.filters.number is np.int32 else "long"
    schema = f"class_id long, filters array<{kind}>, short boolean, sketch binary"
    lists = durable(classes.select("class_id", "embedding").mapInArrow(_decode(plan, dimension), schema))
    members = durable(_open_members(lists, kind, similarity))
    lists = lists.drop("sketch")
    sizes = members.groupBy("filter").agg(F.count("*").alias("held")).where("held > 1")
    sizes = durable(sizes.select(F.col("filter").alias("__filter"), F.ceil(F.col("held") / BLOCK).cast("int").alias("parts")))
    # A block meets itself and every other block of its filter.
    placed = members.join(sizes, F.col("filter") == F.col("__filter")).withColumn(
        "block", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "class_id", "filter", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    full = classes.select("class_id", "embedding", "n").join(lists, "class_id")
    dealt = met.join(full.drop("short"), "class_id").withColumn("group", F.concat_ws(":", "filter", "low", "high"))
    # Only smaller filters matter in a group: the pair may have been counted there.
    dealt = dealt.withColumn("filters", F.filter("filters", lambda f: f < F.col("filter")))
    dealt = dealt.repartition(F.col("group")).sortWithinPartitions("group")
    found = dealt.mapInArrow(_link(dimension, similarity), LINKS)
    more = _short_links(full.drop("filters"), total, dimension, similarity) if plan.reach else None
    found = durable(found if more is None else found.unionByName(more))
    partners = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    by_class = durable(
        classes.join(partners, "class_id", "left")
        .join(roots, F.col("class_id") == F.col("node"), "left")
        .select(
            F.col("embedding").alias("__embedding"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "class_id").alias("component_id"),
        )
    )
    linked = rows.join(by_class, F.col("embedding") == F.col("__embedding")).select("vec_id", "n_links", "component_id")
    part = usable() & F.col("vec_id").isNotNull() & (F.size("embedding") == dimension)
    others = vectors.where(~F.coalesce(part, F.lit(False))).select("vec_id")
    others = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )

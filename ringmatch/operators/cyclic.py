"""Exact cyclic retrieval: positive scores, candidate lists, all-pairs ranks and top-1.

Queries: ``query_id, fov_deg, positive_id, direction, valid``; gallery: ``id, direction``.
Directions are flat ``angular_bins x channels`` double arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.functions import kernels as K
from ringmatch.functions.vectors import SCALE
from ringmatch.operators.blocks import BlockStore, StreamPlan, locate, plan_for, read_batches, scratch_store, stream
from ringmatch.session import ship_package

QUERY_KEY = ["query_id", "fov_deg"]
SUB_PAIRS = 1 << 14
#: Queries and gallery rows that are scored at once in single precision, the latter a multiple of 8. Four arrays of
#: their scores should nearly fit a core's cache.
ROWS, COLUMNS = 512, 512
#: A query of which bounds leave more entries of ``COLUMNS`` open is scored against them all. Scoring one in double
#: precision costs as much as bounding some hundreds.
FEW = 2
#: Why a pair is scored in double precision: it may be ahead, it may be the best, it is the query's own.
COUNTS, LEADS, OWN = 1, 2, 4
#: Such pairs that a task keeps before it scores them.
MOST_OPEN = 1 << 16
#: Lengths that bounds are made of are rounded up by this.
BOUND_ROUNDING = np.float32(1 + 2.0**-20)
#: Bytes that a task holds per listed target: its id, the query that asks and the block that has it.
TARGET_BYTES = 160
#: Descriptors as long as this are scored in double precision only.
SAFE_LENGTH = 1e15
#: Queries of one positive that meet one copy of its tile; a tile that more of them share is copied.
SHARERS = 4_096


def _values(rows: DataFrame, column: str) -> int:
    """Bytes of one value of an array column."""
    return 4 if rows.schema[column].dataType.elementType.typeName() == "float" else 8


def _read_queries(table: pa.Table | pa.RecordBatch, bins: int, channels: int):
    direction = K.list_matrix(table.column("direction"), bins * channels).reshape(-1, bins, channels)
    valid = K.list_matrix(table.column("valid"), bins)
    masked, divisor = K.masked_queries(direction, valid)
    return K.real_spectrum(masked), divisor


def _read_gallery(directions: pa.Array | pa.ChunkedArray, bins: int, channels: int):
    direction = K.list_matrix(directions, bins * channels).reshape(-1, bins, channels)
    spectrum = K.real_spectrum(direction)
    return spectrum, K.quarter_turn(spectrum)


def _row_steps(count: int, bins: int, channels: int) -> Iterator[slice]:
    """Slices of row-aligned pairs whose spectra stay within some megabytes."""
    step = max(1, (32 << 20) // (16 * (bins + 2) * channels))
    for start in range(0, count, step):
        yield slice(start, min(start + step, count))


def _types(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)


def gallery_store(gallery: DataFrame, angular_bins: int, channels: int, count: int | None = None) -> BlockStore:
    """The gallery's descriptors as a block store in the shared scratch folder."""
    size = angular_bins * channels * _values(gallery, "direction")
    return scratch_store(gallery.select("id", "direction"), gallery.count() if count is None else count, size)


def _plan(queries: DataFrame, gallery: DataFrame, store: BlockStore, bins: int, channels: int, query_rows: int | None) -> StreamPlan:
    query_rows = queries.count() if query_rows is None else query_rows
    query_bytes = bins * channels * _values(queries, "direction")
    return plan_for(queries, store, query_rows, query_bytes, bins * channels * _values(gallery, "direction"))


def score_pairs(
    pairs: DataFrame,
    queries: DataFrame,
    gallery: DataFrame,
    angular_bins: int,
    channels: int,
    sizes=None,
    store: BlockStore | None = None,
    plan: StreamPlan | None = None,
) -> DataFrame:
    """Exact score and shift for a list of (query_id, fov_deg, gallery_id) pairs.

    A query travels once, with the list of its targets; a task reads the blocks that its queries ask
    for, each once. So a gallery row that is everybody's candidate is no hot spot, and pairs never
    meet descriptors in a join. Pairs that name an unknown query or row are left out; a pair that is
    listed twice is scored twice.
    """
    query_rows, gallery_rows = sizes or (None, None)
    store = store or gallery_store(gallery, angular_bins, channels, gallery_rows)
    if plan is None:
        query_rows = queries.count() if query_rows is None else query_rows
        row_bytes = angular_bins * channels * _values(queries, "direction")
        listed = math.ceil(pairs.count() / max(1, query_rows))
        plan = plan_for(queries, store, query_rows, row_bytes + TARGET_BYTES * listed, angular_bins * channels * _values(gallery, "direction"))
    targets = pairs.groupBy(*QUERY_KEY).agg(F.collect_list("gallery_id").alias("targets"))
    held = targets.join(queries.select(*QUERY_KEY, "direction", "valid"), QUERY_KEY)
    inverse = K.inverse_transform(angular_bins)
    row_bytes = angular_bins * channels * _values(gallery, "direction")

    def kernel(q: pa.Table, blocks) -> Iterator[pa.RecordBatch]:
        lists = q.column("targets").combine_chunks()
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        wanted = lists.flatten()
        block_of = locate(wanted.to_pylist(), blocks)
        keys = [q.column(c).combine_chunks() for c in QUERY_KEY]
        vectors = q.select(["direction", "valid"])
        for number in np.unique(block_of[block_of >= 0]).tolist():
            asked = np.flatnonzero(block_of == number)
            names = wanted.take(pa.array(asked))
            for _, batch in read_batches(blocks[number : number + 1], row_bytes):
                place = pc.index_in(names, value_set=batch.column("id"))
                met = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                column = place.take(pa.array(met)).to_numpy(zero_copy_only=False)
                for part in _row_steps(len(met), angular_bins, channels):
                    pair = asked[met[part]]
                    query, divisor = _read_queries(vectors.take(pa.array(owner[pair])), angular_bins, channels)
                    tiles, turned = _read_gallery(batch.column("direction").take(pa.array(column[part])), angular_bins, channels)
                    score, shift = K.best_shift(K.pair_logits(query, tiles, turned, divisor, inverse))
                    yield pa.RecordBatch.from_arrays(
                        [k.take(pa.array(owner[pair])) for k in keys]
                        + [wanted.take(pa.array(pair)), pa.array(score.astype(np.int64)), pa.array(shift)],
                        names=[*QUERY_KEY, "gallery_id", "score_q", "shift"],
                    )

    schema = f"{_types(queries, QUERY_KEY)}, gallery_id string, score_q bigint, shift bigint"
    return stream(held, QUERY_KEY, store, plan, kernel, schema)


def with_positive_scores(queries: DataFrame, gallery: DataFrame, angular_bins: int, channels: int) -> DataFrame:
    """Queries with the score and shift of their own gallery entry.

    One equi-join. A tile that many queries share is copied once per ``SHARERS`` of them, and its queries are
    dealt over the copies. Queries without an entry are left out; check for them beforehand.
    """
    shared = queries.groupBy("positive_id").agg(F.ceil(F.count(F.lit(1)) / SHARERS).cast("int").alias("copies"))
    hot = shared.filter("copies > 1")
    own = queries.select(*QUERY_KEY, "positive_id", "direction", "valid").join(hot, "positive_id", "left")
    own = own.withColumn("_copy", F.pmod(F.xxhash64(*QUERY_KEY), F.coalesce("copies", F.lit(1))).cast("int"))
    tiles = gallery.select(F.col("id").alias("positive_id"), F.col("direction").alias("tile")).join(hot, "positive_id", "left")
    tiles = tiles.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    met = own.drop("copies").join(tiles.drop("copies"), ["positive_id", "_copy"])
    inverse = K.inverse_transform(angular_bins)
    keep = [*QUERY_KEY, "positive_id", "direction", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _row_steps(batch.num_rows, angular_bins, channels):
                rows = batch.slice(part.start, part.stop - part.start)
                query, divisor = _read_queries(rows, angular_bins, channels)
                tile, turned = _read_gallery(rows.column("tile"), angular_bins, channels)
                score, shift = K.best_shift(K.pair_logits(query, tile, turned, divisor, inverse))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in keep] + [pa.array(score.astype(np.int64)), pa.array(shift)],
                    names=[*keep, "positive_score_q", "positive_shift"],
                )

    ship_package(queries.sparkSession)
    return met.mapInArrow(run, f"{_types(queries, keep)}, positive_score_q bigint, positive_shift bigint")


def positive_scores(queries: DataFrame, gallery: DataFrame, angular_bins: int, channels: int) -> DataFrame:
    """Score and shift of every query against its own gallery entry."""
    return with_positive_scores(queries, gallery, angular_bins, channels).drop("direction", "valid")


def aligned_candidates(
    queries: DataFrame, gallery: DataFrame, candidates: DataFrame, angular_bins: int, channels: int, **options
) -> DataFrame:
    """Scores of each query's own candidate list (``query_id, fov_deg, candidates``)."""
    pairs = candidates.select(*QUERY_KEY, F.explode("candidates").alias("gallery_id"))
    return score_pairs(pairs, queries, gallery, angular_bins, channels, **options)


class _Group(NamedTuple):
    """Held queries whose single-precision products have the same length."""

    at: np.ndarray
    fold: int
    query: np.ndarray
    #: Lengths of the subtracted halves, if bounds decide nearly all pairs of these queries.
    odd: np.ndarray | None


class _Running:
    """Of the queries a task holds: entries ahead of the positive so far, and the best entry so far.

    All pairs are scored in single precision, or bounded where bounds rule nearly all entries out. Where that and its
    error bound do not decide whether an entry is ahead, or where it may be the best one, the pair is scored in double
    precision, so the result is that of double precision throughout. Entries behind the positive are not looked at
    further: the best entry is one only if it is not behind it.
    """

    def __init__(self, q: pa.Table, blocks, bins: int, channels: int):
        self.bins, self.channels = bins, channels
        self.inverse = K.inverse_transform(bins)
        self.groups: list[_Group] = []
        #: Whether groups are parted by what bounds decide; the first batch tells.
        self.parted = False
        #: Queries from here on, and all of them against batches with such values, are scored in double precision only.
        self.plain = 0
        self._hold(q)
        count = q.num_rows
        self.positive = np.array(self.q.column("positive_id").to_pylist())
        self.target = self.q.column("positive_score_q").to_numpy().astype(np.float64)
        first = np.array([b.first_id for b in blocks])
        #: Blocks of this stripe up to the one that may hold the positive.
        self.home = np.searchsorted(first, self.positive, side="right") - 1
        self.ahead = np.zeros(count, dtype=np.int64)
        self.best = np.full(count, -np.inf)
        self.best_id = np.empty(count, dtype=object)
        self.shift = np.zeros(count, dtype=np.int64)
        #: The best entry's score in double precision is no less.
        self.least = (self.target - 0.5) / K.SCALE
        #: Pairs of this batch that are to be scored in double precision, and how many.
        self.open: list[tuple[np.ndarray, ...]] = []
        self.left_open = 0

    def _hold(self, q: pa.Table) -> None:
        """Keep the queries by rising number of bins that they see, in groups whose products have the same length."""
        bins, channels, count = self.bins, self.channels, q.num_rows
        whole, divisors = np.empty((count, bins, channels)), np.empty(count)
        length, seen = np.empty(count), np.empty(count, dtype=np.int64)
        for part in _row_steps(count, bins, channels):
            rows = q.slice(part.start, part.stop - part.start)
            direction = K.list_matrix(rows.column("direction"), bins * channels).reshape(-1, bins, channels)
            valid = K.list_matrix(rows.column("valid"), bins)
            whole[part], divisors[part] = K.masked_queries(direction, valid)
            masked = whole[part] / divisors[part, None, None]
            length[part] = np.sqrt(np.einsum("nad,nad->n", masked, masked))
            last = bins - (valid[:, ::-1] != 0).argmax(axis=1)
            last[~valid.any(axis=1)] = 1
            folds = np.array([K.folds(bins, n) for n in range(bins + 1)])
            seen[part] = np.where(folds[last] > 0, bins + folds[last], last)
        seen[~(length < SAFE_LENGTH)] = bins + 3
        order = np.argsort(seen, kind="stable")
        self.q = q.drop_columns(["direction", "valid"]).take(pa.array(order))
        self.masked, self.divisor, self.length = whole[order], divisors[order], length[order]
        seen = seen[order]
        self.plain = int(np.searchsorted(seen, bins + 3))
        for width in np.unique(seen[: self.plain]).tolist():
            start, stop = np.searchsorted(seen, [width, width + 1]).tolist()
            fold = max(0, width - bins)
            single = np.empty((stop - start, min(width, bins) * channels), dtype=np.float32)
            for part in _row_steps(stop - start, bins, channels):
                rows = slice(start + part.start, start + part.stop)
                masked = self.masked[rows, : min(width, bins)] / self.divisor[rows, None, None]
                masked = K.folded_queries(masked, fold) if fold else masked
                single[part] = masked.reshape(len(masked), -1)
            self.groups.append(_Group(np.arange(start, stop), fold, single, None))

    def _part(self, tiles: np.ndarray, margins: np.ndarray) -> None:
        """Part the twice folded groups by whether bounds rule nearly all of these tiles out."""
        self.parted, groups = True, []
        for group in self.groups:
            if group.fold < 2:
                groups.append(group)
                continue
            turned = K.turned_tiles(tiles, 2)
            odd = K.odd_lengths(group.query, self.bins, self.channels, 1) * BOUND_ROUNDING
            tight = np.zeros(len(group.at), dtype=bool)
            lengths = K.odd_lengths(turned, self.bins, self.channels, 0)
            for top in range(0, len(group.at), ROWS):
                rows = slice(top, top + ROWS)
                bound = K.shift_bounds(group.query[rows], turned, self.bins, self.channels, (odd[rows], lengths))
                below = self._below(group.at[rows], margins[group.at[rows]])
                tight[rows] = K.row_counts(bound >= below[:, None]) <= 1 + len(tiles) // (2 * COLUMNS)
            for some, lengths in ((tight, odd), (~tight, None)):
                if some.any():
                    groups.append(_Group(group.at[some], 2, group.query[some], None if lengths is None else lengths[some]))
        self.groups = groups

    def meet(self, number: int, batch: pa.RecordBatch) -> None:
        """Compare all held queries with a batch of block ``number`` (sorted by id)."""
        ids = np.array(batch.column("id").to_pylist())
        tiles = K.list_matrix(batch.column("direction"), self.bins * self.channels).reshape(-1, self.bins, self.channels)
        longest = float(np.sqrt(np.einsum("nad,nad->n", tiles, tiles).max(initial=0.0)))
        # Rows of the batch with an id smaller than the query's positive: all, none, or up to its place.
        smaller = np.where(self.home > number, len(ids), 0)
        at_home = np.flatnonzero(self.home == number)
        smaller[at_home] = np.searchsorted(ids, self.positive[at_home])
        own = at_home[ids[np.minimum(smaller[at_home], len(ids) - 1)] == self.positive[at_home]]
        own_at = np.full(len(self.ahead), -1)
        own_at[own] = smaller[own]
        plain = self.plain if longest < SAFE_LENGTH else 0
        if plain < len(self.ahead):
            self._meet_plainly(plain, ids, batch.column("direction"), smaller, own)
        if not plain:
            return
        margins = np.zeros(len(self.ahead))
        with np.errstate(over="ignore"):
            for group in self.groups:
                terms = self.bins * self.channels if group.fold else group.query.shape[1]
                margins[group.at] = K.single_margin(terms, self.length[group.at], longest)
        if not self.parted:
            self._part(tiles[: 4 * COLUMNS], margins)
        for left in range(0, len(ids), COLUMNS):
            part = tiles[left : left + COLUMNS]
            turned = {fold: K.turned_tiles(part, fold) for fold in {group.fold for group in self.groups}}
            lengths = K.odd_lengths(turned[2], self.bins, self.channels, 0) if 2 in turned else None
            for group in self.groups:
                for top in range(0, len(group.at), ROWS):
                    at, query = group.at[top : top + ROWS], group.query[top : top + ROWS]
                    if group.odd is None:
                        peak = K.shift_peaks(query, turned[group.fold], self.bins, self.channels, group.fold)
                        self._count(at, peak, margins[at], left, own_at)
                    else:
                        both = (group.odd[top : top + ROWS], lengths)
                        bound = K.shift_bounds(query, turned[2], self.bins, self.channels, both)
                        self._rule_out(at, query, bound, turned[2], margins[at], left, own_at)
                    if self.left_open > MOST_OPEN:
                        self._settle(tiles, ids, smaller, margins)
        self._settle(tiles, ids, smaller, margins)

    def _below(self, at: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Single-precision scores below these are behind the positive."""
        edge = (self.target[at] - 0.5) / K.SCALE - margin
        return np.nextafter(edge.astype(np.float32), np.float32(-np.inf))

    def _leave_own(self, at: np.ndarray, scores: np.ndarray, left: int, own_at: np.ndarray) -> None:
        """Take the scores of the queries' own entries out; they wait with those beside them, so that ids stay in order."""
        own = own_at[at]
        mine = np.flatnonzero((own >= left) & (own < left + scores.shape[1]))
        scores[mine, own[mine] - left] = -np.inf
        self._leave_open(at[mine], own[mine], np.full(len(mine), np.inf, dtype=np.float32), LEADS + OWN)

    def _rule_out(self, at, query, bound, turned, margin, left, own_at) -> None:
        """Take in bounds of the scores of some queries against the tiles from place ``left`` of the batch on."""
        self._leave_own(at, bound, left, own_at)
        maybe = bound >= self._below(at, margin)[:, None]
        counts = K.row_counts(maybe)
        crowded = counts > FEW
        if crowded.any():
            peak = K.shift_peaks(query[crowded], turned, self.bins, self.channels, 2)
            self._count(at[crowded], peak, margin[crowded], left, own_at)
            maybe[crowded] = False
        if counts.any():
            row, column = K.marked(maybe)
            self._leave_open(at[row], left + column, np.full(len(row), np.inf, dtype=np.float32), COUNTS + LEADS)

    def _count(self, at, peak, margin, left, own_at) -> None:
        """Take in the single-precision scores of some queries against the tiles from place ``left`` of the batch on."""
        self._leave_own(at, peak, left, own_at)
        maybe = peak >= self._below(at, margin)[:, None]
        met = np.flatnonzero(K.row_counts(maybe))
        if not len(met):
            return
        if 4 * len(met) < 3 * len(at):
            at, peak, maybe, margin = at[met], peak[met], maybe[met], margin[met]
        above = ((self.target[at] + 0.5) / K.SCALE + margin).astype(np.float32)
        sure = peak >= np.nextafter(above, np.float32(np.inf))[:, None]
        self.ahead[at] += K.row_counts(sure)
        row, column = K.marked(np.not_equal(maybe, sure, out=maybe))
        self._leave_open(at[row], left + column, peak[row, column], COUNTS)
        # Entries that may be the best so far.
        top = peak.max(axis=1).astype(np.float64)
        risen = np.flatnonzero((top >= self._leading(at, margin)) & (top > -np.inf))
        if len(risen):
            at, peak, margin = at[risen], peak[risen], margin[risen]
            self.least[at] = np.maximum(self.least[at], top[risen] - margin)
            floor = np.nextafter(self._leading(at, margin).astype(np.float32), np.float32(-np.inf))
            row, column = np.nonzero(peak >= floor[:, None])
            self._leave_open(at[row], left + column, peak[row, column], LEADS)

    def _leading(self, at: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Single-precision scores below these cannot be the best: an earlier entry's is higher, or ties with it."""
        return np.maximum(self.least[at] - 1 / K.SCALE, (self.best[at] + 0.5) / K.SCALE) - margin

    def _leave_open(self, at: np.ndarray, column: np.ndarray, peak: np.ndarray, what: int) -> None:
        """Keep pairs of queries and places in the batch for :meth:`_settle`."""
        if len(at):
            self.open.append((at, column, peak, np.full(len(at), what, dtype=np.int8)))
            self.left_open += len(at)

    def _settle(self, tiles: np.ndarray, ids: np.ndarray, smaller: np.ndarray, margins: np.ndarray) -> None:
        """Score the pairs of a batch that were left open: count those ahead and take the best."""
        if not self.open:
            return
        at, column, peak, what = (np.concatenate(x) for x in zip(*self.open))
        self.open, self.left_open = [], 0
        leads = (what & LEADS > 0) & (peak >= self._leading(at, margins[at]))
        needed = leads | (what & COUNTS > 0)
        at, column, what, leads = at[needed], column[needed], what[needed], leads[needed]
        score, shift = self._exact(at, tiles, column)
        own = what & OWN > 0
        target = self.target[at]
        score[own] = target[own]  # a positive counts with its recorded score
        before = (what & COUNTS > 0) & ((score > target) | ((score == target) & (column < smaller[at])))
        np.add.at(self.ahead, at[before], 1)
        leads = np.flatnonzero(leads & (score >= target))
        order = leads[np.lexsort((column[leads], -score[leads], at[leads]))]
        # Equal scores: the earlier, smaller id stays.
        won = order[(np.diff(at[order], prepend=-1) != 0) & (score[order] > self.best[at[order]])]
        self.best[at[won]], self.shift[at[won]], self.best_id[at[won]] = score[won], shift[won], ids[column[won]]

    def _exact(self, at: np.ndarray, tiles: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and shifts in double precision of the pairs of queries ``at`` and ``tiles[column]``."""
        score, shift = np.empty(len(at)), np.empty(len(at), dtype=np.int64)
        if len(at) > 1_024:
            (queries, own), (places, place) = (np.unique(x, return_inverse=True) for x in (at, column))
            if len(queries) * len(places) < 8 * len(at):  # many equal entries: whole rectangles
                spectrum = K.real_spectrum(tiles[places])
                turned = K.quarter_turn(spectrum)
                query = K.real_spectrum(self.masked[queries])
                step = max(1, SUB_PAIRS // len(places))
                for first in range(0, len(queries), step):
                    divisor = self.divisor[queries[first : first + step]]
                    logits = K.grid_logits(query[:, first : first + step], spectrum, turned, divisor, self.inverse)
                    here = np.flatnonzero((own >= first) & (own < first + step))
                    score[here], shift[here] = K.best_shift(logits[:, own[here] - first, place[here]])
                return score, shift
        for part in _row_steps(len(at), self.bins, self.channels):
            query, spectrum = K.real_spectrum(self.masked[at[part]]), K.real_spectrum(tiles[column[part]])
            logits = K.pair_logits(query, spectrum, K.quarter_turn(spectrum), self.divisor[at[part]], self.inverse)
            score[part], shift[part] = K.best_shift(logits)
        return score, shift

    def _meet_plainly(self, start: int, ids: np.ndarray, directions: pa.Array, smaller: np.ndarray, own: np.ndarray) -> None:
        """Compare the queries from ``start`` on with a batch, in double precision only."""
        gallery_re, gallery_im = _read_gallery(directions, self.bins, self.channels)
        width = min(len(ids), 512)
        height = max(1, SUB_PAIRS // width)
        for top in range(start, len(self.ahead), height):
            rows = slice(top, min(top + height, len(self.ahead)))
            query, divisor = K.real_spectrum(self.masked[rows]), self.divisor[rows]
            here = own[(own >= top) & (own < rows.stop)]
            wanted = self.target[rows, None]
            best_at = np.full(rows.stop - top, -1)
            for left in range(0, len(ids), width):
                cols = slice(left, min(left + width, len(ids)))
                logits = K.grid_logits(query, gallery_re[:, cols], gallery_im[:, cols], divisor, self.inverse)
                score = K.quantise(logits.max(axis=0))
                inside = here[(smaller[here] >= cols.start) & (smaller[here] < cols.stop)]
                score[inside - top, smaller[inside] - cols.start] = self.target[inside]
                self.ahead[rows] += (score > wanted).sum(axis=1)
                tied = score == wanted
                if tied.any():
                    position = np.arange(cols.start, cols.stop)
                    self.ahead[rows] += (tied & (position[None, :] < smaller[rows, None])).sum(axis=1)
                peak = score.argmax(axis=1)
                value = score[np.arange(len(peak)), peak]
                better = value > self.best[rows]  # equal scores: the earlier, smaller id stays
                self.best[rows] = np.where(better, value, self.best[rows])
                best_at = np.where(better, peak + cols.start, best_at)
            new = np.flatnonzero(best_at >= 0)
            for part in _row_steps(len(new), self.bins, self.channels):
                r, c = new[part], best_at[new[part]]
                logits = K.pair_logits(query[:, r], gallery_re[:, c], gallery_im[:, c], divisor[r], self.inverse)
                self.shift[top + r] = K.best_shift(logits)[1]
                self.best_id[top + r] = ids[c]


def rank_partials(
    scored: DataFrame,
    gallery: DataFrame,
    angular_bins: int,
    channels: int,
    sizes=None,
    store: BlockStore | None = None,
    plan: StreamPlan | None = None,
) -> DataFrame:
    """One row per (query, stripe of gallery blocks): entries ahead of the positive and the stripe's best entry.

    The best entry may be null where all of a stripe's entries are behind the positive, which is in another stripe.

    ``scored`` comes from :func:`with_positive_scores`. The positive takes part with its
    recorded score, so that it can never be ahead of itself. A task holds its queries and streams the
    gallery; it never holds more of that than one batch.
    """
    query_rows, gallery_rows = sizes or (None, None)
    store = store or gallery_store(gallery, angular_bins, channels, gallery_rows)
    plan = plan or _plan(scored, gallery, store, angular_bins, channels, query_rows)
    row_bytes = angular_bins * channels * _values(gallery, "direction")
    keep = [*QUERY_KEY, "positive_id", "positive_score_q", "positive_shift"]

    def kernel(q: pa.Table, blocks) -> Iterator[pa.RecordBatch]:
        if not blocks:
            return
        state = _Running(q, blocks, angular_bins, channels)
        for number in range(len(blocks)):
            for _, batch in read_batches(blocks[number : number + 1], row_bytes):
                state.meet(number, batch)
        none = np.isneginf(state.best)
        yield pa.RecordBatch.from_arrays(
            [state.q.column(name).combine_chunks() for name in keep]
            + [
                pa.array(state.ahead),
                pa.array(np.where(none, 0, state.best).astype(np.int64), mask=none),
                pa.array(state.best_id, pa.string()),
                pa.array(state.shift),
            ],
            names=[*keep, "ahead", "best_score_q", "best_id", "best_shift"],
        )

    schema = f"{_types(scored, keep)}, ahead bigint, best_score_q bigint, best_id string, best_shift bigint"
    return stream(scored.select(*keep, "direction", "valid"), QUERY_KEY, store, plan, kernel, schema)


def exact_ranks(partials: DataFrame) -> DataFrame:
    """Final rank and top-1 per query; ties go to the smaller id."""
    keep = [*QUERY_KEY, "positive_id", "positive_score_q", "positive_shift"]
    best = F.struct((-F.col("best_score_q")).alias("s"), F.col("best_id").alias("i"), F.col("best_shift").alias("k"))
    top = F.min(F.when(F.col("best_score_q").isNotNull(), best))
    return (
        partials.groupBy(*keep)
        .agg((F.sum("ahead") + 1).alias("rank"), top.alias("top"))
        .select(
            *keep,
            "rank",
            F.col("top.i").alias("top1_id"),
            (-F.col("top.s")).alias("top1_score_q"),
            F.col("top.k").alias("top1_shift"),
        )
    )


def evaluate_all_pairs(
    queries: DataFrame, gallery: DataFrame, angular_bins: int, channels: int, sizes=None, store: BlockStore | None = None
) -> DataFrame:
    """Exact rank, top-1 and shifts of every query over the whole gallery.

    ``store``: the gallery as a block store, if there is one; else one is written.
    """
    scored = with_positive_scores(queries, gallery, angular_bins, channels)
    return exact_ranks(rank_partials(scored, gallery, angular_bins, channels, sizes, store))


def prediction_rows(ranks: DataFrame, dataset: str, split: str) -> DataFrame:
    """Published prediction table."""
    return ranks.select(
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        "query_id",
        "fov_deg",
        F.col("positive_id").alias("positive_satellite_id"),
        F.col("rank").alias("predicted_rank_1based"),
        F.col("top1_id").alias("top1_satellite_id"),
        (F.col("top1_score_q") / SCALE).alias("top1_score"),
        (F.col("positive_score_q") / SCALE).alias("positive_score"),
        F.col("top1_shift").alias("best_shift_id"),
        F.col("positive_shift").alias("positive_best_shift_id"),
    )

"""Coarse-to-exact hard-negative mining.

Queries carry ``query_id, fov_deg, positive_id, direction, valid``; gallery rows ``id, direction``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringmatch.functions import kernels as K
from ringmatch.functions.crops import int_div
from ringmatch.operators.blocks import BlockStore, StreamPlan, plan_for, read_batches, scratch_store, stream
from ringmatch.operators.cyclic import QUERY_KEY, score_pairs
from ringmatch.session import durable, ship_package

#: Queries and gallery rows that are compared at once; a multiple of 8.
ROWS, COLUMNS = 512, 1_024
#: Rows that a task names and sends on at once.
SENT = 1 << 18
NOTHING = np.iinfo(np.int64).min


def with_signature(df: DataFrame, angular_bins: int, channels: int, frequency_count: int, valid: str | None = None) -> DataFrame:
    """Append ``signature``: signed DC and low-frequency magnitudes, unit norm.

    Magnitudes do not change when the bins are rotated. Row-wise in Arrow batches, no shuffle.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = df.columns

    def run(batches):
        for batch in batches:
            direction = K.list_matrix(batch.column("direction"), angular_bins * channels)
            direction = direction.reshape(-1, angular_bins, channels)
            if valid:
                direction = direction * K.list_matrix(batch.column(valid), angular_bins)[:, :, None]
            signature = K.turn_signature(direction, frequency_count)
            flat = pa.array(signature.reshape(-1))
            offsets = pa.array(np.arange(len(signature) + 1, dtype=np.int32) * signature.shape[1])
            column = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [column], names=[*names, "signature"])

    ship_package(df.sparkSession)
    return df.mapInArrow(run, f"{fields}, signature array<double>")


class _Best:
    """The ``keep`` best gallery rows of every held query so far, as one number per row.

    A number holds the score, then the falling position, so that larger is better and no two are equal. Products are taken
    in single precision; those that may belong to the best, by their error bound, are taken again in double precision.
    """

    def __init__(self, query: np.ndarray, keep: int, gallery_rows: int):
        self.query, self.keep, self.rows = query, keep, gallery_rows
        with np.errstate(over="ignore"):
            self.single = query.astype(np.float32)
        self.length = np.sqrt(np.einsum("nk,nk->n", query, query))
        self.keys = np.full((len(query), keep), NOTHING, dtype=np.int64)
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.met = self.merged = 0

    def add(self, first: int, tiles: np.ndarray, own: np.ndarray) -> None:
        """All queries against rows that begin at position ``first``, save the row of ``tiles`` that ``own`` names (or -1)."""
        with np.errstate(over="ignore"):
            turned = np.ascontiguousarray(tiles.T, dtype=np.float32)
        squares = np.einsum("nk,nk->n", tiles, tiles)
        longest = float(np.sqrt(squares[np.isfinite(squares)].max(initial=0.0)))
        margin = K.single_margin(tiles.shape[1], self.length, longest)
        left = 0
        while left < len(tiles):
            right = min(len(tiles), left + min(COLUMNS, max(2 * self.keep, self.met)))
            part = np.ascontiguousarray(turned[:, left:right])
            for top in range(0, len(self.query), ROWS):
                rows = slice(top, top + ROWS)
                near = self.single[rows] @ part
                mine = np.flatnonzero((own[rows] >= left) & (own[rows] < right))
                near[mine, own[rows][mine] - left] = -np.inf
                row, column = K.marked(near >= self._floor(rows, margin)[:, None])
                for some in range(0, len(row), 1 << 16):
                    self._take(top + row[some : some + (1 << 16)], left + column[some : some + (1 << 16)], first, tiles)
                if self.waiting > 1 << 20:
                    self._merge()
            self.met += right - left
            left = right
            if 4 * (self.met - self.merged) >= self.met:
                self._merge()

    def _floor(self, rows: slice, margin: np.ndarray) -> np.ndarray:
        """What a product must reach to be among the best; a later row with the score of the last one is not."""
        last = self.keys[rows].min(axis=1)
        least = np.where(last == NOTHING, -np.inf, (last // self.rows + 0.5) / K.SCALE - margin[rows])
        lowest = np.finfo(np.float32).min  # what is left out stays below
        return np.maximum(np.nextafter(np.maximum(least, lowest / 2).astype(np.float32), np.float32(-np.inf)), lowest)

    def _take(self, row: np.ndarray, column: np.ndarray, first: int, tiles: np.ndarray) -> None:
        score = K.quantise(np.einsum("pk,pk->p", self.query[row], tiles[column])).astype(np.int64)
        self.hits.append((row, score * self.rows + (self.rows - 1 - first - column)))
        self.waiting += len(row)

    def _merge(self) -> None:
        """Merge the rows found since the last time into the lists, queries with about as many of them together."""
        self.merged = self.met
        if not self.waiting:
            return
        row, key = (np.concatenate(c) for c in zip(*self.hits))
        self.hits, self.waiting = [], 0
        order = np.argsort(row, kind="stable")
        key, counts = key[order], np.bincount(row, minlength=len(self.query))
        begin = np.cumsum(counts) - counts
        todo = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        at = 0
        while at < len(todo):
            most = int(counts[todo[at]])
            here = todo[at : at + max(1, (1 << 22) // (self.keep + most))]
            new = np.full((len(here), most), NOTHING, dtype=np.int64)
            lane = np.arange(most) < counts[here][:, None]
            new[lane] = key[(begin[here][:, None] + np.arange(most))[lane]]
            both = np.concatenate([self.keys[here], new], axis=1)
            self.keys[here] = np.partition(both, most, axis=1)[:, most:]
            at += len(here)

    def found(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, scores and positions, best first."""
        self._merge()
        keys = -np.sort(-self.keys[rows], axis=1)
        row, column = np.nonzero(keys != NOTHING)
        keys = keys[row, column]
        return rows.start + row, keys // self.rows, self.rows - 1 - keys % self.rows


def _names(positions: np.ndarray, blocks, row_bytes: int) -> pa.Array:
    """The ids at the given positions; reads the id column of the blocks that hold them."""
    order = np.argsort(positions, kind="stable")
    ordered, at, parts = positions[order], 0, []
    for first, batch in read_batches(blocks, row_bytes, ["id"]):
        stop = at + int(np.searchsorted(ordered[at:], first + batch.num_rows))
        if stop > at:
            parts.append(batch.column("id").take(pa.array(ordered[at:stop] - first)))
            at = stop
    names = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return names.take(pa.array(back))


def coarse_candidates(
    queries: DataFrame,
    gallery: DataFrame,
    width: int,
    keep: int,
    sizes=None,
    store: BlockStore | None = None,
    plan: StreamPlan | None = None,
) -> DataFrame:
    """The ``keep`` gallery rows with the largest signature cosine per query, its positive left out.

    Tasks hold queries, stream the gallery's signatures and keep a running top ``keep`` per query; the final cut
    runs over one list per query and stripe. ``width`` is the signature length. Ties go to the smaller id.
    """
    query_rows, gallery_rows = sizes or (queries.count(), gallery.count())
    row_bytes = 8 * width
    store = store or scratch_store(gallery.select("id", "signature"), gallery_rows, row_bytes)
    # A query also holds its running list.
    plan = plan or plan_for(queries, store, query_rows, row_bytes + 24 * keep, row_bytes)
    total = max(store.rows, 1)

    def kernel(q: pa.Table, blocks) -> Iterator[pa.RecordBatch]:
        best = _Best(K.list_matrix(q.column("signature"), width), keep, total)
        positive = np.array(q.column("positive_id").to_pylist())
        for first, batch in read_batches(blocks, row_bytes):
            ids = np.array(batch.column("id").to_pylist())
            place = np.searchsorted(ids, positive)
            own = np.where(ids[np.minimum(place, len(ids) - 1)] == positive, place, -1)
            best.add(first, K.list_matrix(batch.column("signature"), width), own)
        for top in range(0, q.num_rows, max(1, SENT // keep)):
            row, score, position = best.found(slice(top, min(top + max(1, SENT // keep), q.num_rows)))
            if len(row):
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        q.column("query_id").combine_chunks().take(taken),
                        q.column("fov_deg").combine_chunks().take(taken),
                        _names(position, blocks, row_bytes),
                        pa.array(score),
                    ],
                    names=["query_id", "fov_deg", "gallery_id", "coarse_q"],
                )

    fov_type = queries.schema["fov_deg"].dataType.simpleString()
    schema = f"query_id string, fov_deg {fov_type}, gallery_id string, coarse_q bigint"
    partial = stream(queries.select(*QUERY_KEY, "positive_id", "signature"), QUERY_KEY, store, plan, kernel, schema)
    order = W.partitionBy(*QUERY_KEY).orderBy(F.desc("coarse_q"), "gallery_id")
    return partial.withColumn("coarse_rank", F.row_number().over(order)).filter(F.col("coarse_rank") <= keep)


def exact_rerank(
    coarse: DataFrame, queries: DataFrame, gallery: DataFrame, angular_bins: int, channels: int, keep: int, **options
) -> DataFrame:
    """The ``keep`` best coarse candidates by exact cyclic score; ties go to the smaller id."""
    scored = score_pairs(coarse.select(*QUERY_KEY, "gallery_id"), queries, gallery, angular_bins, channels, **options)
    order = W.partitionBy(*QUERY_KEY).orderBy(F.desc("score_q"), "gallery_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(
    queries: DataFrame,
    gallery: DataFrame,
    angular_bins: int,
    channels: int,
    frequency_count: int,
    coarse_keep: int,
    final_keep: int,
    sizes: tuple[int, int],
) -> DataFrame:
    """Hard pool ``(fov_deg, anchor, rank, negative, score_q)`` of every query."""
    if not 0 < final_keep <= coarse_keep < sizes[1]:
        raise ValueError("Need 0 < final_keep <= coarse_keep < gallery size")
    width = frequency_count * channels
    signed_queries = with_signature(queries, angular_bins, channels, frequency_count, "valid")
    signed_gallery = with_signature(gallery, angular_bins, channels, frequency_count)
    # Written once, so that a lost rerank task does not run the coarse scan again.
    coarse = durable(
        coarse_candidates(signed_queries, signed_gallery, width, coarse_keep, sizes).select(*QUERY_KEY, "gallery_id")
    )
    ranked = exact_rerank(coarse, queries, gallery, angular_bins, channels, final_keep, sizes=sizes)
    return ranked.select(
        "fov_deg",
        F.col("query_id").alias("anchor"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("gallery_id").alias("negative"),
        "score_q",
    )


def pool_audit(pool: DataFrame, locations: DataFrame, keep: int) -> DataFrame:
    """Per (fov, anchor): size, distinct negatives, own id, unknown ids, unusable scores.

    ``locations`` holds the distinct ``id`` of the manifest.
    """
    known = locations.select(F.col("id").alias("negative"), F.lit(True).alias("_known"))
    flagged = pool.join(known, "negative", "left")
    return flagged.groupBy("fov_deg", "anchor").agg(
        F.count(F.lit(1)).alias("negatives"),
        F.count_distinct("negative").alias("distinct_negatives"),
        F.count_if(F.col("negative") == F.col("anchor")).alias("own_location"),
        F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.count_if(F.col("score_q").isNull()).alias("missing_scores"),
        ((F.min("rank") == 1) & (F.max("rank") == keep) & (F.count(F.lit(1)) == keep)).alias("dense"),
    )


def missing_anchors(pool: DataFrame, locations: DataFrame, fovs: Sequence[int]) -> DataFrame:
    """``fov_deg, anchor`` of locations that a pool has no rows for."""
    listed = F.array(*[F.lit(int(f)).cast("bigint") for f in fovs])
    expected = locations.select(F.explode(listed).alias("fov_deg"), F.col("id").alias("anchor"))
    held = pool.select(F.col("fov_deg").cast("bigint").alias("fov_deg"), "anchor").distinct()
    return expected.join(held, ["fov_deg", "anchor"], "left_anti")


def pool_mismatch(pool: DataFrame, source_epoch: int, fovs: Sequence[int]) -> DataFrame:
    """``fov_deg, rows, foreign`` of FoVs without rows, or with rows of another source epoch."""
    listed = F.array(*[F.lit(int(f)).cast("bigint") for f in fovs])
    expected = pool.sparkSession.range(1).select(F.explode(listed).alias("fov_deg"))
    foreign = ~F.col("source_epoch").eqNullSafe(F.lit(int(source_epoch)))
    held = pool.groupBy(F.col("fov_deg").cast("bigint").alias("fov_deg")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(foreign).alias("foreign")
    )
    joined = expected.join(held, "fov_deg", "left").fillna(0, ["rows", "foreign"])
    return joined.filter("rows = 0 OR foreign > 0")


def pool_violations(audit: DataFrame) -> DataFrame:
    bad = (
        ~F.col("dense")
        | (F.col("distinct_negatives") != F.col("negatives"))
        | (F.col("own_location") > 0)
        | (F.col("unknown") > 0)
        | (F.col("missing_scores") > 0)
    )
    return audit.filter(bad)


def frequencies(signature, channels: int):
    """Explode a signature column into (frequency, channel, value) structs."""
    return F.transform(
        signature,
        lambda v, i: F.struct(int_div(i, channels).alias("frequency"), (i % channels).alias("channel"), v.alias("value")),
    )

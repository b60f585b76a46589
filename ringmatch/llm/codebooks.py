"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

The nearest entry is found by slices. Per dimension the entries' coordinates are sorted, and every place
in that order has the mask of the entries before it. A radius around a part's coordinate selects a range,
whose mask is the difference of two prefix masks; the masks of all dimensions, ANDed, leave the entries
in a box around the part. Their exact distances decide: an entry no farther than the radius
beats all outside the box. Otherwise the radius grows to the distance found, or doubles, and the
part is asked again. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import durable, ship_package
from ringmatch.llm.vectors import matrix

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4_096
#: Whole components stay within so much, so that no squared distance leaves 64 bits: 32,768 in the
#: vector's own units. Larger components count as this.
LARGEST = 1 << 27
#: Labels with more than this share of all rows are looked up in a broadcast table.
HEAVY_SHARE = 1 / 1_024


class Slices:
    """The entries of one part (at most 64), sorted per dimension, with their prefix masks."""

    def __init__(self, entries: np.ndarray):
        count, width = entries.shape
        if count > 64:
            raise ValueError("A mask holds 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.masks = np.zeros((width, count + 1), dtype=np.uint64)
        self.masks[:, 1:] = np.bitwise_or.accumulate(bits, axis=0).T
        # First radius: half the mean distance of an entry to the next one, at least one.
        if count > 1:
            gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
            np.fill_diagonal(gaps, np.inf)
            self.radius = max(1, int(np.sqrt(gaps.min(axis=1)).mean() / 2))
        else:
            self.radius = 1

    def inside(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within ``radius`` of each part in every dimension."""
        found = np.full(len(parts), ~np.uint64(0))
        for d, (ordered, masks) in enumerate(zip(self.sorted, self.masks)):
            low = np.searchsorted(ordered, parts[:, d] - radius, side="left")
            high = np.searchsorted(ordered, parts[:, d] + radius, side="right")
            found &= masks[high] & ~masks[low]
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry; ties go to the lower index."""
        index = np.zeros(len(parts), dtype=np.int64)
        squares = np.full(len(parts), np.iinfo(np.int64).max)
        asked = np.arange(len(parts))
        radius = np.full(len(parts), self.radius, dtype=np.int64)
        while len(asked):
            here = parts[asked]
            mask = self.inside(here, radius)
            best = np.full(len(asked), np.iinfo(np.int64).max)
            which = np.zeros(len(asked), dtype=np.int64)
            for entry in range(len(self.entries)):
                rows = np.flatnonzero((mask >> np.uint64(entry)) & np.uint64(1))
                if len(rows):
                    gap = here[rows] - self.entries[entry]
                    square = np.einsum("ij,ij->i", gap, gap)
                    closer = square < best[rows]
                    best[rows[closer]], which[rows[closer]] = square[closer], entry
            sure = best <= radius * radius
            index[asked[sure]], squares[asked[sure]] = which[sure], best[sure]
            # Something in the box, but beyond the radius: that distance is a radius that must do.
            held = best < np.iinfo(np.int64).max
            root = np.ceil(np.sqrt(np.where(held, best, 0).astype(np.float64))).astype(np.int64) + 1
            radius = np.where(held, root, 2 * radius)[~sure]
            asked = asked[~sure]
        return index, squares


def whole_vectors(df: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """Durable ``vec_id, label, whole`` (integers ``floor(4096 x)``) of the vectors that take part, and their length.

    Left out are null vectors and those with null or non-finite components. The dimension is that of most
    rows (ties: the smaller), rows of another one are left out; zeros fill it up to a multiple of ``parts``.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select("vec_id", "label", "embedding").where(F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    dimension = sizes[0]["d"] if sizes else 0
    width = -(-dimension // parts) * parts

    def step(x):
        bounded = F.greatest(F.lit(-LARGEST * 1.0), F.least(F.lit(LARGEST * 1.0), x.cast("double") * SCALE))
        return F.floor(bounded).cast("int")

    whole = F.concat(F.transform("embedding", step), F.array_repeat(F.lit(0), width - dimension))
    kept = rows.where(F.size("embedding") == dimension).select("vec_id", "label", whole.alias("whole"))
    return durable(kept), width


def starting_codebook(kept: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """``[parts, entries, width / parts]`` of the smallest ``vec_id`` (null last; ties by content), ascending.

    A top-k of ``entries`` rows reaches the driver.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    rows = np.array([r["whole"] for r in first], dtype=np.int64).reshape(len(first), width)
    return np.ascontiguousarray(rows.reshape(len(first), parts, width // parts).transpose(1, 0, 2))


def _assigned(batch: pa.RecordBatch, slices: list[Slices], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part: the whole components, indexes and squared distances of a batch."""
    whole = matrix(batch.column("whole"), width).astype(np.int64)
    step = width // len(slices)
    for part, held in enumerate(slices):
        values = whole[:, part * step : (part + 1) * step]
        yield values, *held.nearest(values)


def train_round(kept: DataFrame, codebook: np.ndarray) -> np.ndarray:
    """The codebook after one round: each entry the floored mean of its parts, unused entries as they are.

    Tasks add up sums and counts, so ``parts x entries`` rows per task are shuffled and as many
    reach the driver, whatever the number of vectors.
    """
    parts, entries, step = codebook.shape
    sent = kept.sparkSession.sparkContext.broadcast(codebook)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(c) for c in sent.value]
        sums = np.zeros((parts, entries, step), dtype=object)  # whole numbers of any size
        counts = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for part, (values, index, _) in enumerate(_assigned(batch, slices, parts * step)):
                counts[part] += np.bincount(index, minlength=entries)
                here = np.zeros((entries, step), dtype=np.int64)
                np.add.at(here, index, values)
                sums[part] += here
        used = np.argwhere(counts > 0)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used[:, 0].astype(np.int32)),
                    pa.array(used[:, 1].astype(np.int32)),
                    pa.array(counts[used[:, 0], used[:, 1]]),
                    pa.array([[str(x) for x in sums[p, e]] for p, e in used.tolist()], pa.list_(pa.string())),
                ],
                ["part", "entry", "n", "sums"],
            )

    added = kept.mapInArrow(add, "part int, entry int, n long, sums array<string>")
    wide = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(step)]
    out = codebook.copy()
    for row in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
        out[row["part"], row["entry"]] = [int(row[f"s{d}"]) // row["n"] for d in range(step)]
    return out


def encode(kept: DataFrame, codebook: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits per part, and the squared distances summed."""
    parts, _, step = codebook.shape
    sent = kept.sparkSession.sparkContext.broadcast(codebook)
    label = kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(c) for c in sent.value]
        for batch in batches:
            codes = np.zeros((batch.num_rows, parts), dtype=np.uint8)
            error = np.zeros(batch.num_rows, dtype=np.int64)
            for part, (_, index, squares) in enumerate(_assigned(batch, slices, parts * step)):
                codes[:, part] = index
                error += squares
            text = codes.tobytes().hex()
            code = [text[2 * parts * k : 2 * parts * (k + 1)] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return kept.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(coded: DataFrame, codebook: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id, embedding``: the vector that each code stands for, in the vector's own units."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in part]) for part in codebook])
    places = F.sequence(F.lit(0), F.lit(len(codebook) - 1))
    entry = lambda p: F.conv(F.substring(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    return coded.select("vec_id", F.flatten(F.transform(places, lambda p: F.get(F.get(table, p), entry(p)))).alias("embedding"))


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with ``label_error``, the error summed over rows of their label (nulls together).

    Labels that hold more than a 1,024th of all rows, so at most 1,024 of them, are looked up in a
    broadcast table; the rows of any other label are few, and meet their sum in a shuffle. A sum beyond 64 bits is null.
    """
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("held"))
    sums = durable(sums.select(F.col("label").alias("__label"), "label_error", "held"))
    total = sums.agg(F.sum("held")).first()[0] or 0
    heavy = (F.col("held") > total * HEAVY_SHARE) | F.col("__label").isNull()
    few = F.broadcast(sums.where(heavy).select("__label", "label_error", F.lit(True).alias("__heavy")))
    first = coded.join(few, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
    met, rest = first.where("__heavy").drop("__heavy"), first.where("__heavy is null").drop("__heavy", "label_error")
    others = rest.join(sums.where(~heavy).select("__label", "label_error"), F.col("label") == F.col("__label"))
    return met.unionByName(others.drop("__label"))


def digest(codebook: np.ndarray) -> str:
    """SHA-256 of all entries' whole components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebook.reshape(-1).tolist())).encode()).hexdigest()


def train(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebook of durable whole vectors after ``rounds`` rounds over all of them."""
    ship_package(kept.sparkSession)
    codebook = starting_codebook(kept, width, parts, entries)
    for _ in range(rounds if codebook.size else 0):
        codebook = train_round(kept, codebook)
    return codebook


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    See :func:`whole_vectors` for those that do not, and for odd dimensions. With fewer vectors than
    ``entries`` the codebook is as small as they are. Repeated rows count as often as they occur, a null
    ``vec_id`` takes part but comes last among the first entries, an empty table gives no rows, other columns are ignored.
    """
    kept, width = whole_vectors(df, parts)
    codebook = train(kept, width, parts, entries, rounds)
    if not codebook.size:
        empty = kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("*", F.lit(0).cast("long").alias("label_error"), F.lit(digest(codebook)).alias("codebooks_sha256"))
    coded = durable(encode(kept, codebook))
    named = with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(codebook)))
    return named.select("vec_id", "code", "error", "label_error", "codebooks_sha256")

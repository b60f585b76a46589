"""Symmetric contrastive diagnostics of in-batch score matrices, for batches of any size.

A batch's queries and tiles are dealt into blocks, and every two blocks meet in one kernel call. A call returns, per
query and per tile, what the cross entropy needs of its part of the row or column: the largest score, the sum of
exponentials below it, the plain sum and the score of the own pair. Spark merges the parts; no task holds more than
two blocks and no score matrix exists as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringmatch.functions import kernels as K
from ringmatch.session import durable, ship_package

#: Rows of a batch in one block.
BLOCK_ROWS = 1_024
PARTS = "batch bigint, side string, kind string, position bigint, top double, below double, total double, own double, first bigint"


def _parts(scores: np.ndarray, rows: np.ndarray, columns: np.ndarray, temperature: float) -> list[pa.Array]:
    """Per row of a score block: largest value, sum of exponentials below it, sum, own score, first best column."""
    z = scores / temperature
    top = z.max(axis=1)
    at = np.searchsorted(columns, rows)
    mine = columns[np.minimum(at, len(columns) - 1)] == rows
    own = np.where(mine, z[np.arange(len(rows)), np.minimum(at, len(columns) - 1)], np.nan)
    return [
        pa.array(rows), pa.array(top), pa.array(np.exp(z - top[:, None]).sum(axis=1)), pa.array(z.sum(axis=1)),
        pa.array(own, from_pandas=True), pa.array(columns[z.argmax(axis=1)]),
    ]


def score_parts(
    rows: DataFrame, angular_bins: int, channels: int, order_channels: int, temperature: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per (batch, side, kind, position, block of the other side); the validity masks may differ per row."""
    sizes = durable(rows.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")))
    inverse = K.inverse_transform(angular_bins)

    def side(name: str, *columns: Column) -> DataFrame:
        own = F.pmod(F.xxhash64("position"), F.col("_blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        placed = rows.join(sizes, "batch").select("batch", "position", *columns, own.alias("_own"), other.alias("_other"))
        first, second = ("_own", "_other") if name == "query" else ("_other", "_own")
        cell = F.struct(F.col(first).alias("q"), F.col(second).alias("t"))
        return placed.withColumns({"_cell": cell, "_query": F.lit(name == "query")}).drop("_own", "_other")

    nothing = F.lit(None).cast(rows.schema["valid"].dataType).alias("valid")
    both = side("query", F.col("direction"), F.col("valid")).unionByName(side("tile", F.col("tile").alias("direction"), nothing))

    def matrix(ground, valid, tiles):
        masked, divisor = K.masked_queries(ground, valid)
        spectrum = K.real_spectrum(tiles)
        turned, query = K.quarter_turn(spectrum), K.real_spectrum(masked)
        out = np.empty((len(ground), len(tiles)))
        step = max(1, (1 << 20) // (angular_bins * len(tiles)))
        for top in range(0, len(ground), step):
            part = slice(top, top + step)
            out[part] = K.grid_logits(query[:, part], spectrum, turned, divisor[part], inverse).max(axis=0)
        return out

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        is_query = table.column("_query")
        queries, tiles = table.filter(is_query), table.filter(pa.compute.invert(is_query))
        if not queries.num_rows or not tiles.num_rows:
            return pa.table({n: pa.array([], t) for n, t in KINDS.items()})
        shape = (-1, angular_bins, channels)
        ground = K.list_matrix(queries.column("direction"), angular_bins * channels).reshape(shape)
        seen = K.list_matrix(tiles.column("direction"), angular_bins * channels).reshape(shape)
        valid = K.list_matrix(queries.column("valid"), angular_bins)
        batch = table.column("batch")[0].as_py()
        q, t = queries.column("position").to_numpy(), tiles.column("position").to_numpy()
        found = []
        for kind, first in (("joint", 0), ("order", channels - order_channels)):
            scores = matrix(ground[:, :, first:], valid, seen[:, :, first:])
            for name, view, mine, others in (("row", scores, q, t), ("column", scores.T, t, q)):
                lead = [pa.array([batch] * len(mine), pa.int64()), pa.array([name] * len(mine)), pa.array([kind] * len(mine))]
                found.append(pa.Table.from_arrays([*lead, *_parts(view, mine, others, temperature)], names=list(KINDS)))
        return pa.concat_tables(found)

    ship_package(rows.sparkSession)
    return both.groupBy("batch", "_cell").applyInArrow(run, PARTS)


KINDS = {
    "batch": pa.int64(), "side": pa.string(), "kind": pa.string(), "position": pa.int64(), "top": pa.float64(),
    "below": pa.float64(), "total": pa.float64(), "own": pa.float64(), "first": pa.int64(),
}


def contrastive_diagnostics(
    rows: DataFrame,
    angular_bins: int,
    channels: int,
    order_channels: int,
    temperature: float = 0.07,
    label_smoothing: float = 0.1,
    order_weight: float = 0.15,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Losses and in-batch top-1 accuracies per batch of any size.

    ``rows``: batch, position (unique in its batch), direction, valid, tile; masks of mixed FoVs may differ from row to
    row. The last ``order_channels`` channels are the order subspace. Equal best scores go to the smaller position.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    if order_weight <= 0:
        raise ValueError("order_weight must be positive")
    picked = rows.select("batch", "position", "direction", "valid", "tile")
    parts = score_parts(picked, angular_bins, channels, order_channels, temperature, block_rows)
    # A row's parts are as many as its batch has blocks: merged by their largest value.
    merged = parts.groupBy("batch", "side", "kind", "position").agg(
        F.max("top").alias("top"),
        F.collect_list(F.struct("top", "below")).alias("sums"),
        F.sum("total").alias("total"),
        F.max("own").alias("own"),
        F.min(F.struct((-F.col("top")).alias("s"), "first"))["first"].alias("first"),
    )
    below = F.aggregate("sums", F.lit(0.0), lambda a, e: a + e["below"] * F.exp(e["top"] - F.col("top")))
    lines = merged.withColumn("lse", F.col("top") + F.log(below))
    size = F.count(F.lit(1))
    loss = -(1 - label_smoothing) * F.avg(F.col("own") - F.col("lse")) - label_smoothing * (F.sum("total") / size / size - F.avg("lse"))
    hit = F.avg((F.col("first") == F.col("position")).cast("double"))
    views = lines.groupBy("batch", "side", "kind").agg(size.alias("rows"), loss.alias("loss"), hit.alias("accuracy"))

    def of(kind: str, column: str, side: str | None = None) -> Column:
        chosen = F.col("kind") == kind
        return F.avg(F.when(chosen if side is None else chosen & (F.col("side") == side), F.col(column)))

    both = views.groupBy("batch").agg(
        F.max("rows").alias("rows"),
        of("joint", "loss").alias("joint_loss"),
        of("order", "loss").alias("order_loss"),
        of("joint", "accuracy", "row").alias("joint_accuracy"),
        of("order", "accuracy", "row").alias("order_accuracy"),
    )
    total = (F.col("joint_loss") + order_weight * F.col("order_loss")).alias("total_loss")
    return both.select("batch", "rows", "joint_loss", "order_loss", total, "joint_accuracy", "order_accuracy")

"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table cuts space into cells by a few Gaussian projections. A query visits its own cell and
perturbed cells in the order in which they are likely to hold neighbours. Every visited cell is
compared exactly in blocks, and the candidates of all tables are merged and ranked.

Largest inner product becomes smallest distance by one more coordinate that lifts all vectors to
the length of the longest. Vectors are hashed in bands of length, each lifted to its own longest,
so one long vector does not press all others together.

How many projections, tables and probes a band takes is measured in each run: a sample of the queries is compared
with all rows, and the cheapest setting is taken whose visited cells hold enough of its true neighbours. The recall
of that sample in the final result is a column of it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringmatch.llm.common import durable, each_run, ship_package
from ringmatch.llm.vectors import matrix, usable_vectors

MOST_TABLES, MOST_PROBES = 16, 1_024
#: Projections of a table at most: all its perturbations are ranked when a setting is measured.
MOST_PROJECTIONS = 8
#: Queries compared with all rows, and the share of their true neighbours that the visited cells must hold.
SAMPLE = 256
RECALL = 0.97
#: A band with fewer true neighbours than this is measured by the nearest rows in the band itself.
LEAST_PAIRS = 512
#: Sending a row to one more cell, whether a query or a copy of a point, costs as much as comparing a query with so many
#: points (some 30 microseconds of a core against 30 nanoseconds, at 64 dimensions).
VISIT_ROWS = 1_000
#: Bands of length, each half as long as the one before; the last takes all shorter vectors.
LENGTH_BANDS = 8
#: Cell width in units of a projection's deviation on unit vectors.
WIDTH = 1.5
#: Rows of a cell on average; the number of projections follows from it (a projection has some four cells).
CELL_ROWS = 50
CELLS_PER_PROJECTION = 4
#: A cell is compared in blocks of about so many points and queries, however large it is.
POINTS, QUERIES = 4_096, 1_024


def probe_order(within: np.ndarray, probes: int) -> list[tuple[tuple[int, int], ...]]:
    """Perturbations ``((projection, -1 or 1), ...)`` by rising sum of squared distances to the walls crossed.

    ``within`` holds the place in the cell, 0 to 1, per projection. The first is none at all.
    """
    moves = [(x * x, k, -1) for k, x in enumerate(within)] + [((1 - x) ** 2, k, 1) for k, x in enumerate(within)]
    moves.sort()
    out: list[tuple[tuple[int, int], ...]] = [()]
    waiting = [(moves[0][0], (0,))] if moves else []
    while waiting and len(out) < probes:
        cost, chosen = heapq.heappop(waiting)
        dims = [moves[m][1] for m in chosen]
        if len(set(dims)) == len(dims):
            out.append(tuple((moves[m][1], moves[m][2]) for m in chosen))
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(waiting, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(waiting, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return out


class Hashes:
    """The projections of all tables of a band, from a fixed seed."""

    def __init__(
        self, dimension: int, projections: int, tables: int, probes: int, width: float, longest: float, band: int = 0
    ):
        draw = np.random.default_rng(5 + band)
        self.tables, self.probes, self.projections, self.band = tables, probes, projections, band
        self.a = draw.standard_normal((tables, dimension + 1, projections)) / width
        self.b = draw.random((tables, projections))
        self.mix = draw.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1
        self.longest = longest

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if query:
            return np.hstack([x / length, np.zeros_like(length)])
        rest = np.sqrt(np.maximum(0.0, 1.0 - (length / self.longest) ** 2))
        return np.hstack([x / self.longest, rest])

    def places(self, x: np.ndarray, table: int, query: bool) -> tuple[np.ndarray, np.ndarray]:
        at = self.lifted(x, query) @ self.a[table] + self.b[table]
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def key(self, cell: np.ndarray, table: int) -> np.ndarray:
        """One number per cell; two cells that share it only share candidates."""
        with np.errstate(over="ignore"):
            mixed = (cell * self.mix[table]).sum(axis=-1) * np.int64(MOST_TABLES) + table
            return mixed * np.int64(LENGTH_BANDS) + self.band

    def visited(self, cell: np.ndarray, within: np.ndarray, table: int) -> np.ndarray:
        """The keys of the cells that a query at this place visits."""
        visits = probe_order(within, self.probes)
        cells = np.repeat(cell[None, :], len(visits), axis=0)
        for k, moves in enumerate(visits):
            for projection, step in moves:
                cells[k, projection] += step
        return np.unique(self.key(cells, table))


def bands_of(length: np.ndarray, longest: float) -> np.ndarray:
    """The band of each length, 0 for the longest."""
    return np.clip(np.floor(np.log2(longest / length)), 0, LENGTH_BANDS - 1).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def ranks_of(hashes: Hashes, q: np.ndarray, x: np.ndarray, table: int) -> np.ndarray:
    """The turn at which query ``q[k]`` visits the cell of the point ``x[k]``, if it visits all cells around its own.

    Points in cells farther off have the number of all perturbations.
    """
    steps = np.array(np.meshgrid(*[[0, -1, 1]] * hashes.projections, indexing="ij")).reshape(hashes.projections, -1).T
    scale = 3 ** np.arange(hashes.projections - 1, -1, -1)
    points = hashes.places(x, table, False)[0]
    cells, within = hashes.places(q, table, True)
    off = points - cells
    out = np.full(len(x), len(steps))
    around = np.flatnonzero((np.abs(off) <= 1).all(axis=1))
    own = np.where(off[around] < 0, 1, 2 * off[around]) @ scale  # place among the steps 0, -1, 1
    chunk = max(1, 2_000_000 // len(steps))
    for s in range(0, len(around), chunk):
        mine = around[s : s + chunk]
        costs = np.where(steps[None] < 0, within[mine, None, :] ** 2, np.where(steps[None] > 0, (1 - within[mine, None, :]) ** 2, 0.0))
        costs = costs.sum(axis=2)
        out[mine] = (costs < costs[np.arange(len(mine)), own[s : s + chunk]][:, None]).sum(axis=1)
    return out


def calibrated(
    dimension: int,
    rows: int,
    longest: float,
    band: int,
    q: np.ndarray,
    x: np.ndarray,
    width: float = WIDTH,
    cell_rows: int = CELL_ROWS,
    recall: float = RECALL,
    queries: int | None = None,
) -> Hashes:
    """Hashes of a band of so many rows whose visited cells hold ``recall`` of the pairs ``q[k], x[k]``.

    Of all numbers of projections, tables and probes that hold enough the cheapest are taken; if none do, one
    projection with all its perturbations in as many tables as there may be. ``queries`` is how many ask this band
    (all rows, if not given): each table sends all rows to their cells and all queries to the cells they visit.
    """
    queries = max(1, rows if queries is None else queries)
    finest = round(math.log(max(rows / cell_rows, 2)) / math.log(CELLS_PER_PROJECTION))
    best, least = Hashes(dimension, 1, MOST_TABLES, 3, width, longest, band), math.inf
    for projections in range(1, min(max(1, finest), MOST_PROJECTIONS) + 1):
        hashes = Hashes(dimension, projections, MOST_TABLES, 1, width, longest, band)
        turns = np.full(len(x), 3**projections)
        cell = rows / CELLS_PER_PROJECTION**projections
        for table in range(MOST_TABLES):
            turns = np.minimum(turns, ranks_of(hashes, q, x, table))
            # The fewest probes that meet enough pairs with so many tables.
            needed = int(np.sort(turns)[max(0, math.ceil(recall * len(turns)) - 1)]) + 1 if len(turns) else 1
            probes = min(needed, 3**projections)
            if needed > 3**projections or probes > MOST_PROBES:
                continue
            # Rows sent for each query: itself to every block of points of its cells, and its share of the points, which
            # go to every block of queries of their cell.
            asking = queries * probes / CELLS_PER_PROJECTION**projections
            sent = probes * max(1.0, cell / POINTS) + rows / queries * max(1.0, asking / QUERIES)
            cost = (table + 1) * (VISIT_ROWS * sent + probes * cell)
            if cost < least:
                best, least = Hashes(dimension, projections, table + 1, probes, width, longest, band), cost
    return best


def _points(bands: dict[int, Hashes], dimension: int, longest: float):
    present = np.array(sorted(bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimension)
            # At an edge the last bit may differ from the one that the bands were counted with.
            of = present[np.abs(bands_of(_lengths(x), longest)[:, None] - present).argmin(axis=1)]
            for band in np.unique(of).tolist():
                mine = np.flatnonzero(of == band)
                part = batch.take(pa.array(mine))
                hashes = bands[band]
                for table in range(hashes.tables):
                    keys = hashes.key(hashes.places(x[mine], table, False)[0], table)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *part.columns], ["key", "vec_id", "embedding"])

    return run


def _queries(bands: dict[int, Hashes], dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimension)
            for hashes in bands.values():
                for table in range(hashes.tables):
                    cells, within = hashes.places(x, table, True)
                    for s in range(0, len(x), 64):
                        rows, keys = [], []
                        for row in range(s, min(s + 64, len(x))):
                            keys.append(hashes.visited(cells[row], within[row], table))
                            rows.append(np.full(len(keys[-1]), row))
                        part = batch.take(pa.array(np.concatenate(rows)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(keys)), *part.columns], ["key", "vec_id", "embedding"]
                        )

    return run


def _best_in_task(q: np.ndarray, q_ids: np.ndarray, dimension: int, top: int):
    """Per task and query of the sample its best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for s in range(0, len(ids), POINTS):
                x = matrix(batch.column(1).slice(s, POINTS), dimension)
                new = best_of(q, q_ids, x, ids[s : s + POINTS], top)
                rows, found, scores = (np.concatenate([a, b]) for a, b in zip(best, new))
                order = np.lexsort((found, -scores, rows))
                rows, found, scores = rows[order], found[order], scores[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < top
                best = (rows[keep], found[keep], scores[keep])
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query", "found", "score"])

    return run


def sampled_queries(rows: DataFrame, is_query: Column, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and ids of a bounded sample of the queries, by a hash of the id."""
    asked = rows.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    q = np.array([r["embedding"] for r in asked], dtype=np.float64).reshape(-1, dimension)
    return q, np.array([r["vec_id"] for r in asked], dtype=np.int64)


def true_pairs(
    rows: DataFrame, q: np.ndarray, q_ids: np.ndarray, dimension: int, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries (row numbers of ``q``), ids and vectors of their true neighbours, by comparison with all rows."""
    found = rows.mapInArrow(_best_in_task(q, q_ids, dimension, top), "query long, found long, score double")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    best = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).select("query", "found")
    pairs = best.join(rows, F.col("found") == F.col("vec_id")).select("query", "vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in pairs], dtype=np.float64).reshape(-1, dimension)
    return np.array([r["query"] for r in pairs], dtype=np.int64), np.array([r["vec_id"] for r in pairs], dtype=np.int64), x


def best_of(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of ``q``, ids and scores of each query's ``top`` in ``x``; ties go to the smaller id.

    A matrix product preselects with a margin; the scores that decide are summed row by row, so
    equal vectors have equal scores wherever they stand.
    """
    product = q @ x.T
    product[q_ids[:, None] == x_ids[None, :]] = -np.inf
    if x.shape[0] > top:
        least = np.partition(product, -top, axis=1)[:, -top]
    else:
        least = product.min(axis=1)
    margin = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(least), least, 0.0)))
    rows, columns = np.nonzero((product >= (least - margin)[:, None]) & np.isfinite(product))
    scores = np.concatenate(
        [(q[rows[s : s + 65_536]] * x[columns[s : s + 65_536]]).sum(axis=1) for s in range(0, len(rows), 65_536)]
        or [np.empty(0)]
    )
    ids = x_ids[columns]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < top
    return rows[keep], ids[keep], scores[keep]


FOUND = "query_id long, ids binary, scores binary"


def _compare(dimension: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in each_run(batches, "cell"):
            held = pa.Table.from_batches(list(parts)).combine_chunks()
            point = held.column("point").to_numpy()
            ids = held.column("vec_id").to_numpy()
            x = matrix(held.column("embedding").combine_chunks(), dimension)
            q_ids, x_ids = ids[~point], ids[point]
            if not len(q_ids) or not len(x_ids):
                continue
            rows, found, scores = best_of(x[~point], q_ids, x[point], x_ids, top)
            present, first = np.unique(rows, return_index=True)
            bounds = [*first.tolist(), len(rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(q_ids[present]),
                    pa.array([found[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array([scores[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary()),
                ],
                ["query_id", "ids", "scores"],
            )

    return run


def _merge(top: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, lists in zip(batch["query_id"], batch["lists"]):
                ids = np.concatenate([np.frombuffer(x["ids"], np.int64) for x in lists])
                scores = np.concatenate([np.frombuffer(x["scores"], np.float64) for x in lists])
                order = np.lexsort((ids, -scores))
                ids, scores = ids[order], scores[order]
                once = np.sort(np.unique(ids, return_index=True)[1])[:top]
                out += [(query, k + 1, int(ids[i]), float(scores[i])) for k, i in enumerate(once)]
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    return run


def _ranked(cells: DataFrame, dimension: int, top: int) -> DataFrame:
    """Rows ``cell, point, vec_id, embedding`` compared per cell and merged per query."""
    dealt = cells.repartition(F.col("cell")).sortWithinPartitions("cell", "point")
    found = dealt.mapInArrow(_compare(dimension, top), FOUND)
    lists = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("lists"))
    return lists.mapInPandas(_merge(top), "query_id long, rank int, vec_id long, score double")


def _block(count: str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / size).cast("int"))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    top: int = 20,
    width: float = WIDTH,
    cell_rows: int = CELL_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score, sample_recall``: the nearest ``top`` found for each row that ``is_query`` marks.

    ``vectors`` has ``vec_id, embedding``. Nearness is the largest inner product in double
    precision; a query's own id is no candidate; ties go to the smaller id, and an id that occurs
    twice is ranked once, at its best. Vectors that are null, zero, of another dimension than most,
    or hold null or non-finite components take no part, nor do rows with a null id. Queries for
    which the probes find fewer than ``top`` are compared with all rows, in blocks. An empty table
    gives no rows; other columns are ignored. ``sample_recall`` is the same in every row: the share of the
    true neighbours of a sample of the queries that the result holds.
    """
    ship_package(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double, sample_recall double"
    rows, dimension = usable_vectors(vectors)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total, longest = rows.agg(F.count("*"), F.max(length)).first()
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)
    place = F.least(F.lit(LENGTH_BANDS - 1), F.floor(F.log2(F.lit(longest) / length)).cast("int"))
    band = F.greatest(F.lit(0), place)
    held = rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max(length).alias("longest"))
    queries = rows.where(is_query).count()
    sample, sample_ids = sampled_queries(rows, is_query, dimension)
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], schema)
    query, true_ids, true = true_pairs(rows, sample, sample_ids, dimension, top)
    of = bands_of(_lengths(true), longest)
    bands = {}
    for r in held.collect():
        mine = of == r["band"]
        q, x = sample[query[mine]], true[mine]
        if len(x) < min(LEAST_PAIRS, r["n"]):
            asked, _, x = true_pairs(rows.where(band == r["band"]), sample, sample_ids, dimension, top)
            q = sample[asked]
        bands[r["band"]] = calibrated(dimension, r["n"], r["longest"], r["band"], q, x, width, cell_rows, recall, queries)
    kind = f"key long, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}"
    asked = rows.where(is_query).mapInArrow(_queries(bands, dimension), kind)
    points = rows.mapInArrow(_points(bands, dimension, longest), kind)

    # Sizes of the cells that hold points and are visited: large ones are dealt out in blocks.
    point_sizes = points.groupBy("key").agg(F.count("*").alias("points"))
    query_sizes = asked.groupBy("key").agg(F.count("*").alias("queries"))
    sizes = durable(
        point_sizes.join(query_sizes, "key").select(
            F.col("key").alias("__key"), _block("points", POINTS).alias("p"), _block("queries", QUERIES).alias("q")
        )
    )

    def own(by: str) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.col(by)).cast("int")

    def each(by: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(by) - 1))

    p_side = points.join(sizes, F.col("key") == F.col("__key")).select(
        "key", own("p").alias("pb"), each("q").alias("qb"), F.lit(True).alias("point"), "vec_id", "embedding"
    )
    q_side = asked.join(sizes, F.col("key") == F.col("__key")).select(
        "key", each("p").alias("pb"), own("q").alias("qb"), F.lit(False).alias("point"), "vec_id", "embedding"
    )
    cells = p_side.unionByName(q_side).withColumn("cell", F.xxhash64("key", "pb", "qb"))
    found = durable(_ranked(cells.select("cell", "point", "vec_id", "embedding"), dimension, top))

    # The exact way for queries whose probes found too few.
    enough = min(top, rows.select("vec_id").distinct().count() - 1)
    full = found.where(F.col("rank") == enough).select(F.col("query_id").alias("__done"))
    short = rows.where(is_query).join(full, F.col("vec_id") == F.col("__done"), "left_anti") if enough else rows.limit(0)
    short = durable(short)
    if not short.count():
        return _with_recall(found, sample_ids[query], true_ids)
    blocks = max(1, math.ceil(total / POINTS))
    query_blocks = max(1, math.ceil(short.count() / QUERIES))
    p_all = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("pb"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.lit(True).alias("point"), "vec_id", "embedding",
    )
    q_all = short.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("pb"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), F.lit(False).alias("point"), "vec_id", "embedding",
    )
    exact = p_all.unionByName(q_all).withColumn("cell", F.xxhash64("pb", "qb"))
    rest = _ranked(exact.select("cell", "point", "vec_id", "embedding"), dimension, top)
    kept = found.join(short.select(F.col("vec_id").alias("__again")), F.col("query_id") == F.col("__again"), "left_anti")
    return _with_recall(durable(kept.unionByName(rest)), sample_ids[query], true_ids)


def _with_recall(found: DataFrame, query_ids: np.ndarray, true_ids: np.ndarray) -> DataFrame:
    """The durable result with the share of the given true pairs that it holds."""
    pairs = {(int(a), int(b)) for a, b in zip(query_ids, true_ids)}
    wanted = found.sparkSession.createDataFrame([*pairs], "__query long, __true long")
    met = wanted.join(found, (F.col("__query") == F.col("query_id")) & (F.col("__true") == F.col("vec_id")), "left_semi").count()
    return found.withColumn("sample_recall", F.lit(met / len(pairs) if pairs else 1.0))

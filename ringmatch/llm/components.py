"""Connected components of a graph whose edges are rows, by alternating stars.

Two steps repeat until nothing changes: every node hands its larger neighbours over to its smallest
one, then its smaller neighbours. Work per round is linear in the edges, the number of rounds is
logarithmic in practice, and only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import durable


def _tops(edges: DataFrame) -> DataFrame:
    """The smallest smaller neighbour of each node that has one."""
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("top"))


def _large_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_tops(edges), F.col("lo") == F.col("node"), "left")
    return joined.select("hi", F.coalesce("top", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    tops = _tops(edges)
    rest = edges.join(tops, F.col("hi") == F.col("node")).where(F.col("lo") > F.col("top"))
    moved = rest.select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
    return moved.unionByName(tops.select(F.col("node").alias("hi"), F.col("top").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge; ``root`` is the smallest node it reaches.

    Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows.
    """
    stars = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    )
    stars = durable(stars.distinct())
    state = _state(stars)
    while state[0]:
        stars = durable(_small_star(_large_star(stars)))
        before, state = state, _state(stars)
        if state == before:
            break
    leaves = stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(leaves.select("root", "root").distinct().toDF("node", "root"))

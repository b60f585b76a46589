"""Conflict-free neighbours for hard anchors.

Taking anchors one after the other, each picking its first free candidates, gives the one stable
assignment in which every candidate prefers the earlier anchor. That assignment is reached in
rounds over tables: an anchor that lacks neighbours reads on in its own list of preferences, from
where it stopped, and bids for as many candidates as it lacks; a candidate stays with its earliest
bidder. Anchors that hold what they need do nothing, and no anchor reads a place twice.

Behind its pool every anchor has the whole manifest as a fallback, in a shuffle of its own. A
place of that shuffle is computed from its number (a keyed permutation), so there is no list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringmatch.functions.seeds import keyed_permutation, permutation_bits, stable_seed
from ringmatch.operators.index import shuffled_index
from ringmatch.session import durable


def shuffled_preferences(
    anchors: DataFrame, pool: DataFrame, rank_range: tuple[int, int], seed_items: Sequence[object]
) -> DataFrame:
    """Each anchor's pool entries within the rank range, in keyed random order.

    ``anchors``: priority, fov_deg, location; ``pool``: fov_deg, anchor, rank, negative.
    """
    low, high = rank_range
    entries = pool.filter(F.col("rank").between(low, high)).select(
        "fov_deg", F.col("anchor").alias("location"), F.col("negative").alias("candidate")
    )
    joined = anchors.join(entries, ["fov_deg", "location"])
    key = stable_seed(*seed_items, F.col("fov_deg"), F.col("location"), "pool_order", F.col("candidate"))
    order = W.partitionBy("priority").orderBy("_key", "candidate")
    return joined.withColumn("_key", key).select("priority", F.row_number().over(order).cast("bigint").alias("place"), "candidate")


def fallback_places(short: DataFrame, order: DataFrame, rows: int, pool_size: int, seed_items: Sequence[object]) -> DataFrame:
    """``priority, place, candidate``: the places ``from`` to ``until - 1`` of some anchors' fallbacks.

    ``order``: every location with its ``shuffle_index``. A permutation of at least ``rows`` numbers
    belongs to each anchor; numbers beyond the rows have no location.
    """
    key = stable_seed(*seed_items, F.col("fov_deg"), F.col("location"), "fallback")
    wanted = short.withColumn("_key", key).withColumn("_j", F.explode(F.sequence(F.col("from"), F.col("until") - 1)))
    index = keyed_permutation(F.col("_j"), F.col("_key"), permutation_bits(rows))
    placed = wanted.select("priority", (F.col("_j") + pool_size + 1).alias("place"), index.alias("shuffle_index"))
    inside = placed.filter(F.col("shuffle_index") < rows)
    return inside.join(order, "shuffle_index").select("priority", "place", F.col("location").alias("candidate"))


def assign_neighbours(
    anchors: DataFrame,
    preferences: DataFrame,
    locations: DataFrame,
    need: int,
    pool_size: int,
    seed_items: Sequence[object],
    rows: int,
) -> DataFrame:
    """``need`` distinct neighbours per anchor: ``priority, offset (1..need), location``.

    ``anchors``: priority (unique, smaller picks first), fov_deg, location, all of them reserved;
    ``locations``: every location of the manifest, ``rows`` of them. Rounds are few while locations are left
    over; where the last anchors need the very last locations, displacements follow each other round by round.
    """
    places = 1 << 2 * permutation_bits(rows)
    reserved = durable(anchors.select(F.col("location").alias("candidate")))
    preferences = durable(preferences.join(reserved, "candidate", "left_anti").select("priority", "place", "candidate"))
    order: DataFrame | None = None
    def reading(readers: DataFrame) -> DataFrame:
        """Durable anchors with the fallback places that they read next, if they lack anything."""
        begin = F.greatest(F.col("next") - pool_size - 1, F.lit(0))
        end = F.least(begin + F.col("step"), F.lit(places))
        return durable(readers.withColumn("from", begin).withColumn("until", F.when(F.col("next") > pool_size, end)))

    # ``next`` is the first place that an anchor has not read; ``step`` how many fallback places it reads at once.
    state = ("priority", "fov_deg", "location")
    numbers = {"next": F.lit(1).cast("bigint"), "step": F.lit(4 * need).cast("bigint"), "lack": F.lit(need).cast("bigint")}
    readers = reading(anchors.select(*state, *[value.alias(name) for name, value in numbers.items()]))
    holds = preferences.limit(0)
    while True:
        short = readers.filter("lack > 0")
        left, at_end, falling = short.agg(
            F.count(F.lit(1)), F.count_if(F.col("from") >= places), F.count_if(F.col("until").isNotNull())
        ).first()
        if not left:
            break
        if at_end:
            raise RuntimeError(f"{at_end} anchors cannot be given {need} free locations")
        offered = preferences.join(short.filter("until IS NULL").select("priority", "next"), "priority")
        offered = offered.filter(F.col("place") >= F.col("next")).drop("next")
        if falling:
            if order is None:
                order = durable(shuffled_index(locations.select("location"), [*seed_items, "fallback_order"], ["location"], rows=rows))
            rest = fallback_places(short.filter("until IS NOT NULL"), order, rows, pool_size, seed_items)
            rest = rest.join(reserved, "candidate", "left_anti")
            offered = offered.unionByName(rest.select("priority", "place", "candidate"))
        # What an earlier anchor holds, or the anchor itself, is not to be had any more.
        holders = holds.select("candidate", F.col("priority").alias("_holder"))
        free = offered.join(holders, "candidate", "left").filter(F.col("_holder").isNull() | (F.col("priority") < F.col("_holder")))
        ranked = free.withColumn("_n", F.row_number().over(W.partitionBy("priority").orderBy("place")))
        bids = ranked.join(short.select("priority", "lack"), "priority").filter(F.col("_n") <= F.col("lack"))
        bids = durable(bids.select("priority", "place", "candidate"))
        best = F.min(F.struct("priority", "place")).alias("b")
        contest = holds.unionByName(bids).groupBy("candidate").agg(best)
        holds = durable(contest.select(F.col("b.priority").alias("priority"), F.col("b.place").alias("place"), "candidate"))
        made = bids.groupBy("priority").agg(F.count(F.lit(1)).alias("_made"), F.max("place").alias("_last"))
        held = holds.groupBy("priority").agg(F.count(F.lit(1)).alias("_held"))
        now = readers.join(made, "priority", "left").join(held, "priority", "left")
        read = F.col("lack") > 0
        full = F.coalesce("_made", F.lit(0)) == F.col("lack")
        beyond = F.coalesce("until", F.lit(0)) + pool_size + 1
        readers = reading(
            now.select(
                *state,
                F.when(~read, F.col("next")).when(full, F.col("_last") + 1).otherwise(beyond).alias("next"),
                F.when(read & ~full & F.col("until").isNotNull(), F.col("step") * 2).otherwise(F.col("step")).alias("step"),
                (F.lit(need) - F.coalesce("_held", F.lit(0))).alias("lack"),
            )
        )
    offset = F.row_number().over(W.partitionBy("priority").orderBy("place")).cast("bigint")
    return holds.select("priority", offset.alias("offset"), F.col("candidate").alias("location"))

"""Keyed deterministic randomness: every draw is a function of its key only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32_RANGE = 2**32


#: Stands for null, so that a null item keeps its place among the others.
NULL_ITEM = "\u0000"


def _text(item) -> Column:
    if isinstance(item, Column):
        return F.coalesce(item.cast("string"), F.lit(NULL_ITEM))
    return F.lit(str(item))


def stable_seed(*items) -> Column:
    """SHA-256 of the ``::``-joined items, first eight bytes little-endian, mod 2^32.

    Only the first four digest bytes survive the modulus.
    Python values become literals, columns are cast to string.
    """
    digest = F.sha2(F.concat_ws("::", *[_text(i) for i in items]), 256)
    # One use of the digest: filters do not share repeated subexpressions.
    swapped = F.regexp_replace(F.substring(digest, 1, 8), "(..)(..)(..)(..)", "$4$3$2$1")
    return F.conv(swapped, 16, 10).cast("bigint")


def unit_draw(*items) -> Column:
    """Uniform double in [0, 1) for a key."""
    return stable_seed(*items) / F.lit(float(UINT32_RANGE))


def bernoulli(probability: float, *items) -> Column:
    """Keyed coin: true with the given probability."""
    return unit_draw(*items) < F.lit(float(probability))


def uniform(low: float, high: float, *items) -> Column:
    """Keyed uniform double in [low, high)."""
    return F.lit(float(low)) + F.lit(float(high - low)) * unit_draw(*items)


PERMUTATION_ROUNDS = 4


def permutation_bits(count: int) -> int:
    """Bits of each half of a place, so that at least ``count`` places exist."""
    return max(1, -(-(max(count, 1) - 1).bit_length() // 2))


def keyed_permutation(place: Column, key: Column, bits: int) -> Column:
    """Where a place of ``0 .. 4^bits - 1`` goes in the shuffle that belongs to ``key``.

    A Feistel network: each round replaces one half by its sum (without carry) with a draw that depends on
    the other half, so every round, and the whole, is one to one. Each key has its own shuffle and
    any place of it is computed alone, without a list.
    """
    size = F.lit(1 << bits).cast("bigint")
    halves = F.struct(F.shiftright(place.cast("bigint"), bits).alias("a"), (place.cast("bigint") % size).alias("b"))

    def turn(state: Column, number: Column) -> Column:
        return F.struct(state["b"].alias("a"), state["a"].bitwiseXOR(stable_seed(key, number, state["b"]) % size).alias("b"))

    rounds = F.array(*[F.lit(r) for r in range(PERMUTATION_ROUNDS)])
    return F.aggregate(rounds, halves, turn, lambda s: s["a"] * size + s["b"])

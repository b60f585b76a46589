"""Native array expressions on flat ``bins x channels`` direction vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringmatch.functions.crops import int_div

SCALE = 1_000_000


def quantise(value: Column, scale: int = SCALE) -> Column:
    """Fixed-point score: the only form in which scores are compared or published."""
    return F.floor(value * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column used inside a lambda would be evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def circular_slice(array: Column, center: Column, width: Column) -> Column:
    """``width`` consecutive elements around ``center`` with wrap-around."""
    size = F.size(array)
    start = center - int_div(width, F.lit(2).cast("bigint"))
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), width - 1),
        lambda k: F.element_at(array, (F.pmod(start + k, size.cast("bigint")) + 1).cast("int")),
    )


def valid_mask(valid_bins: Column, angular_bins: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(angular_bins - 1)), lambda a: a < valid_bins)


def pad_directions(vector: Column, angular_bins: int, channels: int) -> Column:
    """Append zero bins up to ``angular_bins``; null where the vector is too long."""
    full = angular_bins * channels
    missing = F.lit(full) - F.size(vector)
    return F.when(missing >= 0, F.concat(vector, F.array_repeat(F.lit(0.0), missing)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(vector: Column, floor: float = 1e-12) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
        return let(norm, lambda n: F.transform(v, lambda x: x / n))

    return let(vector, scaled)


def joint_descriptor(content: Column, order: Column, order_weight: float) -> Column:
    """Unit content and unit order halves, joined with weights sqrt(1-w) and sqrt(w)."""
    if not 0.0 < order_weight < 1.0:
        raise ValueError("order_weight must be strictly between zero and one")
    c, o = math.sqrt(1.0 - order_weight), math.sqrt(order_weight)
    return F.concat(
        F.transform(l2_normalise(content), lambda x: x * F.lit(c)),
        F.transform(l2_normalise(order), lambda x: x * F.lit(o)),
    )


def rotate_bins(vector: Column, shift: Column, angular_bins: int, channels: int) -> Column:
    """Bin ``a`` of the result is bin ``a + shift`` of the input."""
    cut = shift.cast("int") * F.lit(channels)
    full = F.lit(angular_bins * channels)
    return F.concat(F.slice(vector, cut + 1, full - cut), F.slice(vector, F.lit(1), cut))


def shift_logits(query: Column, valid: Column, gallery: Column, angular_bins: int, channels: int) -> Column:
    """Mean masked dot product at every circular gallery shift (small data and checks)."""
    masked = F.transform(
        query,
        lambda x, i: F.when(F.element_at(valid, int_div(i, channels).cast("int") + 1), x).otherwise(F.lit(0.0)),
    )
    bins = F.greatest(F.size(F.filter(valid, lambda v: v)), F.lit(1)).cast("double")

    def at_all_shifts(side: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(angular_bins - 1)),
            lambda k: dot(side["query"], rotate_bins(side["gallery"], k, angular_bins, channels)) / side["bins"],
        )

    parts = F.named_struct(F.lit("query"), masked, F.lit("gallery"), gallery, F.lit("bins"), bins)
    return let(parts, at_all_shifts)


def cyclic_score(query: Column, valid: Column, gallery: Column, angular_bins: int, channels: int) -> Column:
    """Best quantised logit over all shifts, with the smallest shift that reaches it."""
    def best(logits: Column) -> Column:
        top = F.array_max(logits)
        shift = (F.array_position(logits, top) - 1).cast("bigint")
        return F.named_struct(F.lit("score_q"), top, F.lit("shift"), shift)

    logits = shift_logits(query, valid, gallery, angular_bins, channels)
    return let(F.transform(logits, lambda x: quantise(x)), best)

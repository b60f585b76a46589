"""Integer crop arithmetic on panorama pixels and uint32 headings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringmatch.functions.seeds import UINT32_RANGE, stable_seed


# They enter the seeds of the headings.
TRAIN_SALT = "train_orientation"
HARD_SALT = "hard_mining_orientation"


def int_div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def orientation_to_center_px(orientation: Column, panorama_width: int) -> Column:
    """floor(u32 * width / 2^32), exact in 64-bit integers."""
    return F.shiftright(orientation.cast("bigint") * F.lit(panorama_width).cast("bigint"), 32)


def center_px_to_orientation(center: Column, panorama_width: int) -> Column:
    """Smallest uint32 heading whose pixel is ``center`` (taken modulo the width)."""
    width = F.lit(panorama_width).cast("bigint")
    wrapped = F.pmod(center.cast("bigint"), width)
    return int_div(wrapped * F.lit(UINT32_RANGE) + width - 1, width)


def crop_width(fov: Column, panorama_width: int) -> Column:
    """Exact pixel width of a field of view; null where it is not an integer."""
    pixels = fov.cast("bigint") * F.lit(panorama_width).cast("bigint")
    return F.when(pixels % 360 == 0, int_div(pixels, F.lit(360).cast("bigint")))


def _spec(orientation: Column, center: Column, width: Column, panorama_width: int) -> Column:
    return F.struct(
        orientation.alias("orientation_u32"),
        center.alias("center_px"),
        width.alias("width"),
        F.lit(panorama_width).cast("bigint").alias("panorama_width"),
    )


def _seeded_crop(seed, epoch, query_id, fov, panorama_width, dataset, salt) -> Column:
    orientation = stable_seed(seed, dataset, "train", epoch, query_id, salt)
    center = orientation_to_center_px(orientation, panorama_width)
    return _spec(orientation, center, crop_width(fov, panorama_width), panorama_width)


def train_crop(seed, epoch, query_id: Column, fov: Column, panorama_width: int, dataset) -> Column:
    """Training crop: one heading per (epoch, query), shared by every FoV."""
    return _seeded_crop(seed, epoch, query_id, fov, panorama_width, dataset, TRAIN_SALT)


def hard_mining_crop(seed, source_epoch, query_id: Column, fov: Column, panorama_width: int, dataset) -> Column:
    """Crop used to mine a pool and again by every hard batch that draws on that pool."""
    return _seeded_crop(seed, source_epoch, query_id, fov, panorama_width, dataset, HARD_SALT)


def random_crop(roll_deg: Column, fov: Column, panorama_width: int) -> Column:
    """Right-roll by whole degrees, then crop from the left edge."""
    full = F.lit(panorama_width).cast("bigint")
    width = crop_width(fov, panorama_width)
    start = F.pmod(-int_div(roll_deg.cast("bigint") * full, F.lit(360).cast("bigint")), full)
    center = F.pmod(start + int_div(width, F.lit(2).cast("bigint")), full)
    return _spec(center_px_to_orientation(center, panorama_width), center, width, panorama_width)


def crop_interval(center: Column, width: Column) -> tuple[Column, Column]:
    """Half-open, unwrapped pixel interval around a center."""
    two = F.lit(2).cast("bigint")
    return center - int_div(width, two), center + int_div(width + 1, two)


def heading_deg(orientation: Column) -> Column:
    return orientation * F.lit(360.0) / F.lit(float(UINT32_RANGE))


def fov_geometry(
    fov: Column,
    panorama_width: int,
    patch_size: int,
    angular_bins: int,
    registered_widths: Mapping[int, int] | None = None,
) -> dict[str, Column]:
    """Crop, patch-grid and direction sizes of a field of view.

    An unregistered FoV is rounded up to a whole number of patches. Entries are null where the
    FoV gives no whole pixel width, patch grid or direction count.
    """
    physical = crop_width(fov, panorama_width)
    patch = F.lit(patch_size).cast("bigint")
    rounded = int_div(physical + patch - 1, patch) * patch
    aligned = rounded
    for value, width in sorted((registered_widths or {}).items()):
        aligned = F.when(fov == value, F.lit(width).cast("bigint")).otherwise(aligned)
    bins = fov.cast("bigint") * F.lit(angular_bins).cast("bigint")
    return {
        "physical_crop_width": physical,
        "aligned_input_width": aligned,
        "source_patch_columns": F.when(aligned % patch == 0, int_div(aligned, patch)),
        "target_direction_bins": F.when(bins % 360 == 0, int_div(bins, F.lit(360).cast("bigint"))),
    }


class FovSizes(NamedTuple):
    """What a field of view means for a panorama of a given width, patch size and number of directions."""

    crop_px: int
    input_px: int
    patch_columns: int
    direction_bins: int


def _whole_share(fov: int, total: int, of: str) -> int:
    share, rest = divmod(fov * total, 360)
    if rest:
        raise ValueError(f"{fov} of 360 degrees cut {total} {of} at a fraction")
    return share


def fov_sizes(
    fovs: Sequence[int],
    panorama_width: int,
    patch_size: int,
    angular_bins: int,
    registered: Mapping[int, tuple[int, int, int]] | None = None,
) -> dict[int, FovSizes]:
    """Sizes per FoV, checked before any job starts.

    A crop has its exact pixel width; it is stretched to the next whole number of patches, or to the
    registered one. ``registered`` holds ``(input_px, patch_columns, direction_bins)`` per FoV; a
    registered column or bin count that differs from the computed one is refused.
    """
    out: dict[int, FovSizes] = {}
    for fov in map(int, fovs):
        if fov in out:
            raise ValueError(f"FoV {fov} is listed twice")
        if fov < 1 or fov > 360:
            raise ValueError(f"A FoV of {fov} degrees is no part of a circle")
        bins = _whole_share(fov, angular_bins, "directions")
        crop = _whole_share(fov, panorama_width, "pixels")
        known = (registered or {}).get(fov)
        wide = known[0] if known else crop + -crop % patch_size
        columns, rest = divmod(wide, patch_size)
        if rest or columns < 1:
            raise ValueError(f"{wide} pixels for FoV {fov} are not whole patches of {patch_size}")
        if known and tuple(known[1:]) != (columns, bins):
            raise ValueError(f"FoV {fov} is registered with {known[1:]} columns and directions, its sizes give {(columns, bins)}")
        out[fov] = FovSizes(crop, wide, columns, bins)
    return out


def validate_fovs(fovs: Sequence[int], panorama_width: int, angular_bins: int) -> tuple[int, ...]:
    """The FoVs as a tuple, if each is a whole number of pixels and of directions."""
    return tuple(fov_sizes(fovs, panorama_width, 1, angular_bins))

"""NumPy helpers for one bounded block of direction descriptors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 1_000_000


def quantise(values: np.ndarray) -> np.ndarray:
    """Fixed-point scores as whole-number doubles (exact below 2^53)."""
    return np.floor(values * SCALE + 0.5)


def list_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column with a fixed length as a float64 matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(array) * width:
        raise ValueError(f"Descriptors must hold {width} values each")
    return np.asarray(flat, dtype=np.float64).reshape(len(array), width)


def real_spectrum(directions: np.ndarray) -> np.ndarray:
    """Angular spectrum of ``[n, A, D]`` as ``[F, n, 2D]``: real parts, then imaginary parts."""
    spectrum = np.fft.rfft(directions, axis=1).transpose(1, 0, 2)
    return np.concatenate([spectrum.real, spectrum.imag], axis=2)


def quarter_turn(spectrum: np.ndarray) -> np.ndarray:
    """Partner of :func:`real_spectrum` whose dot product gives the imaginary cross term."""
    half = spectrum.shape[2] // 2
    return np.concatenate([spectrum[:, :, half:], -spectrum[:, :, :half]], axis=2)


def inverse_transform(angular_bins: int) -> np.ndarray:
    """Real matrix ``[A, 2F]`` from stacked cross-spectrum parts to the A shift sums."""
    frequencies = angular_bins // 2 + 1
    weight = np.full(frequencies, 2.0)
    weight[0] = 1.0
    if angular_bins % 2 == 0:
        weight[-1] = 1.0
    angle = 2.0 * np.pi * np.outer(np.arange(angular_bins), np.arange(frequencies)) / angular_bins
    return np.concatenate([weight * np.cos(angle), -weight * np.sin(angle)], axis=1) / angular_bins


def masked_queries(directions: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero the invalid bins; return the divisor (valid bins, at least one) as well."""
    return directions * valid[:, :, None], np.maximum(valid.sum(axis=1), 1).astype(np.float64)


def grid_logits(query, gallery_re, gallery_im, divisor, inverse) -> np.ndarray:
    """``[A, q, n]`` logits of every query spectrum against every gallery spectrum."""
    parts = np.concatenate(
        [np.matmul(query, gallery_re.transpose(0, 2, 1)), np.matmul(query, gallery_im.transpose(0, 2, 1))]
    )
    sums = inverse @ parts.reshape(len(parts), -1)
    sums = sums.reshape(len(inverse), query.shape[1], gallery_re.shape[1])
    sums /= divisor[None, :, None]
    return sums


def pair_logits(query, gallery_re, gallery_im, divisor, inverse) -> np.ndarray:
    """``[A, p]`` logits of row-aligned query and gallery spectra."""
    parts = np.concatenate(
        [np.einsum("fpd,fpd->fp", query, gallery_re), np.einsum("fpd,fpd->fp", query, gallery_im)]
    )
    return (inverse @ parts) / divisor[None, :]


#: Half the distance from one to the next single-precision number.
SINGLE = 2.0**-24


def single_margin(terms: int, query_length: np.ndarray, gallery_length: float) -> np.ndarray:
    """A bound on how far a single-precision sum of ``terms`` products, folded at most twice, is from the true one."""
    return 2 * (terms + 8) * SINGLE * query_length * gallery_length + 1e-9


def folds(bins: int, seen: int) -> int:
    """How often the circle is folded for queries that see ``seen`` leading bins; 0, 1 or 2.

    A fold halves the products of one half, at the price of more sums: it pays where more than that half's share is seen.
    """
    if bins % 4 == 0 and seen > bins // 4:
        return 2
    return 1 if bins % 2 == 0 and seen > bins // 2 else 0


def turned_tiles(tiles: np.ndarray, fold: int) -> np.ndarray:
    """``[n, A, D]`` as single-precision columns, bins repeated so that every shift is a run of rows.

    Folded: the halves of the circle added, then subtracted; turning by half a circle only changes the sign of the latter.
    Folded twice: the added halves are folded again.
    """
    if fold:
        half, quarter = tiles.shape[1] // 2, tiles.shape[1] // 4
        even, odd = (tiles[:, :half] + tiles[:, half:]) / 2, (tiles[:, :half] - tiles[:, half:]) / 2
        rows = [even, even, odd, -odd]
        if fold > 1:
            again, other = (even[:, :quarter] + even[:, quarter:]) / 2, (even[:, :quarter] - even[:, quarter:]) / 2
            rows = [again, again, other, -other, odd, -odd]
        rows = np.concatenate(rows, axis=1)
    else:
        rows = np.concatenate([tiles, tiles], axis=1)
    return np.ascontiguousarray(rows.reshape(len(rows), -1).T, dtype=np.float32)


def folded_queries(directions: np.ndarray, fold: int = 1) -> np.ndarray:
    """The partner of folded :func:`turned_tiles`."""
    half, quarter = directions.shape[1] // 2, directions.shape[1] // 4
    even, odd = directions[:, :half] + directions[:, half:], directions[:, :half] - directions[:, half:]
    if fold == 1:
        return np.concatenate([even, odd], axis=1)
    return np.concatenate([even[:, :quarter] + even[:, quarter:], even[:, :quarter] - even[:, quarter:], odd], axis=1)


def shift_peaks(query: np.ndarray, turned: np.ndarray, bins: int, channels: int, fold: int) -> np.ndarray:
    """``[q, n]`` single-precision maxima over all shifts; ``query`` holds flat leading bins, or folded ones."""
    if fold > 1:
        return _twice_folded_peaks(query, turned, bins, channels)
    peak = np.empty((len(query), turned.shape[1]), dtype=np.float32)
    other, odd = np.empty_like(peak), np.empty_like(peak) if fold else None
    width = query.shape[1] // (2 if fold else 1)
    for shift in range(bins // 2 if fold else bins):
        start = shift * channels
        out = other if shift else peak
        np.matmul(query[:, :width], turned[start : start + width], out=out)
        if fold:
            np.matmul(query[:, width:], turned[start + 2 * width : start + 3 * width], out=odd)
            np.add(out, np.abs(odd, out=odd), out=out)
        if shift:
            np.maximum(peak, other, out=peak)
    return peak


def _twice_folded_peaks(query: np.ndarray, turned: np.ndarray, bins: int, channels: int) -> np.ndarray:
    """:func:`shift_peaks` of twice folded rows: shifts a quarter of the circle apart share their even products."""
    width = bins // 4 * channels
    peak = np.empty((len(query), turned.shape[1]), dtype=np.float32)
    even, other, odd = np.empty_like(peak), np.empty_like(peak), np.empty_like(peak)
    for shift in range(bins // 4):
        start = shift * channels
        np.matmul(query[:, :width], turned[start : start + width], out=even)
        np.matmul(query[:, width : 2 * width], turned[start + 2 * width : start + 3 * width], out=other)
        for turn in range(2):
            first = start + (4 + turn) * width
            np.matmul(query[:, 2 * width :], turned[first : first + 2 * width], out=odd)
            np.abs(odd, out=odd)
            np.add(odd, even, out=odd)
            (np.subtract if turn else np.add)(odd, other, out=odd)
            if shift or turn:
                np.maximum(peak, odd, out=peak)
            else:
                peak, odd = odd, peak
    return peak


def odd_lengths(folded: np.ndarray, bins: int, channels: int, axis: int) -> np.ndarray:
    """Lengths of the subtracted halves in twice folded queries (axis 1) or tiles (axis 0), in single precision."""
    start = bins // 2 * channels * (1 if axis else 2)
    odd = folded.take(np.arange(start, start + bins // 2 * channels), axis=axis).astype(np.float64)
    return np.sqrt((odd * odd).sum(axis=axis)).astype(np.float32)


def shift_bounds(query: np.ndarray, turned: np.ndarray, bins: int, channels: int, lengths: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``[q, n]`` values that :func:`shift_peaks` of twice folded rows does not exceed, for a third of its products.

    What the subtracted halves add is at most the product of their lengths (``lengths``: of queries and tiles).
    """
    width = bins // 4 * channels
    peak = np.empty((len(query), turned.shape[1]), dtype=np.float32)
    even, other = np.empty_like(peak), np.empty_like(peak)
    for shift in range(bins // 4):
        start = shift * channels
        out = even if shift else peak
        np.matmul(query[:, :width], turned[start : start + width], out=out)
        np.matmul(query[:, width : 2 * width], turned[start + 2 * width : start + 3 * width], out=other)
        np.add(out, np.abs(other, out=other), out=out)
        if shift:
            np.maximum(peak, even, out=peak)
    return np.add(peak, np.multiply(lengths[0][:, None], lengths[1][None, :], out=other), out=peak)


def row_counts(mask: np.ndarray) -> np.ndarray:
    """True entries per row of a contiguous mask."""
    if mask.shape[1] % 8 or mask.shape[1] > 2_040:  # a byte of a word's sum holds 255
        return np.count_nonzero(mask, axis=1)
    words = np.add.reduce(mask.view(np.uint64), axis=1)
    return words.view(np.uint8).reshape(len(mask), 8).sum(axis=1, dtype=np.int64)


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true entries of a mask, as ``np.nonzero`` gives them."""
    flat = mask.reshape(-1)
    if flat.size % 8 == 0:
        words = np.flatnonzero(flat.view(np.uint64))
        if 8 * len(words) < flat.size // 4:
            near = (words[:, None] * 8 + np.arange(8)).reshape(-1)
            return np.divmod(near[flat[near]], mask.shape[1])
    return np.nonzero(mask)


def best_shift(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised maximum over shifts (axis 0) and the smallest shift reaching it."""
    q = quantise(logits)
    return q.max(axis=0), q.argmax(axis=0)


def turn_signature(directions: np.ndarray, frequency_count: int) -> np.ndarray:
    """``[n, F*D]`` unit rows that keep their value when the bins are turned.

    Per channel the sum over all bins, with its sign, then the amplitudes of the next waves.
    """
    bins = directions.shape[1]
    if frequency_count < 1 or frequency_count > bins // 2 + 1:
        raise ValueError(f"{bins} bins have no {frequency_count} waves")
    angle = (2.0 * np.pi / bins) * np.outer(np.arange(frequency_count), np.arange(bins))
    even, odd = (np.einsum("fa,nad->nfd", wave, directions) for wave in (np.cos(angle), np.sin(angle)))
    amplitude = np.hypot(even, odd)
    amplitude[:, 0] = even[:, 0]
    rows = amplitude.reshape(len(amplitude), -1)
    return rows / np.sqrt(np.maximum(np.einsum("nk,nk->n", rows, rows), 1e-24))[:, None]


def top_k_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k largest quantised scores per row; ties go to the smaller column."""
    count = scores.shape[1]
    key = scores.astype(np.int64) * count + (count - 1 - np.arange(count))
    if k < count:
        part = np.argpartition(key, count - k, axis=1)[:, count - k :]
    else:
        part = np.broadcast_to(np.arange(count), key.shape)
    order = np.argsort(-np.take_along_axis(key, part, axis=1), axis=1)
    return np.take_along_axis(part, order, axis=1)

"""Codebooks against all distances in whole numbers, and the way back."""

import hashlib
import math
import random

import numpy as np
import pytest

from ringmatch.llm import codebooks
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, whole string, part int, held long"
COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)


def compressed(rows, parts=8, entries=16, rounds=6):
    """Brute force with Python's whole numbers; ``rows`` have unique ids and equal lengths."""
    kept = sorted((i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows)
    step = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = {}
            for _, v, _ in kept:
                found.setdefault(nearest(books[p], cut(v, p))[1], []).append(cut(v, p))
            for k, vs in found.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        ends = [nearest(books[p], cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in ends), sum(d for d, _ in ends), label))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, code, error, total[label], sha) for i, code, error, label in out), key=repr)


def vectors(seed, n, dimension, spread=1.0):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, spread) for _ in range(dimension)] for _ in range(5)]
    rows = []
    for k in range(n):
        middle = middles[draw.randrange(5)]
        rows.append((3 * k - 7, [float(np.float32(m + draw.gauss(0, 0.2))) for m in middle], draw.choice((0, 0, 0, 1, k, None))))
    return rows


@pytest.mark.parametrize("n, dimension, spread", [(300, 16, 1.0), (9, 8, 1.0), (200, 24, 0.001), (120, 16, 8_000.0)])
def test_equals_all_distances(spark, n, dimension, spread):
    rows = vectors(n, n, dimension, spread)
    rows += [(10_000 + k, rows[k % len(rows)][1], 5) for k in range(20)]  # copies: ties between equal entries
    got = codebooks.compress(table(spark, rows).repartition(4))
    assert rows_of(got, *COLUMNS) == compressed(rows)


def test_slices_equal_all_distances():
    draw = np.random.default_rng(2)
    for entries, spread in ((16, 50), (1, 9), (64, 3), (16, 1 << 27)):
        book = draw.integers(-spread, spread + 1, (entries, 8))
        parts = np.concatenate([draw.integers(-spread, spread + 1, (500, 8)), book, np.full((2, 8), codebooks.LARGEST)])
        index, squares = codebooks.Slices(book).nearest(parts)
        all_squares = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert index.tolist() == all_squares.argmin(axis=1).tolist()
        assert squares.tolist() == all_squares.min(axis=1).tolist()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 8.0] * 8, None if k % 2 else 1) for k in range(6)]
    odd = [(50, None, 1), (51, [nan] * 8, 1), (52, [1.0] * 7 + [inf], 1), (53, [1.0] * 7 + [None], 1), (54, [1.0], 1), (55, [], 1)]
    assert rows_of(codebooks.compress(table(spark, good + odd)), *COLUMNS) == compressed(good)
    for rows in ([], odd[:4], [(1, [], 1)]):
        got = codebooks.compress(table(spark, rows))
        assert tuple(got.columns) == COLUMNS and got.count() == sum(r[1] == [] for r in rows)


def test_zero_vectors_null_ids_copies_and_huge_components(spark):
    rows = [(None, [0.5] * 8, 1), (1, [0.0] * 8, 1), (1, [0.0] * 8, 1), (2, [3e38] * 8, None), (3, [-3e38] * 8, 2), (4, [1.0] * 9, 2)]
    got = codebooks.compress(table(spark, rows)).collect()
    assert len(got) == 5 and [r["vec_id"] for r in got].count(1) == 2
    assert all(r["error"] == 0 for r in got)  # five vectors, five entries


def test_decoded_codes_are_near(spark):
    rows = vectors(4, 400, 16)
    kept, width = codebooks.whole_vectors(table(spark, rows))
    book = codebooks.train(kept, width)
    coded = codebooks.encode(kept, book)
    errors = {r["vec_id"]: r["error"] for r in coded.collect()}
    original = {i: np.floor(4096 * np.array(v, dtype=np.float64)) for i, v, _ in rows}
    for row in codebooks.decode(coded, book).collect():
        gap = original[row["vec_id"]] - 4096 * np.array(row["embedding"])
        assert int(round((gap**2).sum())) == errors[row["vec_id"]]


def test_hot_and_rare_labels(spark):
    """One label with most rows, 2,000 labels with one row each, and null."""
    rows = [(k, "00" * 8, k, 7) for k in range(3_000)] + [(10_000 + k, "00" * 8, 1, 100 + k) for k in range(2_000)] + [(20_000, "", 5, None), (20_001, "", 6, None)]
    coded = spark.createDataFrame(rows, "vec_id long, code string, error long, label int")
    got = {r["vec_id"]: r["label_error"] for r in codebooks.with_label_error(coded).collect()}
    assert len(got) == len(rows) and got[20_000] == got[20_001] == 11
    assert {got[k] for k in range(3_000)} == {sum(range(3_000))}
    assert {got[10_000 + k] for k in range(2_000)} == {1}

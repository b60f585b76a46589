"""Spelling groups against every pair of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ringmatch.llm import spelling
from tests.llm.helpers import AWKWARD, documents, rows_of

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def counted(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 7 and n >= 2}


def grouped(n):
    near = {w: sorted((v for v in n if one_edit(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 10 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def corpus(seed=5):
    draw = random.Random(seed)
    letters = "abcdeé×ÿ"
    rows = list(AWKWARD)
    for k in range(60):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(7, 11)))
        parts = [word] * draw.choice((25, 130))
        for _ in range(6):
            at, c = draw.randrange(len(word)), draw.choice(letters)
            changed = draw.choice((word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]))
            parts += [changed] * draw.randint(1, 4)
            again = changed[: at // 2] + c + changed[at // 2 :]
            parts += [again.upper() if c < "z" else again] * 2
        draw.shuffle(parts)
        rows += [(1_000 + 10 * k + j, " ".join(parts[j::5])) for j in range(5)]
    rows += [(7, "Z" * 3_000 + " " + "Z" * 3_001), (8, "z" * 3_000 + "," + "z" * 3_001), (9, "Abcdefg-abcdefg_ABCDEFG")]
    return rows


@pytest.mark.parametrize("groups, block", [(4, 4_096), (6, 16), (5, 2)])
def test_equals_all_pairs(spark, groups, block):
    rows = corpus()
    vocabulary = spelling.written(spelling.words(documents(spark, rows)), "words")
    want = counted(rows)
    assert {r["word"]: r["n"] for r in vocabulary.collect()} == want
    found = spelling.spelling_groups(vocabulary, groups=groups, block=block)
    assert rows_of(found, *COLUMNS) == grouped(want)


def test_long_chains_and_hot_forms(spark):
    """Each word hangs on the next one; one form has every word of a star."""
    chain = [("abcdefg" + "h" * k, 2 * 10**k) for k in range(9)]
    star = [("stellar", 10**9)] + [("stella" + c, 2) for c in "abcdefghijklmnopqstuvwxyz"]
    vocabulary = spark.createDataFrame(chain + star, "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_groups(vocabulary).collect()}
    assert {got[w]["root"] for w, _ in chain} == {"abcdefg" + "h" * 8}
    assert all(got[w]["form"] == "stellar" and got[w]["n_near"] == len(star) - 1 for w, _ in star[1:])
    assert got["stellar"]["form"] is None and got["stellar"]["root"] == "stellar" and got["stellar"]["form_n"] is None


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short words only"), (4, "longerword once")]):
        found = spelling.spelling_variants(documents(spark, rows))
        assert found.collect() == [] and found.columns == list(COLUMNS)


def test_one_edit_of_long_words():
    texts = ["ab" * 2_000, "ab" * 2_000 + "a", "ab" * 1_000 + "b" + "ab" * 1_000, "ab" * 1_000 + "c" + "ab" * 1_000, "ba" * 2_000]
    import pyarrow as pa

    codes, lengths = spelling.letter_codes(pa.array(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pairs = [(i, j) for i in range(5) for j in range(5) if i != j and lengths[i] <= lengths[j]]
    a, b = np.array(pairs).T
    got = spelling.one_edit(a, b, codes, starts, lengths)
    assert got.tolist() == [one_edit(texts[i], texts[j]) for i, j in pairs]


def test_texts_with_their_roots(spark):
    rows = [(1, "Flavour and flavour, flavvour! flavour"), (2, None), (3, ""), (4, "Flavvour"), (5, "none of these"), (6, "é flavvour-x")]
    docs = documents(spark, rows)
    groups = spark.createDataFrame([("flavvour", "flavour", "flavour")], "word string, form string, root string")
    got = spelling.normalised(docs, groups)
    assert got.columns == docs.columns
    want = [(1, "Flavour and flavour, flavour! flavour"), (2, None), (3, ""), (4, "flavour"), (5, "none of these"), (6, "é flavour-x")]
    assert rows_of(got, "doc_id", "text") == sorted(want, key=repr)

"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

Per word the letter counts are a vector. For two words, the product of their vectors gives the
squared distance ``|a|^2 + |b|^2 - 2ab``: it is 1 for an inserted or deleted letter and 2 for a
replaced one, so only pairs at most two apart in equal or adjacent length blocks are verified letter
by letter.

Blocks are kept small without losing a pair: the letters are dealt into groups of about equal
weight, and an edit changes the counts of two groups at most. So two near words have equal counts in
all but two groups, and a word stands in one block for each choice of the groups that stay. A pair is
counted in the first block that it shares. Blocks beyond a bound are cut by hash into parts, and each
two parts meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import durable, ship_package, texts_of, written

#: Letters of a word: A-Z, a-z and the Latin letters (and two signs) from U+00C0 to U+00FF. Fixed value.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form occurs at least so many times as often as the word.
FORM_RATIO = 10
#: Words of a block that one task holds; a larger block is cut into parts of about half of it.
BLOCK = 4_096
#: Rows of a Gram matrix at most; small blocks share one.
TOGETHER = 1_024
#: Letters that have a count of their own: a-z and U+00C0 to U+00FF.
LETTERS = 90
#: Groups of letters by the number of words. It bounds the blocks, the result is the same.
GROUPS = ((2_000_000, 4), (100_000_000, 6))
MOST_GROUPS = 8


def lower_case(column: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(docs: DataFrame, noise: int = 31) -> DataFrame:
    """``word, n``: the words of all whole texts that are long and frequent enough.

    A word is a maximal run of letters, A-Z in lower case. Where ``noise`` divides the crc32 of
    ``<doc_id>:<run>``, the run loses the letter at that number modulo its length (a null id reads as
    the empty string). Null texts have no words, repeated rows count again.
    """
    text = F.col("text")
    # A deletion only shortens a run, so shorter runs never become words; the match is maximal all the same.
    runs = texts_of(docs).select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", lower_case(F.col("run")).alias("run"))
    mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("mark") % F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("mark") % noise == 0, without).otherwise(F.col("run"))
    marked = runs.withColumn("mark", mark).select(word.alias("word"))
    long_enough = marked.where(F.length("word") >= LEAST_LENGTH)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter number of every code point of the words in turn, and each word's length."""
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    codes = np.where(points < 0x80, points - ord("a"), points - 0xC0 + 26)
    return codes, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def letter_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``[words, LETTERS]``: how often each letter stands in each word."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(owner * LETTERS + codes, minlength=len(lengths) * LETTERS).reshape(-1, LETTERS)


def letter_groups(vocabulary: DataFrame, groups: int) -> np.ndarray:
    """Group of every letter: the most frequent first, each to the lightest group so far.

    Only one count per letter reaches the driver.
    """
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    held = {r["letter"]: r["count"] for r in letters.groupBy("letter").count().collect()}
    weight, out = [0] * groups, np.arange(LETTERS) % groups
    for letter in sorted(held, key=lambda c: (-held[c], c)):
        lightest = weight.index(min(weight))
        code = ord(letter) - ord("a") if ord(letter) < 0x80 else ord(letter) - 0xC0 + 26
        out[code], weight[lightest] = lightest, weight[lightest] + held[letter]
    return out


def _choices(groups: int) -> list[tuple[int, ...]]:
    """The groups that may stay equal: all but two."""
    return list(combinations(range(groups), groups - 2))


def _first_choice(groups: int) -> np.ndarray:
    """``[g, h]``: the first choice that has neither of two groups."""
    chosen = [set(c) for c in _choices(groups)]
    return np.array([[next(k for k, c in enumerate(chosen) if not c & {g, h}) for h in range(groups)] for g in range(groups)])


def block_keys(vocabulary: DataFrame, of_letter: np.ndarray) -> DataFrame:
    """``key, choice, word, n``: each word once for each choice of equal groups.

    ``key`` mixes the choice and the counts in its groups. Words whose keys are equal by chance meet in
    vain, but nothing is missed.
    """
    groups = int(of_letter.max()) + 1
    choices = _choices(groups)
    draw = np.random.default_rng(7)
    factor = draw.integers(1, 1 << 63, LETTERS, dtype=np.uint64) | np.uint64(1)
    mix = draw.integers(1, 1 << 63, groups, dtype=np.uint64) | np.uint64(1)
    salt = draw.integers(1, 1 << 63, len(choices), dtype=np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = letter_codes(batch.column("word"))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = np.zeros((len(lengths), groups), dtype=np.uint64)
            np.add.at(sums, (owner, of_letter[codes]), factor[codes])
            sums ^= sums >> np.uint64(29)
            sums *= mix
            sums ^= sums >> np.uint64(32)
            for choice, held in enumerate(choices):
                key = salt[choice] + sums[:, list(held)].sum(axis=1, dtype=np.uint64)
                number = pa.array(np.full(len(lengths), choice, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), number, batch.column("word"), batch.column("n")],
                    ["key", "choice", "word", "n"],
                )

    return vocabulary.select("word", "n").mapInArrow(spread, "key long, choice int, word string, n long")


def one_edit(a: np.ndarray, b: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether words ``a`` and ``b`` (numbers, row by row) are exactly one edit apart; ``a`` is not the longer."""
    out = np.zeros(len(a), dtype=bool)
    order = np.argsort(lengths[b], kind="stable")
    at = 0
    while at < len(order):
        # Pairs of about equal length side by side, in a bounded rectangle.
        step = max(1, 2_000_000 // int(lengths[b[order[min(at + 4_096, len(order)) - 1]]]))
        part = order[at : at + min(step, 4_096)]
        x, y = a[part], b[part]
        width = int(lengths[y].max())
        column = np.arange(width)
        short, long = lengths[x], lengths[y]
        same = lambda i, j: points[np.minimum(i, len(points) - 1)] == points[np.minimum(j, len(points) - 1)]
        ahead = same(starts[x][:, None] + column, starts[y][:, None] + column) & (column < short[:, None])
        back_x = np.maximum(starts[x][:, None] + short[:, None] - 1 - column, 0)
        behind = same(back_x, starts[y][:, None] + long[:, None] - 1 - column) & (column < short[:, None])
        prefix = np.where(ahead.all(axis=1), width, ahead.argmin(axis=1))
        suffix = np.where(behind.all(axis=1), width, behind.argmin(axis=1))
        out[part] = (prefix + suffix >= long - 1) & ((short < long) | (prefix < short))
        at += len(part)
    return out


class Found:
    """Per word of a group of blocks: its near words so far, and the one that occurs most often."""

    def __init__(self, n: np.ndarray, texts: list[str]):
        self.n, self.texts = n, texts
        self.near = np.zeros(len(n), dtype=np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in ((a, b), (b, a)):
            self.near += np.bincount(x, minlength=len(self.near))
            for i, j in zip(x.tolist(), y.tolist()):
                rank = (-int(self.n[j]), self.texts[j])
                if i not in self.best or rank < self.best[i]:
                    self.best[i] = rank


def near_in_blocks(rows: pa.Table, of_letter: np.ndarray) -> pa.RecordBatch | None:
    """Near words among rows of whole blocks (``group, choice, word, n, side``), sorted by group.

    In a group whose sides differ only words of different sides are compared.
    """
    first = _first_choice(int(of_letter.max()) + 1)
    codes, lengths = letter_codes(rows.column("word").combine_chunks())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    group = rows.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
    side = rows.column("side").to_numpy()
    across = rows.column("across").to_numpy(zero_copy_only=False)
    choice = rows.column("choice").to_numpy()
    found = Found(rows.column("n").to_numpy(), rows.column("word").to_pylist())
    # Counts are whole numbers; single precision holds the squares exactly up to 2^24.
    kind = np.float32 if int(lengths.max()) < 2_000 else np.float64
    # By group, then by length: near words are in equal or adjacent length blocks.
    order = np.lexsort((lengths, group))
    edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    runs, at = list(zip(edges[:-1].tolist(), edges[1:].tolist())), 0
    while at < len(runs):
        stop = at + 1
        while stop < len(runs) and runs[stop][1] - runs[at][0] <= TOGETHER:
            stop += 1
        here = order[runs[at][0] : runs[stop - 1][1]]
        at = stop
        for top in range(0, len(here), TOGETHER):
            left = here[top : top + TOGETHER]
            # To the right: the rows themselves and all later ones up to the next length.
            right = here[top:]
            right = right[(group[right] < group[left[-1]]) | (lengths[right] <= lengths[left[-1]] + 1)]
            for edge in range(0, len(right), TOGETHER):
                other = right[edge : edge + TOGETHER]
                _meet(left, other, edge == 0, kind, codes, starts, lengths, group, side, across, choice, of_letter, first, found)
    hit = np.flatnonzero(found.near)
    if not len(hit):
        return None
    best = [found.best[i] for i in hit.tolist()]
    return pa.RecordBatch.from_arrays(
        [
            rows.column("word").combine_chunks().take(pa.array(hit)),
            pa.array(found.near[hit]),
            pa.array([-n for n, _ in best], pa.int64()),
            pa.array([w for _, w in best], pa.string()),
        ],
        ["word", "near", "best_n", "best"],
    )


def _counts_of(rows: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    size = lengths[rows]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return letter_counts(codes[np.repeat(starts[rows], size) + inside], size)


def _meet(left, right, same, kind, codes, starts, lengths, group, side, across, choice, of_letter, first, found) -> None:
    a = _counts_of(left, codes, starts, lengths)
    b = a if same and len(left) == len(right) else _counts_of(right, codes, starts, lengths)
    held = np.flatnonzero(a.any(axis=0) | b.any(axis=0))
    x, y = a[:, held].astype(kind), b[:, held].astype(kind)
    squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
    near = np.argwhere(squares <= 2)
    if same:
        near = near[near[:, 0] < near[:, 1]]
    i, j = left[near[:, 0]], right[near[:, 1]]
    apart = lengths[j] - lengths[i]
    distance = squares[near[:, 0], near[:, 1]]
    keep = (group[i] == group[j]) & (((distance == 1) & (np.abs(apart) == 1)) | ((distance == 2) & (apart == 0)))
    keep &= ~across[i] | (side[i] != side[j])
    i, j, near = i[keep], j[keep], near[keep]
    # The one or two letters in which the counts differ name the first choice that the pair shares.
    differs = a[near[:, 0]] != b[near[:, 1]]
    low = of_letter[differs.argmax(axis=1)]
    high = of_letter[LETTERS - 1 - differs[:, ::-1].argmax(axis=1)]
    mine = first[low, high] == choice[i]
    i, j = i[mine], j[mine]
    swap = lengths[i] > lengths[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    true = one_edit(i, j, codes, starts, lengths)
    found.add(i[true], j[true])


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by group, of about ``most`` rows or one group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            if count < most:
                part = batch.slice(0, most - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                continue
            # Full: go on to the end of the last group.
            last = held[-1].column("group")[-1]
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            other = np.flatnonzero(groups != last.as_py())
            stop = int(other[0]) if len(other) else batch.num_rows
            if stop:
                held.append(batch.slice(0, stop))
                batch = batch.slice(stop)
            if len(other):
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def near_words(vocabulary: DataFrame, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """``word, n_near, best, best_n`` of every word with a near one.

    ``vocabulary``: durable distinct ``word, n`` (words of :data:`RUN` letters without A-Z). Two words
    are near if exactly one letter is inserted, deleted or replaced. ``best`` is the near word with the
    largest ``n`` (ties: the smallest in code-point order).
    """
    ship_package(vocabulary.sparkSession)
    if groups is None:
        total = vocabulary.count()
        groups = next((g for most, g in GROUPS if total <= most), MOST_GROUPS)
    of_letter = letter_groups(vocabulary, groups)
    keys = written(block_keys(vocabulary, of_letter), "blocks")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block)
    sizes = sizes.select(F.col("key").alias("__key"), F.ceil(F.col("held") * 2 / block).cast("int").alias("parts"))
    placed = keys.join(sizes, F.col("key") == F.col("__key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    group = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    met = met.select(group.alias("group"), "choice", "word", "n", "side", (low != high).alias("across"))
    dealt = met.repartition(F.col("group")).sortWithinPartitions("group")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 16 * TOGETHER):
            out = near_in_blocks(table, of_letter)
            if out is not None:
                yield out

    found = dealt.mapInArrow(compare, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    merged = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from durable ``word, form``; each round follows twice as many steps.

    A form occurs ten times as often as its word, so chains end after some 18 steps and five rounds.
    """
    chains = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = chains.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        joined = chains.join(ahead, F.col("root") == F.col("__at"), "left")
        chains = durable(joined.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        if chains.where("moved").isEmpty():
            return chains.select("word", "root")
        chains = chains.select("word", "root")


def spelling_groups(vocabulary: DataFrame, ratio: int = FORM_RATIO, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a durable vocabulary (``word, n``).

    ``form`` is the near word of largest ``n``, if that is at least ``ratio`` times the word's own,
    else null; ``root`` is the last word when forms are followed, the word itself without a form.
    """
    near = near_words(vocabulary, **options)
    joined = vocabulary.join(near, "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    counted = durable(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(counted.where("form is not null").select("word", "form"))
    named = counted.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, ratio: int = FORM_RATIO, **options) -> DataFrame:
    """The spelling groups of the words of all whole ``docs`` texts, see :func:`words` and :func:`spelling_groups`.

    Null and empty texts have no words; an empty table, or one without a repeated long word, gives no
    rows. Repeated rows count again, a null id reads as the empty string, other columns are ignored.
    """
    return spelling_groups(written(words(docs), "words"), ratio, **options)


def normalised(docs: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every word that has a root replaced by it (long words, A-Z in lower case).

    Words go through one equi-join per distinct word of a document, not per occurrence. Texts that are
    null stay null; documents keep all their columns. The result holds the texts, ``docs`` is durable.
    """
    changes = groups.where("form is not null").select(F.col("word").alias("__word"), F.col("root").alias("__root"))
    held = docs.withColumn("__row", F.monotonically_increasing_id())
    held = written(held, "rows")
    lower = lower_case(F.col(text))
    found = held.select("__row", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0)))).alias("__run"))
    pairs = found.join(changes, F.col("__run") == F.col("__word")).groupBy("__row").agg(
        F.map_from_entries(F.collect_list(F.struct("__word", "__root"))).alias("__changes")
    )
    joined = held.join(pairs, "__row", "left")
    # Runs and what stands between them in turn; the first gap may be empty.
    gaps = F.split(F.col(text), f"{RUN}+")
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}+"), F.lit(0))

    def place(gap: Column, at: Column) -> Column:
        run = F.get(runs, at)
        return F.concat(gap, F.coalesce(F.try_element_at(F.col("__changes"), lower_case(run)), run, F.lit("")))

    whole = F.array_join(F.transform(gaps, place), "")
    columns = [F.when(F.col("__changes").isNull(), F.col(text)).otherwise(whole).alias(text) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns)

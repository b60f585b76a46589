"""Language identification by cross-parsing.

Per language a suffix automaton holds labelled text. A text is parsed into the longest phrases that
occur there. Phrases are normalised by what the language's own text needs: part of the labelled texts is kept out
of the automaton and parsed with it, which gives a rate of phrases a letter. The language with the fewest phrases
over its rate wins. So a label whose sample is tiny, or hardly text, gains nothing by that.

Automata are built one per task and kept as double arrays (a transition is two lookups), so that their size follows
the sample and not the alphabet. Many texts are parsed in step with NumPy.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import frugal, ship_package

#: Symbols of training text per language: the sample is bounded whatever the table's size. Every
#: text that is classified is read whole.
SAMPLE_SYMBOLS = 49_152
#: Expected labelled documents per language in the sample, and characters taken from each at most.
SAMPLE_DOCUMENTS = 128
SAMPLE_CHARACTERS = 20_000
#: Labels that are learned at most, the most frequent ones; an automaton takes some 2 MB.
LANGUAGES = 128
#: One of so many sampled texts measures its language's rate instead of teaching it.
KEPT_OUT = 4
#: Letters that the mean rate of all languages counts as, when a language's own rate is measured.
RATE_LETTERS = 1_000
#: A language's rate is at most so many times the smallest one.
RATE_SPREAD = 2.0
#: A text is in a language if its phrases stay below this many, plus so many times the rate of nearly all of the
#: language's own texts.
FREE_PHRASES, RATE_SLACK, RATE_SHARE = 8, 1.75, 0.95
#: Bytes of all automata written out as plain tables in a worker; larger ones stay double arrays. The result is the same.
PLAIN_BYTES = 128 << 20
#: A text is parsed in stretches of so many symbols; a phrase ends where its stretch ends.
STRETCH = 512
#: Texts parsed together hold about so many characters.
TOGETHER = 1_000_000

RESULT = "lang_pred string, score double, mean_phrase double, known boolean"
_LETTER = regex.compile(r"\p{L}")
_COMBINING = regex.compile("[\u0300-\u036f]")


def in_training(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of every state of the suffix automaton of ``symbols``; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        here = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = here
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return following


class Parser:
    """One language: counts the phrases of many symbol stretches in step.

    A transition of state s with symbol c stands at ``base[s] + c`` of ``owner`` (must be s) and ``target``.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        following = automaton(symbols.tolist())
        sizes = [len(row) for row in following]
        room = 4 * sum(sizes) + 4 * width + 64
        owner = np.full(room, -1, dtype=np.int32)
        target = np.zeros(room, dtype=np.int32)
        self.base = np.zeros(len(following), dtype=np.int32)
        taken = bytearray(room)
        near = free = width  # bases stay positive
        # States with many transitions first, each close behind the last one; single ones fill the gaps.
        for state in sorted(range(len(following)), key=lambda s: -sizes[s]):
            row = following[state]
            if not row:
                break
            low = min(row)
            if len(row) > 1:
                place = near
                while any(taken[place - low + c] for c in row):
                    place += 1
                near = max(near, place - 32)
            else:
                place = free = taken.index(0, free)
            self.base[state] = place - low
            for c, to in row.items():
                taken[place - low + c] = 1
                owner[place - low + c], target[place - low + c] = state, to
        last = int(np.flatnonzero(owner >= 0).max(initial=0)) + 1
        self.owner, self.target = owner[: last + width], target[: last + width]
        self.start = np.zeros(width, dtype=np.int32)
        for c, to in following[0].items():
            self.start[c] = to
        self.rate, self.most = 0.0, 0.0

    steps: np.ndarray | None = None

    def write_out(self) -> None:
        """Every state and symbol in one table: place of the next state's row, and whether a phrase ends."""
        width = len(self.start)
        steps = np.empty((len(self.base), width), dtype=np.int32)
        for first in range(0, len(steps), 4_096):
            state = np.arange(first, min(first + 4_096, len(steps)), dtype=np.int32)[:, None]
            place = self.base[state] + np.arange(width, dtype=np.int32)
            goes = self.owner[place] == state
            following = np.where(goes, self.target[place], self.start)
            steps[first : first + 4_096] = following * (2 * width) + ~goes
        self.steps = steps.ravel()

    def phrases(self, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``grid[t]`` holds symbol t of every stretch; stretches are sorted by falling length."""
        at = np.zeros(len(lengths), dtype=np.int32)
        count = np.ones(len(lengths), dtype=np.int32)
        alive = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")
        if self.steps is not None:
            for t, n in enumerate(alive.tolist()):
                step = self.steps[at[:n] + grid[t, :n]]
                count[:n] += step & 1
                at[:n] = step >> 1
            return count
        for t, n in enumerate(alive.tolist()):
            here, symbol = at[:n], grid[t, :n]
            place = self.base[here] + symbol
            goes = self.owner[place] == here
            count[:n] += ~goes
            # Where a phrase ends the symbol begins the next one.
            at[:n] = np.where(goes, self.target[place], self.start[symbol])
        return count


def _is_letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


class Alphabet:
    """Symbols of letters and marks: 0 for all that is none, 1 for one that no sample holds, then the learned ones."""

    def __init__(self, texts: Iterator[str]):
        seen: set[str] = set()
        for text in texts:
            seen |= set(_plain(text))
        self.letters = sorted(c for c in seen if _is_letter(c))
        self.width = len(self.letters) + 2

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None}

    _table: np.ndarray | None = None

    def symbols(self, text: str) -> np.ndarray:
        """Lower-case letters as symbols; a run of anything else is one separator."""
        if self._table is None:
            table = np.zeros(0x110000, dtype=np.int32)
            for c in range(0x32000):
                if _is_letter(chr(c)):
                    table[c] = 1
            for k, c in enumerate(self.letters):
                table[ord(c)] = k + 2
            self._table = table
        points = np.frombuffer(_plain(text).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = self._table[points]
        keep = np.ones(len(found), dtype=bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]


def _plain(text: str) -> str:
    lower = text.lower()
    return unicodedata.normalize("NFC", lower) if _COMBINING.search(lower) else lower


class Stretches:
    """Texts cut into stretches and laid out so that one step reads a symbol of each."""

    def __init__(self, coded: list[np.ndarray]):
        self.texts = len(coded)
        self.sizes = np.array([len(c) for c in coded], dtype=np.int64)
        self.letters = np.array([np.count_nonzero(c) for c in coded], dtype=np.int64)
        stretches = -(-self.sizes // STRETCH)
        owner = np.repeat(np.arange(len(coded)), stretches)
        first = np.concatenate([[0], np.cumsum(stretches)])[: len(coded)]
        lengths = np.minimum(self.sizes[owner] - (np.arange(len(owner)) - first[owner]) * STRETCH, STRETCH)
        flat = np.zeros((len(owner), STRETCH), dtype=np.int32)
        for k, c in enumerate(coded):
            if len(c):
                flat[first[k] : first[k] + stretches[k]].reshape(-1)[: len(c)] = c
        order = np.argsort(-lengths, kind="stable")
        self.grid = np.ascontiguousarray(flat[order, : int(lengths.max()) if len(lengths) else 0].T)
        self.lengths, self.owner = lengths[order], owner[order]

    def phrases(self, parser: Parser) -> np.ndarray:
        """Phrases of each text."""
        return np.bincount(self.owner, parser.phrases(self.grid, self.lengths), self.texts)


def learned(texts: list[str], alphabet: Alphabet) -> Parser | None:
    """The automaton of one language's texts, with ``rate`` (phrases a letter of its own kept-out texts, 0 if there are
    none) and ``letters`` they hold, and ``most``, the rate that nearly all of them stay below. None without a letter."""
    coded = [c for c in map(alphabet.symbols, texts) if c.any()]
    if not coded:
        return None
    out = [k % KEPT_OUT == KEPT_OUT - 1 for k in range(len(coded))]
    parts, room = [], SAMPLE_SYMBOLS
    for c in (c for c, away in zip(coded, out) if not away):
        parts.append(c[:room])
        room -= len(parts[-1])
    parser = Parser(np.concatenate(parts), alphabet.width)
    own = Stretches([c for c, away in zip(coded, out) if away])
    count = own.phrases(parser)
    parser.letters = int(own.letters.sum())
    parser.rate = float(count.sum() / parser.letters) if parser.letters else 0.0
    parser.most = float(np.quantile((count - FREE_PHRASES) / own.letters, RATE_SHARE)) if parser.letters else 0.0
    return parser


class Model:
    """The parsers of all learned languages, by name, with their rates evened out."""

    def __init__(self, alphabet: Alphabet, parsers: dict[str, Parser]):
        self.alphabet = alphabet
        self.languages = sorted(parsers)
        self.parsers = [parsers[name] for name in self.languages]
        letters = np.array([p.letters for p in self.parsers], dtype=np.float64)
        rates = np.array([p.rate for p in self.parsers])
        known = letters > 0
        mean = float(np.average(rates[known], weights=letters[known])) if known.any() else 0.25
        evened = (rates * letters + mean * RATE_LETTERS) / (letters + RATE_LETTERS)
        floor = float(evened.min(initial=np.inf))
        self.rates = np.clip(evened, floor, RATE_SPREAD * floor)
        self.most = np.maximum([p.most for p in self.parsers], self.rates) * RATE_SLACK

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": False}

    _ready = False

    def release(self) -> None:
        """Drop the plain tables: a worker that waits for its next task, of whatever query, holds the double arrays only."""
        for parser in self.parsers:
            parser.steps = None
        self.alphabet._table = None
        self._ready = False

    def classify(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """Language, score, mean phrase length (letters and separators) of each whole text, and whether it is in it."""
        if not self._ready and sum(4 * len(p.base) * len(p.start) for p in self.parsers) <= PLAIN_BYTES:
            for parser in self.parsers:
                parser.write_out()
        self._ready = True
        laid = Stretches([self.alphabet.symbols(t) for t in texts])
        counts = np.array([laid.phrases(p) for p in self.parsers]).reshape(len(self.languages), len(texts))
        cost = counts / self.rates[:, None] if len(self.languages) else counts
        out = []
        for k, text in enumerate(texts):
            if not len(self.languages) or not _LETTER.search(text):
                out.append(("und", 0.0, 0.0, False))
                continue
            ranked = np.argsort(cost[:, k], kind="stable")  # ties: the first name
            first = ranked[0]
            best = cost[first, k]
            second = cost[ranked[1], k] if len(ranked) > 1 else np.inf
            score = 1.0 if np.isinf(second) else float(second / (best + second))
            known = counts[first, k] <= FREE_PHRASES + self.most[first] * laid.letters[k]
            out.append((self.languages[first], score, float(laid.sizes[k] / counts[first, k]), bool(known)))
        return out


def fit(docs: DataFrame) -> Model:
    """The model of the languages in ``docs``: rows with non-null text and ``lang`` that may be learned from.

    Per language a hash of the id picks about ``SAMPLE_DOCUMENTS`` rows. A label without a letter in its sample is not
    learned; of more than ``LANGUAGES`` labels the most frequent are.
    """
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "text", "lang").where(
        in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    frequent = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in frequent.collect()}
    if not counts:
        return Model(Alphabet(iter(())), {})
    pairs = [F.lit(x) for name, n in counts.items() for x in (name, min(1.0, SAMPLE_DOCUMENTS / n))]
    share = F.try_element_at(F.create_map(*pairs), F.col("lang"))
    order = F.xxhash64(F.lit("language sample"), F.col("doc_id"))
    picked = labelled.where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))
    picked = picked.select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARACTERS).alias("text"), order.alias("at"))
    samples: dict[str, list[str]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["at"], r["doc_id"], r["text"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    alphabet = Alphabet(t for texts in samples.values() for t in texts)
    ship_package(spark)
    sent = spark.sparkContext.broadcast((alphabet, samples))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, texts = sent.value
        for batch in batches:
            parsers = [learned(texts[name], letters) for name in batch["lang"]]
            yield pd.DataFrame({"lang": batch["lang"], "parser": [pickle.dumps(p) for p in parsers]})

    names = spark.createDataFrame([(n,) for n in sorted(samples)], "lang string").repartition(max(1, len(samples)), "lang")
    built = {r["lang"]: pickle.loads(r["parser"]) for r in names.mapInPandas(frugal(build), "lang string, parser binary").collect()}
    return Model(alphabet, {name: p for name, p in built.items() if p is not None})


def classifier(docs_session, model: Model):
    """A column function: text to ``struct<lang_pred, score, mean_phrase, known>``."""
    ship_package(docs_session)
    sent = docs_session.sparkContext.broadcast(model)

    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        here = sent.value
        try:
            for series in texts:
                rows: list[tuple[str, float, float, bool]] = []
                part: list[str] = []
                size = 0
                for text in series:
                    part.append(text or "")
                    size += len(part[-1])
                    if size >= TOGETHER:
                        rows += here.classify(part)
                        part, size = [], 0
                rows += here.classify(part) if part else []
                yield pd.DataFrame(rows, columns=["lang_pred", "score", "mean_phrase", "known"])
        finally:
            here.release()

    @F.pandas_udf(RESULT)
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from frugal(found)(texts)

    return classify


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, mean_phrase, known`` for every document.

    Only the text is an input of the prediction. ``und`` (score 0) where the text is null or holds
    no letter, or where nothing could be learned. ``score`` is second / (best + second) of the
    normalised phrase counts: a half where two languages tie, 1 with one language. ``known`` says whether
    the text needs no more phrases than nearly all kept-out texts of that language do. Rows map one to
    one; a null id is not held out and not learned from; an empty table gives no rows.
    """
    model = fit(docs) if model is None else model
    classify = classifier(docs.sparkSession, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    marked = docs.select("doc_id", held_out.alias("held_out"), classify("text").alias("found"))
    return marked.select("doc_id", "held_out", "found.*")

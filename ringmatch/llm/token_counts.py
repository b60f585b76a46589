"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the lengths of frequent words, tier two a bounded cache in each
Python worker that encodes what tier one lacks. No word ever crosses the network: the frequent
words come from a bounded sample that is counted inside the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.llm import words
from ringmatch.llm.common import ship_package, texts_of

#: Documents in the sample from which the frequent words are taken (expected number).
SAMPLE_DOCUMENTS = 2_000
#: Words in the broadcast table at most; a longer word never enters, so it stays below 8 MB.
FREQUENT_WORDS = 65_536
LONGEST_FREQUENT = 64


def _sampled_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update(w for w in text.split() if len(w) <= LONGEST_FREQUENT)
            if len(counts) > 4 * FREQUENT_WORDS:
                counts = Counter(dict(counts.most_common(2 * FREQUENT_WORDS)))
    top = counts.most_common(FREQUENT_WORDS)
    if not top:
        return
    yield pd.DataFrame({"word": [w for w, _ in top], "n": [n for _, n in top]})


def frequent_lengths(texts: DataFrame, tokenizer_text: str) -> dict[str, int]:
    """Token count per frequent word. The sample is bounded, so what the driver gets is bounded too.

    The table changes only the speed: a word it lacks is encoded where it occurs.
    """
    total = texts.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(total, 1))
    picked = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts: Counter[str] = Counter()
    for row in picked.select("text").mapInPandas(_sampled_words, "word string, n long").toLocalIterator():
        counts[row["word"]] += row["n"]
        if len(counts) > 4 * FREQUENT_WORDS:
            counts = Counter(dict(counts.most_common(2 * FREQUENT_WORDS)))
    chosen = [w for w, _ in counts.most_common(FREQUENT_WORDS)]
    found = words.load(tokenizer_text).encode_batch_fast(chosen, add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(chosen, found)}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer_path`` names a ``.json`` file of the tokenizers library or a ``.model`` file of
    sentencepiece. Begin, end and other added special tokens are not counted; special strings
    inside a text are handled as the library does by default. Rows map one to one: repeated rows
    and rows with a null ``doc_id`` each get their count; a null text counts as empty (0 bytes,
    0 tokens); an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = texts_of(docs)
    if tokenizer_path.endswith(".model"):
        counted = texts.mapInPandas(_piece_counter(spark, tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    else:
        with open(tokenizer_path, encoding="utf-8") as file:
            tokenizer_text = file.read()
        if words.splits_at_white_space(tokenizer_text):
            table = frequent_lengths(texts, tokenizer_text)
        else:
            table = None
        state = spark.sparkContext.broadcast((tokenizer_text, table))
        counted = texts.mapInPandas(_word_counter(state), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def _frame(batch: pd.DataFrame, n_tokens: list[int]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "doc_id": batch["doc_id"].astype("Int64"),
            "n_bytes": [len(t.encode("utf-8")) for t in batch["text"]],
            "n_tokens": n_tokens,
        }
    )


def _piece_counter(spark, path: str):
    with open(path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch in batches:
            yield _frame(batch, [len(pieces.encode(t, num_threads=1)) for t in batch["text"]])

    return count


_TIER_TWO: dict[int, words.Words] = {}


def _word_counter(state):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer_text, table = state.value
        tokenizer = words.load(tokenizer_text)

        def whole(text: str) -> int:
            return len(tokenizer.encode(text, add_special_tokens=False).ids)

        if table is None:
            for batch in batches:
                yield _frame(batch, [whole(t) for t in batch["text"]])
            return
        key = hash(tokenizer_text)
        if key not in _TIER_TWO:
            _TIER_TWO[key] = words.Words(whole)
        misses = _TIER_TWO[key]
        get = table.get
        apart = [*words.SEPARATORS, *words.special_strings(tokenizer_text)]

        def by_words(text: str) -> int:
            if any(s in text for s in apart):
                return whole(text)
            found = text.split()
            lengths = list(map(get, found))
            if None not in lengths:
                return sum(lengths)
            return sum(misses[w] if n is None else n for w, n in zip(found, lengths))

        for batch in batches:
            yield _frame(batch, [by_words(t) for t in batch["text"]])

    return count

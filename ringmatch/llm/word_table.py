"""BPE encoding and decoding through a table of distinct words.

Tasks split texts into words. The table of distinct words has two tiers. Frequent words (a bounded
number, learned from a bounded sample of documents) are encoded once and reach the texts by
broadcast, so no frequent word makes a hot key. All other words are dealt out by the word, so that
equal ones meet, each distinct word is encoded once where it meets, and its ids go back to the
documents by position. A document travels as the numbers of its frequent words, with gaps that the
joined ids fill. Which words are frequent changes the speed, never the result. Ids become text through
the tokenizer's id-to-piece table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.llm import words
from ringmatch.llm.common import ship_package, texts_of, written

#: Words in the broadcast table at most, and characters in one of them: at most some 30 MB of words.
FREQUENT_WORDS = 1 << 18
LONGEST_FREQUENT = 64
#: Documents in the sample from which the frequent words are taken (expected number).
SAMPLE_DOCUMENTS = 20_000
#: Distinct pieces that a task holds while it counts.
HELD_WORDS = 500_000
#: Marks that end a word.
MARKS = frozenset(".,;:!?")
GAP = 0xFFFFFFFF
#: Tasks that the occurrences of a word too long for the broadcast table are dealt over.
LONG_WORD_TASKS = 32


def plain(text: str, whole: list[str]) -> list[str]:
    """A text between white space with A-Z in lower case; a text that holds one of ``whole`` stays one piece."""
    if any(mark in text for mark in whole):
        return [text]
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").split()


def closing_mark(piece: str) -> bool:
    """Whether the last character is a mark that the tokenizer always parts from the Latin letter before it."""
    return len(piece) > 1 and piece[-1] in MARKS and piece[-2].isalpha() and piece[-2] < "\u0250" and piece[-2] != "İ"


def distinct_words(docs: DataFrame, whole: list[str]) -> DataFrame:
    """``word, n`` over the texts; tasks count what they read (a bounded number of words at a time) first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces: Counter[str] = Counter()
            last = len(batch) - 1
            for k, text in enumerate(batch["text"]):
                pieces.update(plain(text, whole))
                if len(pieces) > HELD_WORDS or k == last:
                    words: Counter[str] = Counter()
                    for piece, n in pieces.items():
                        if closing_mark(piece) and not any(mark in piece for mark in whole):
                            words[piece[:-1]] += n
                            words[piece[-1]] += n
                        else:
                            words[piece] += n
                    pieces.clear()
                    if words:
                        yield pd.DataFrame({"word": list(words), "n": list(words.values())})

    rows = texts_of(docs).mapInPandas(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_from(counted: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` words have it or more."""
    held, least = 0, 1 << 62
    sizes = counted.where(F.char_length("word") <= LONGEST_FREQUENT).groupBy("n").agg(F.count("*").alias("words"))
    for row in sizes.orderBy(F.desc("n")).toLocalIterator():
        held += row["words"]
        if held > most:
            break
        least = row["n"]
    return least


def _id_bytes(ids: list[int], narrow: bool) -> bytes:
    return np.asarray(ids, "<u2" if narrow else "<u4").tobytes()


def encode_words(tokenizer, distinct: list[str], narrow: bool) -> list[bytes]:
    """Ids of every word as bytes, two or four for each id."""
    found = tokenizer.encode_batch_fast(distinct, add_special_tokens=False)
    return [_id_bytes(e.ids, narrow) for e in found]


def frequent_table(docs: DataFrame, whole: list[str], tokenizer_text: str, most: int, narrow: bool) -> tuple:
    """Words and their ids, the most frequent of a bounded sample first; at most ``most`` of them."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(total, 1))
    picked = docs.where(F.pmod(F.xxhash64(F.lit("word sample"), F.col("doc_id")), F.lit(1 << 30)) < share * (1 << 30))
    counted = written(distinct_words(picked, whole), "words")
    often = (F.col("n") >= frequent_from(counted, most)) & (F.char_length("word") <= LONGEST_FREQUENT)
    order = [r["word"] for r in counted.where(often).orderBy(F.desc("n"), "word").toLocalIterator()]
    return order, encode_words(words.load(tokenizer_text), order, narrow)


def rare_ids(gaps: DataFrame, tokenizer, narrow: bool) -> DataFrame:
    """``doc_id, print, at, ids`` for rows ``doc_id, print, at, word``: equal words meet and are encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = words.load(tokenizer.value)
        known: dict[str, bytes] = {}
        for batch in batches:
            distinct = [w for w in batch["word"].unique() if w not in known]
            last = batch["word"].iloc[-1] if len(batch) else None
            known.update(zip(distinct, encode_words(made, distinct, narrow)))
            batch["ids"] = [known[w] for w in batch["word"]]
            known = {last: known[last]} if last is not None else {}  # sorted: only the last word can go on
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch[["doc_id", "print", "at", "ids"]]

    # Longer words never enter the broadcast table, however often they occur: their occurrences are dealt over
    # some tasks, each of which encodes the word once.
    long = F.char_length("word") > LONGEST_FREQUENT
    salt = F.when(long, F.pmod(F.xxhash64("doc_id", "print", "at"), F.lit(LONG_WORD_TASKS))).otherwise(F.lit(0))
    met = gaps.withColumn("salt", salt).repartition(F.col("word"), F.col("salt")).sortWithinPartitions("word")
    return met.mapInPandas(encode, "doc_id long, print long, at int, ids binary")


def _packed(numbers: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_NUMBERS: dict[str, dict[str, int]] = {}


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, print, text`` such that the first two name a text; ids are not null.

    Where every id occurs once, ``print`` is 0, which costs nothing on the way; else it tells texts under
    one id apart by 63 bits of a hash, and its lowest bit marks a null id.
    """
    texts = texts_of(docs)
    counts = texts.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if counts.isEmpty():
        return texts.select("doc_id", F.lit(0).cast("long").alias("print"), "text")
    mark = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return texts.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), mark.alias("print"), "text")


def _split(texts: DataFrame, table, whole: list[str]) -> DataFrame:
    """``doc_id, print, numbers, rare``: a text as numbers of frequent words, and the words between them."""
    name = uuid.uuid4().hex

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _NUMBERS:  # one table at a time in a worker
            _NUMBERS.clear()
            _NUMBERS[name] = {w: k for k, w in enumerate(table.value[0])}
        get = _NUMBERS[name].get
        for batch in batches:
            numbers, rare = [], []
            for text in batch["text"]:
                pieces = plain(text, whole)
                at = list(map(get, pieces))
                gaps: list[str] = []
                if None in at:
                    known, at = at, []
                    alone = len(pieces) == 1 and any(mark in text for mark in whole)
                    for piece, number in zip(pieces, known):
                        if number is None and not alone and closing_mark(piece):
                            parts = (piece[:-1], piece[-1])
                        elif number is None:
                            parts = (piece,)
                        else:
                            at.append(number)
                            continue
                        for part in parts:
                            number = get(part)
                            if number is None:
                                gaps.append(part)
                                number = GAP
                            at.append(number)
                numbers.append(_packed(np.array(at, dtype="<u4")))
                rare.append(gaps)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "print": batch["print"], "numbers": numbers, "rare": rare}
            )

    return texts.mapInPandas(split, "doc_id long, print long, numbers binary, rare array<string>")


def encode_documents(
    docs: DataFrame, tokenizer_path: str, frequent_words: int = FREQUENT_WORDS, decode: bool = False
) -> DataFrame:
    """``doc_id, ids`` of every whole text, ids as bytes (unsigned 32 bit, little endian).

    With ``decode`` also ``decoded``, the text of those ids as :func:`decode_ids` gives it, from the same
    pass. The tokenizer must drop white space between words and have no decoder (else ``ValueError``).
    Texts that hold a special string of the tokenizer are one word. A null or blank text has no
    ids. Rows map one to one, repeated rows and null ids too; no documents give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    if not words.splits_at_white_space(text) or json.loads(text).get("decoder"):
        raise ValueError("The word table needs a tokenizer that drops white space and joins pieces by spaces")
    tokenizer = spark.sparkContext.broadcast(text)
    whole = [*words.SEPARATORS, *words.special_strings(text)]

    narrow = len(piece_table(text)) <= 1 << 16
    table = spark.sparkContext.broadcast(frequent_table(docs, whole, text, frequent_words, narrow))

    # A row is named by its id and its text: equal rows then get equal gaps filled, whichever is which.
    split = _split(_named(docs), table, whole)
    gaps = split.where(F.size("rare") > 0).select("doc_id", "print", F.posexplode("rare").alias("at", "word"))
    filled = rare_ids(gaps, tokenizer, narrow)
    per_text = filled.groupBy("doc_id", "print").agg(F.collect_list(F.struct("at", "ids")).alias("gaps"))
    joined = split.select("doc_id", "print", "numbers").join(per_text, ["doc_id", "print"], "left")
    own = F.when(F.col("print").bitwiseAND(F.lit(1)) == 0, F.col("doc_id")).alias("doc_id")
    pieces = spark.sparkContext.broadcast(piece_table(text) if decode else [])

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_number = table.value[1]
        for batch in batches:
            out = []
            for numbers, gaps in zip(batch["numbers"], batch["gaps"]):
                at = _unpacked(numbers)
                if gaps is None:
                    out.append(b"".join(map(by_number.__getitem__, at.tolist())))
                    continue
                by_place = {g["at"]: g["ids"] for g in gaps}
                rare = iter([by_place[k] for k in range(len(by_place))])
                out.append(b"".join([next(rare) if k == GAP else by_number[k] for k in at.tolist()]))
            if narrow:
                out = [np.frombuffer(ids, "<u2").astype("<u4").tobytes() for ids in out]
            made = {"doc_id": batch["doc_id"].astype("Int64"), "ids": out}
            if decode:
                made["decoded"] = [_decoded(ids, pieces.value) for ids in out]
            yield pd.DataFrame(made)

    kept = joined.select(own, "numbers", "gaps")
    return kept.mapInPandas(assemble, "doc_id long, ids binary" + ", decoded string" * decode)


def piece_table(tokenizer_text: str) -> list[str]:
    """The piece of every id; its size is that of the vocabulary."""
    made = words.load(tokenizer_text)
    return [made.id_to_token(k) for k in range(max(made.get_vocab(with_added_tokens=True).values()) + 1)]


def _decoded(ids: bytes, pieces: list[str]) -> str:
    return " ".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_ids(encoded_docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: every id is looked up in the id-to-piece table, pieces are joined by spaces.

    The table has the vocabulary's size and is broadcast, so the lookup is a map-side join.
    """
    ship_package(encoded_docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    if json.loads(text).get("decoder"):
        raise ValueError("Pieces are joined by spaces only where the tokenizer has no decoder")
    pieces = encoded_docs.sparkSession.sparkContext.broadcast(piece_table(text))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decoded = [_decoded(ids, pieces.value) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": batch["ids"], "decoded": decoded})

    return encoded_docs.select("doc_id", "ids").mapInPandas(decode, "doc_id long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

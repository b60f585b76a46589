"""Token counts, packing and the word table against the tokenizers library."""

import hashlib
import os
import zlib

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ringmatch.llm import packing, token_counts, word_table, words
from tests.llm.helpers import AWKWARD, documents, prose, rows_of

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ROWS = AWKWARD + [(1, prose(1, 300)), (2, prose(2, 5_000)), (3, "Hello, World. It's fine! x" * 50), (4, "a" * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS)


def test_counts_equal_the_library(docs):
    library = Tokenizer.from_file(WORD)
    want = []
    for doc_id, text in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 2048))
    got = rows_of(token_counts.count_tokens(docs, WORD), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(want, key=repr)


def test_counts_of_other_tokenizers(docs):
    for path in (BYTE, public_tokenizers.path("piece_bpe_32k.model")):
        if path == BYTE:
            library = Tokenizer.from_file(path)
            count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        else:
            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda t: len(pieces.encode(t, num_threads=1))
        want = sorted(((d, count(t or "")) for d, t in ROWS), key=repr)
        assert rows_of(token_counts.count_tokens(docs, path), "doc_id", "n_tokens") == want


def test_word_cache_keeps_two_generations():
    made = []
    cache = words.Words(lambda w: made.append(w) or len(w), room=2)
    for w in ("a", "bb", "ccc", "a", "bb", "dddd"):
        assert cache[w] == len(w)
    assert len(cache) <= 2 and len(cache.old) <= 2
    assert made.count("a") == 1  # moved over from the older generation


def test_pieces_and_places(spark, docs):
    library = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        start, piece = 0, 0
        while start < len(ids):
            stop = start + ((len(ids) - start) % 2048 or 2048)
            part = np.array(ids[start:stop], "<u4").tobytes()
            want.append((doc_id, piece, start, stop - start, zlib.crc32(part)))
            start, piece = stop, piece + 1
    packed = packing.pack_documents(docs, BYTE)
    assert rows_of(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    sequences = {}
    for row in packed.collect():
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(documents(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("most", [1, 3, 50])
def test_best_fit_equals_a_search_over_open_bins(most):
    draw = np.random.default_rng(most)
    bins, open_bins, made = packing.OpenBins(100, most), [], 0
    for length in draw.integers(1, 101, 2_000).tolist():
        fitting = [b for b in open_bins if 100 - b[1] >= length]
        if fitting:
            fullest = max(b[1] for b in fitting)
            number, offset = bins.place(length)
            chosen = next(b for b in fitting if b[0] == number)
            assert chosen[1] == fullest == offset
        else:
            number, offset = bins.place(length)
            assert (number, offset) == (made, 0)
            made += 1
            if length < 100 and len(open_bins) == most:
                full = max(b[1] for b in open_bins)
                closed = [b for b in open_bins if b[1] == full]
                open_bins.remove(closed[-1])
            chosen = [number, 0]
            open_bins.append(chosen)
        chosen[1] += length
        if chosen[1] == 100:
            open_bins.remove(chosen)
        # Among equally full bins any may be taken: follow the packer's state.
        open_bins = [[n, 100 - free] for free, held in enumerate(bins.by_free) for n in held]
        assert len(open_bins) == bins.open <= most


def test_packing_is_tight(spark):
    rows = [(k, prose(k, 40 + 13 * (k % 71))) for k in range(600)]
    packed = packing.pack_documents(documents(spark, rows), BYTE).cache()
    total = sum(r["length"] for r in packed.collect())
    assert packed.select("sequence_id").distinct().count() <= 1.04 * total / 2048 + 2


@pytest.mark.parametrize("frequent", [0, 3, 10_000])
def test_encode_and_decode_equal_the_library(docs, frequent):
    library = Tokenizer.from_file(WORD)
    want = []
    for doc_id, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    encoded = word_table.encode_documents(docs, WORD, frequent)
    together = word_table.encode_documents(docs, WORD, frequent, decode=True)
    for got in (word_table.digests(word_table.decode_ids(encoded, WORD)), word_table.digests(together)):
        assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_word_table_refuses_other_tokenizers(docs):
    with pytest.raises(ValueError):
        word_table.encode_documents(docs, BYTE)


def test_no_documents(spark):
    none = documents(spark, [])
    assert token_counts.count_tokens(none, WORD).count() == 0
    assert word_table.encode_documents(none, WORD).count() == 0


def test_any_white_space_between_words():
    """Doubled, leading, trailing and mixed white space, against the library; none of it may end a job."""
    import random

    draw = random.Random(11)
    white = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = ["a  b\tc", "para one.  Two\tcol", "x\xa0y  z", " lead", "trail ", "\n\n", "\t", " \n ", "a \nb", "a\n b."]
    for _ in range(2_000):
        parts = [draw.choice(("don't", "word.", "x", "12", "é,", "Z!")) for _ in range(draw.randint(0, 6))]
        gaps = ["".join(draw.choice((" ", " ", "\n", draw.choice(white))) for _ in range(draw.randint(0, 3))) for _ in range(len(parts) + 1)]
        texts.append("".join(g + p for g, p in zip(gaps, parts + [""])))
    library = Tokenizer.from_file(BYTE)
    encode = packing._ids_of_text(open(BYTE, encoding="utf-8").read())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == want


def test_many_null_ids_and_a_hot_long_word(spark):
    """Texts without ids are told apart; a word of 90 letters in every text is dealt over tasks and still right."""
    library = Tokenizer.from_file(WORD)
    hot = "licence" * 13
    rows = [(None, f"{prose(k, 6)} {hot} {'q' * 70}{k}") for k in range(300)] + [(k % 40, f"{hot} {prose(1_000 + k, 5)}") for k in range(200)]
    want = []
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = word_table.digests(word_table.encode_documents(documents(spark, rows), WORD, frequent_words=5, decode=True))
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256") == sorted(want, key=repr)


def test_a_task_leaves_no_words_in_its_worker(spark, docs):
    """Workers wait for tasks of other queries: the caches that packing filled are empty by then."""
    assert packing.token_pieces(docs, BYTE).count() > len(ROWS)

    def held(batches):
        from ringmatch.llm import packing as loaded

        for batch in batches:
            batch["id"] = sum(len(c) + len(c.old) for pair in loaded._ENCODERS.values() for c in pair)
            yield batch

    assert {r["id"] for r in spark.range(64).repartition(16).mapInPandas(held, "id long").collect()} == {0}

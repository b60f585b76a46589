"""Cross-parsing against a search in the sample, held-out accuracy, awkward rows."""

import numpy as np
import pandas as pd

from ringmatch.llm import language
from tests.llm.helpers import AWKWARD, documents, prose


def phrases_by_search(sample, text):
    """Longest-match phrases; a phrase that cannot go on starts anew with the symbol that stopped it."""
    count, at = 1, b""
    for c in text:
        if at + bytes([c]) in sample:
            at += bytes([c])
            continue
        count += 1
        at = bytes([c]) if bytes([c]) in sample else b""
    return count


def test_phrases_equal_a_search_in_the_sample():
    draw = np.random.default_rng(3)
    sample = draw.integers(0, 4, 400).astype(np.uint8)
    parser = language.Parser(sample, 6)
    texts = [draw.integers(0, 6, n).astype(np.uint8) for n in (50, 33, 33, 7, 1)]
    grid = np.zeros((50, len(texts)), dtype=np.int32)
    for k, t in enumerate(texts):
        grid[: len(t), k] = t
    want = [phrases_by_search(sample.tobytes(), t.tobytes()) for t in texts]
    assert parser.phrases(grid, np.array([len(t) for t in texts])).tolist() == want
    parser.write_out()
    assert parser.phrases(grid, np.array([len(t) for t in texts])).tolist() == want


def labelled(extra=()):
    """Two languages of invented words, and more labelled rows."""
    rows = [(k, prose(k % 2, 150 + k), ("aa", "bb")[k % 2]) for k in range(80)]
    return rows + list(extra)


def test_tiny_and_letterless_samples_take_nothing(spark):
    plain = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(spark, labelled())).collect()}
    assert all(plain[k] == ("aa", "bb")[k % 2] for k in range(80))
    for tiny in ("hi there", "zz", "12345", "e"):
        many = [(1_000 + k, tiny, "tiny") for k in range(3)]
        found = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(spark, labelled(many))).collect()}
        assert all(found[k] == plain[k] for k in range(80)), tiny
    junk = [(1_000 + k, "".join(chr(97 + (k * i * i + i) % 26) for i in range(400)), "junk") for k in range(20)]
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(spark, labelled(junk))).collect()}
    assert all(found[k] == plain[k] for k in range(80))


def test_any_number_of_letters_is_learned(spark):
    """300 letters of one script and 300 of another, more than any byte holds."""
    draw = np.random.default_rng(5)
    scripts = {"han": 0x4E00, "hangul": 0xAC00}
    words = {n: [[chr(at + i) for i in draw.integers(0, 300, 3)] for _ in range(200)] for n, at in scripts.items()}
    text = lambda n: " ".join("".join(words[n][i]) for i in draw.integers(0, 200, 60))
    rows = [(k, text(n), n) for k, n in enumerate(list(scripts) * 20)]
    found = {r["doc_id"]: r for r in language.identify(documents(spark, labelled([(r[0] + 500, *r[1:]) for r in rows]))).collect()}
    assert all(found[k + 500]["lang_pred"] == n for k, _, n in rows)


def test_foreign_text_is_not_known(spark, sf_dir):
    """Unlearned scripts, an unlearned language in learned letters and gibberish; texts of the table stay known."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    draw = np.random.default_rng(4)
    gibberish = " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(2, 9))) for _ in range(80))
    foreign = {
        "hindi": "यह एक साधारण वाक्य है जो किसी और भाषा में लिखा गया है और इसे यहाँ कोई नहीं जानता। " * 5,
        "tamil": "இது வேறு மொழியில் எழுதப்பட்ட ஒரு சாதாரண வாக்கியம், இதை இங்கே யாரும் அறியவில்லை. " * 5,
        "tagalog": "Ang wikang ito ay hindi kilala rito kaya dapat itong tanggihan ng unang yugto, gaya ng lahat ng bagay na hindi natin mabasa. " * 3,
        "russian": "Это обычное предложение на другом языке, которого здесь никто не знает. " * 5,
        "gibberish": gibberish,
    }
    more = spark.createDataFrame([(10_000_000 + k, t, None, "x", 1) for k, t in enumerate(foreign.values())], docs.schema)
    found = language.identify(docs.unionByName(more)).collect()
    known = {r["doc_id"]: r["known"] for r in found}
    assert [n for k, n in enumerate(foreign) if known[10_000_000 + k]] == []
    own = [r["known"] for r in found if r["doc_id"] < 10_000_000 and r["lang_pred"] != "und"]
    assert np.mean(own) > 0.97


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = found.collect()
    assert rows and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    hidden = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) lang")
    key = lambda df: sorted(map(tuple, language.identify(df).collect()))
    assert key(docs) == key(hidden)


def test_awkward_rows(spark):
    rows = [(k, prose(k, 200), "aa") for k in range(8)] + [(k, prose(k, 200).upper()[::-1] + " www", "bb") for k in range(8, 16)]
    rows += [(d, t, None) for d, t in AWKWARD] + [(70, "1234 !?", "aa"), (71, "ж" * 50, "aa"), (72, prose(1, 60_000), None)]
    found = language.identify(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (90, 91, 92, 70))
    assert by_id[72]["lang_pred"] == "aa"
    assert by_id[None]["held_out"] is False


def test_nothing_to_learn_from(spark):
    found = language.identify(documents(spark, [(1, "some text", None), (2, None, "aa")])).collect()
    assert {r["lang_pred"] for r in found} == {"und"}
    assert language.identify(documents(spark, [])).count() == 0


def test_a_waiting_worker_holds_no_plain_tables(spark):
    model = language.fit(documents(spark, labelled()))
    classify = language.classifier(spark, model)
    texts = [prose(0, 7), prose(1, 8), None, "12"]
    found = [tuple(r) for frame in classify.func(iter([pd.Series(texts)])) for r in frame.itertuples(index=False)]
    assert [r[0] for r in found] == ["aa", "bb", "und", "und"]
    assert all(p.steps is None for p in model.parsers)
    again = [tuple(r) for frame in classify.func(iter([pd.Series(texts)])) for r in frame.itertuples(index=False)]
    assert again == found

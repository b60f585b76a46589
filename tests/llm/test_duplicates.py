"""SimHash, passages, components and the pipeline's stages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from ringmatch.llm import components, passages, queries, simhash, stages
from tests.llm.helpers import AWKWARD, components_of, documents, prose, rows_of


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edited(text, seed, changes):
    words, draw = text.split(), random.Random(seed)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


BASE = prose(5, 400)
ROWS = (
    AWKWARD
    + [(k, edited(BASE, k, k % 5)) for k in range(40)]
    + [(50, BASE), (51, BASE), (52, prose(9, 3)), (53, prose(8, 70_000, 50))]
)


def test_near_duplicates_equal_brute_force(spark):
    got = simhash.near_duplicates(documents(spark, ROWS))
    prints = [(d, fingerprint(t)) for d, t in ROWS]
    roots = components_of([p for _, p in prints], lambda a, b: (a ^ b).bit_count() <= 3)
    smallest = {}
    for d, p in prints:
        if d is not None:
            smallest[roots[p]] = min(d, smallest.get(roots[p], d))
    want = sorted(((d, f"{p:016x}", smallest.get(roots[p])) for d, p in prints), key=repr)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("group", [2, 4_096])
@pytest.mark.parametrize("most", [0, 2, 3])
def test_links_span_brute_force_components(spark, most, group):
    draw = random.Random(group + most)
    prints = set()
    for _ in range(60):
        at = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 12)):
            prints.add(at)
            for _ in range(draw.randrange(0, 5)):
                at ^= 1 << draw.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(5)
    found = components.components(simhash.near_links(table, most, group))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = components_of(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= most)
    assert {p: got.get(p, p) for p in signed} == want


def test_components_of_paths_stars_and_noise(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (None, 4), (1, 2), (2, 1)]
    edges += [(150, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in found}
    assert len(found) == len(got)
    assert got == {k: 7 for k in [7, *range(100, 161), *range(200, 260)]} | {1: 1, 2: 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PASSAGE = prose(77, 60)


def host(seed, passage):
    words = prose(seed, 120, 900).split()
    return " ".join(words[:50]) + " " + passage + " " + " ".join(words[50:])


def test_passages_inside_other_text_are_found_and_cut(spark):
    rows = [(k, host(k, PASSAGE)) for k in range(1, 6)] + [(k, prose(k, 300, 900)) for k in range(20, 30)]
    rows += [(40, prose(40, 200) + "\n" + prose(41, 80)), (41, prose(42, 200) + "\n" + edited(prose(41, 80), 1, 1))]
    docs = documents(spark, rows + AWKWARD)
    found = passages.clustered(passages.repeated_passages(docs)).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 5, 40, 41}
    assert {(r["doc_id"], r["kept"]) for r in found} == {(k, k in (1, 40)) for k in (1, 2, 3, 4, 5, 40, 41)}
    assert {r["component_id"] for r in found if r["doc_id"] < 6} == {1}
    texts = dict(rows)
    for r in found:
        span = texts[r["doc_id"]][r["start"] : r["stop"]]
        assert len(span.split()) >= passages.WINDOW_WORDS
        assert r["doc_id"] > 5 or span in PASSAGE
    cut = {r["doc_id"]: r["text"] for r in stages.cut_repeats(spark, docs, "").collect()}
    assert cut[1] == texts[1] and cut[40] == texts[40] and cut[90] is None and cut[22] == texts[22]
    for k in range(2, 6):
        mine, passage = cut[k].split(), PASSAGE.split()
        longest = max(n for n in range(61) if any(passage[a : a + n] == mine[b : b + n] for a in range(61 - n) for b in range(len(mine)))) if mine else 0
        assert longest < passages.SPREAD
    assert cut[41].split() == prose(42, 200).split()


def test_overlapping_passages_of_several_keepers_keep_all_links(spark):
    line, body = prose(60, 140), prose(61, 300, 900)
    words = line.split()
    near = " ".join(words[:70] + ["other"] + words[71:])
    rows = [(1, near), (3, body + "\n" + " ".join(words[40:100]) + " " + body[:300]), (5, line)]
    # Two keepers' passages overlap in 9: 7 has the first half, 8 the second.
    late = prose(62, 140).split()
    rows += [(7, " ".join(late[:80]) + " " + prose(63, 40)), (8, prose(64, 40) + " " + " ".join(late[60:])), (9, " ".join(late))]
    docs = documents(spark, rows)
    found = passages.clustered(passages.repeated_passages(docs)).collect()
    assert {(r["doc_id"], r["keeper_id"]) for r in found if not r["kept"]} == {(5, 1), (5, 3), (9, 7), (9, 8)}
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 7}
    spans = {r["keeper_id"]: (r["start"], r["stop"]) for r in found if r["doc_id"] == 9}
    assert spans[7][1] <= len(" ".join(late[:80])) and spans[8][0] >= len(" ".join(late[:60]))
    for r in passages.removals(passages.repeated_passages(docs)).collect():
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    cut = {r["doc_id"]: r["text"] for r in stages.cut_repeats(spark, docs, "").collect()}
    assert 5 not in cut and len(cut.get(9, "").split()) < 2 * passages.SPREAD and cut[3] == rows[1][1]


def test_short_lines_are_compared_and_count_together(spark):
    """Six 30-word lines near-copied in 2, one of them alone in 3, 4 is nothing but that line; 5 shares nothing."""
    lines = [prose(700 + k, 30) for k in range(6)]
    near = [" ".join(w if i != 11 else "other" for i, w in enumerate(line.split())) for line in lines]
    rows = [(1, "\n".join(lines)), (2, prose(710, 60) + "\n" + "\n".join(near)), (3, prose(711, 60) + "\n" + lines[2])]
    rows += [(4, lines[2]), (5, prose(712, 40) + "\n" + prose(713, 12))]
    docs = documents(spark, rows)
    found = sorted(map(tuple, passages.clustered(passages.repeated_passages(docs)).select("doc_id", "keeper_id", "kept", "component_id").collect()))
    similar = [passages.shingle_set(a) for a in (lines[2], near[2])]
    assert len(np.intersect1d(*similar)) < 0.8 * len(np.union1d(*similar))  # a word in 30 changed: the line alone is below 0.8
    assert found == [(4, 1, False, 1)]  # in 1 the line is 30 repeated words among others: it keeps them without a row
    # With a word changed at an end, each line is near enough; 3 still has 30 repeated words only.
    near = ["other " + line.split(" ", 1)[1] for line in lines]
    rows[1] = (2, prose(710, 60) + "\n" + "\n".join(near))
    docs = documents(spark, rows)
    found = sorted(map(tuple, passages.clustered(passages.repeated_passages(docs)).select("doc_id", "keeper_id", "kept", "component_id").collect()))
    assert found == [(1, 1, True, 1), (2, 1, False, 1), (4, 1, False, 1)]
    cut = {r["doc_id"]: r["text"] for r in stages.cut_repeats(spark, docs, "").collect()}
    assert cut[2] == rows[1][1].split("\n")[0] + "\n" and cut[3] == rows[2][1] and 4 not in cut


def brute_force_passages(rows):
    """All pairs of lines and blocks by Jaccard, all common windows, then the rule of the joined length."""
    pieces, window_of, total = [], {}, {}
    for doc_id, text in rows:
        total[doc_id], found = passages._pieces(text)
        pieces += [(doc_id, p, passages.shingle_set(p[4])) for p in found]
        hashes = passages.word_hashes(text)[0]
        for a in passages.window_starts(hashes, passages.WINDOW_WORDS, passages.SPREAD).tolist():
            window_of.setdefault(hashes[a : a + passages.WINDOW_WORDS].tobytes(), []).append((doc_id, a))

    def near(i, j):
        a, b = pieces[i][2], pieces[j][2]
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common >= 0.8 * (len(a) + len(b) - common)

    root = components_of(range(len(pieces)), near)
    spans = {}
    for i, (doc_id, p, _) in enumerate(pieces):
        members = {pieces[j][0] for j in range(len(pieces)) if root[j] == root[i]}
        if len(members) > 1:
            spans.setdefault(doc_id, []).append((p[2], p[2] + p[3], min(members), False))
    for places in window_of.values():
        holders = {d for d, _ in places}
        if len(holders) > 1:
            for d, a in places:
                spans.setdefault(d, []).append((a, a + passages.WINDOW_WORDS, min(holders), True))
    out = set()
    for doc_id, held in spans.items():
        covered = np.zeros(total[doc_id] + 1, dtype=bool)
        for a, b, _, _ in held:
            covered[a:b] = True
        for a, b, keeper, _ in held:
            low, high = a, b
            while low and covered[low - 1]:
                low -= 1
            while covered[high]:
                high += 1
            inside = any(e and low <= x and y <= high for x, y, _, e in held)
            if inside or high - low >= min(passages.PASSAGE_WORDS, total[doc_id]):
                out.add((doc_id, keeper))
    return out


def test_whole_query_equals_brute_force(spark):
    """200 documents of lines of all lengths, with copies, near copies and repeated passages."""
    import random

    draw = random.Random(23)
    stock = [prose(5_000 + k, draw.choice((3, 7, 15, 28, 40, 60, 90))) for k in range(80)]
    rows = []
    for doc_id in range(200):
        lines = []
        for _ in range(draw.randint(1, 9)):
            line = draw.choice(stock) if draw.random() < 0.25 else prose(draw.randrange(10**6), draw.choice((4, 9, 25, 55)))
            words = line.split()
            if draw.random() < 0.3:
                words[draw.choice((0, len(words) - 1, draw.randrange(len(words))))] = "changed"
            lines.append(" ".join(words))
            if draw.random() < 0.1:
                lines.append("")
        rows.append((doc_id, "\n".join(lines)))
    rows += [(200 + k, rows[k][1]) for k in range(3)]
    found = passages.repeated_passages(documents(spark, rows)).collect()
    got = {(r["doc_id"], r["keeper_id"]) for r in found}
    want = brute_force_passages(rows)
    assert len(want) > 60 and len(got ^ want) <= 0.01 * len(want)  # bands miss a pair at 0.8 once in a thousand


def test_hot_digests_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(passages, "HEAVY", 3)
    licence = prose(900, 70)
    rows = [(k, prose(901 + k, 30) + "\n" + licence) for k in range(12)] + [(50, prose(950, 60)), (51, prose(950, 60))]
    found = passages.repeated_passages(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["keeper_id"]) for r in found} == {(k, 0) for k in range(12)} | {(50, 50), (51, 50)}


def test_every_shared_run_of_51_words_has_a_common_window():
    for seed in range(200):
        run = prose(1_000 + seed, passages.WINDOW_WORDS + passages.SPREAD - 1)
        held = []
        for side in range(2):
            text = prose(seed * 7 + side, seed % 40 + 1) + " " + run + " " + prose(seed * 11 + side, 60)
            hashes = passages.word_hashes(text)[0]
            at = passages.window_starts(hashes, passages.WINDOW_WORDS, passages.SPREAD)
            held.append({hashes[a : a + passages.WINDOW_WORDS].tobytes() for a in at})
        assert held[0] & held[1]


def test_word_hashes_follow_words_not_places():
    text = "ab cd ab\n\n😀 x ab"
    hashes, starts, stops = passages.word_hashes(text)
    assert [text[a:b] for a, b in zip(starts, stops)] == text.split()
    assert hashes[0] == hashes[2] == hashes[5] and len(set(hashes.tolist())) == 4
    assert len(passages.word_hashes("")[0]) == len(passages.word_hashes(" \n")[0]) == 0


def test_linked_roots_equal_brute_force_jaccard():
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for k in range(60):
        own = base.copy()
        own[draw.integers(0, 60, k % 9)] = draw.integers(0, 1 << 62, k % 9).astype(np.uint64)
        sets.append(np.unique(own))

    def near(a, b):
        common = len(np.intersect1d(sets[a], sets[b]))
        return common >= 0.8 * (len(sets[a]) + len(sets[b]) - common)

    got = passages.linked_roots(sets, 0.8)
    want = components_of(range(60), near)
    pairs = {(a, b): want[a] == want[b] for a in range(60) for b in range(60)}
    assert pairs == {(a, b): got[a] == got[b] for a in range(60) for b in range(60)}


def test_shingle_sets_of_many_texts_equal_those_of_each():
    texts = [prose(3, 40), "", "one", "a b c d", "a b c d e", prose(4, 200), "x " * 50, prose(3, 40)]
    values, bounds = passages.shingle_sets(texts)
    assert len(bounds) == len(texts) + 1
    for k, text in enumerate(texts):
        assert values[bounds[k] : bounds[k + 1]].tolist() == passages.shingle_set(text).tolist()


def test_windows_of_many_texts_begin_where_those_of_each_do():
    texts = ["", prose(1, 300), "a b c", prose(2, 36), "x " * 90, " ", prose(3, 35), "😀 " + prose(4, 70), prose(1, 300)]
    hashes, starts, stops, bounds, owner = passages.words_of(texts)
    for window, spread in ((36, 16), (10, 16), (5, 3)):
        want = []
        for k, text in enumerate(texts):
            alone, first, last = passages.word_hashes(text)
            mine = slice(bounds[k], bounds[k + 1])
            assert hashes[mine].tolist() == alone.tolist() and set(owner[mine].tolist()) <= {k}
            assert starts[mine].tolist() == first.tolist() and stops[mine].tolist() == last.tolist()
            want += (bounds[k] + passages.window_starts(alone, window, spread)).tolist()
        assert passages.window_starts(hashes, window, spread, bounds=bounds).tolist() == want


def test_verified_groups_hash_a_shared_text_once_and_link_as_brute_force(monkeypatch):
    draw = random.Random(4)
    texts = [edited(prose(k // 6, 60), k, k % 4) for k in range(48)]
    sets = [set(passages.shingle_set(t).tolist()) for t in texts]
    rows, links = [], []
    for key in range(40):
        of = sorted(draw.sample(range(6 * (key % 8), 6 * (key % 8) + 6), 1 + key % 5))
        high = key % 3 and 1
        held = [(line, key, 0, high, line % 2 if high else 0, texts[line]) for line in of]
        rows += held
        links += [
            (x[0], y[0]) for x in held for y in held
            if x[0] < y[0] and (not high or x[4] != y[4])
            and len(sets[x[0]] & sets[y[0]]) >= 0.8 * len(sets[x[0]] | sets[y[0]])
        ]
    columns = list(map(list, zip(*rows)))
    held = pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["line", "key", "low", "high", "block", "text"])
    hashed = []
    whole = passages.shingle_sets
    monkeypatch.setattr(passages, "shingle_sets", lambda t: hashed.extend(t) or whole(t))

    def roots(found):
        got = components_of(range(48), lambda x, y: (x, y) in found or (y, x) in found)
        return [got[k] for k in range(48)]

    for together, size in ((10**9, 1_000), (1, 7), (3_000, 3)):
        hashed.clear()
        parts = [held.slice(k, size) for k in range(0, held.num_rows, size)]
        out = [r for batch in passages._verify(0.8, together)(iter(parts)) for r in batch.to_pylist()]
        assert roots({(r["a"], r["b"]) for r in out}) == roots(set(links))
        if together == 10**9:
            met = {r[0] for r in rows if sum(r[1] == q[1] for q in rows) > 1}
            assert sorted(hashed) == sorted(texts[k] for k in met)


def test_similar_paragraphs_reach_high_recall(spark):
    rows, pairs = [], []
    for k in range(150):
        text = prose(k, 90)
        rows += [(2 * k, text), (2 * k + 1, edited(text, k, 1 + k % 2))]
    table = spark.createDataFrame(rows, "line long, text string")
    roots = {r["node"]: r["root"] for r in components.components(passages.similar_paragraphs(table)).collect()}
    for k in range(150):
        a, b = (passages.shingle_set(rows[2 * k + s][1]) for s in range(2))
        common = len(np.intersect1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            pairs.append(roots.get(2 * k) == 2 * k == roots.get(2 * k + 1))
    assert len(pairs) > 60 and np.mean(pairs) > 0.97


def test_no_documents(spark):
    none = documents(spark, [])
    assert passages.clustered(passages.repeated_passages(none)).count() == 0
    assert stages.cut_repeats(spark, none, "").count() == 0


def test_each_stage_keeps_the_columns_and_clean_rows(spark):
    rows = [(k, prose(k, 120), "aa") for k in range(12)] + [(20, prose(3, 120), None), (21, "password=hunter22", "aa")]
    docs = documents(spark, rows + [(*r, None) for r in AWKWARD])
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(kept[k] == rows[k][1] for k in range(12)), name
    assert "[assign]" in {r["text"] for r in stages.remove_secrets(spark, docs, "").collect()}
    assert 20 not in {r["doc_id"] for r in stages.drop_near_copies(spark, docs, "").collect()}
    assert None in {r["doc_id"] for r in stages.drop_near_copies(spark, docs, "").collect()}
    assert not {90, 91, 92} & {r["doc_id"] for r in stages.keep_languages(spark, docs, "").collect()}


def test_pipeline_runs_end_to_end(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0.7 * docs.count() < packed.select("doc_id").distinct().count() <= docs.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_every_query_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}

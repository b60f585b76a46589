"""Near-equal vectors and nearest neighbours against brute force."""

import os

import numpy as np
import pytest

from ringmatch.llm import caps, neighbours
from tests.llm.helpers import components_of

SCHEMA = "vec_id long, embedding array<float>, label int, start long, key string, class_id string, links string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "k", "c", "l") for i, v in rows], SCHEMA)


def cloud(seed, n, dimension, cluster):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dimension))
    for k in range(0, cluster):
        x[k] = x[0] + 0.3 * draw.standard_normal(dimension)
    return x.astype(np.float32)


X = cloud(1, 700, 24, 120)
ODD = [
    (900, None),
    (901, []),
    (902, [0.0] * 24),
    (903, [float("nan")] + [1.0] * 23),
    (904, [float("inf")] + [1.0] * 23),
    (905, [None] + [1.0] * 23),
    (906, [1.0, 2.0]),
    (None, [1.0] * 24),
    (907, X[3].tolist()),
    (908, (2 * X[3]).tolist()),
    (700, X[3].tolist()),
]
ROWS = [(k, x.tolist()) for k, x in enumerate(X)] + ODD
GOOD = [(i, np.array(v, dtype=np.float64)) for i, v in ROWS if i is not None and i not in range(900, 907)]


@pytest.mark.parametrize("block", [1_024, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    ids = [i for i, _ in GOOD]
    m = np.stack([v for _, v in GOOD])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    at = {i: k for k, i in enumerate(ids)}
    roots = components_of(ids, lambda a, b: near[at[a], at[b]])
    want = [(i, int(near[k].sum()) - 1, roots[i], roots[i] == i) for k, i in enumerate(ids)]
    want += [(i, 0, i, i is not None) for i, _ in ODD if i is None or 900 <= i < 907]
    got = caps.near_vectors(table(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def leaning(seed, count, dimension, mean_cosine):
    """Vectors that lean to one direction, so that two of them have this cosine on average; near pairs among them."""
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((count, dimension))
    x[:, 0] += np.sqrt(dimension * mean_cosine / (1 - mean_cosine))
    x[1 : count // 20 : 2] = x[0 : count // 20 - 1 : 2] + 0.33 * draw.standard_normal((len(x[1 : count // 20 : 2]), dimension))
    return x @ np.linalg.qr(draw.standard_normal((dimension, dimension)))[0]


@pytest.mark.parametrize("mean_cosine", [0.0, 0.3, 0.5])
def test_leaning_vectors_cost_no_more_than_a_share_of_all_pairs(mean_cosine):
    x = leaning(6, 20_000, 64, mean_cosine)
    plan = caps.Plan(x[:: len(x) // caps.SAMPLE][: caps.SAMPLE], 50_000, 0.9)
    offsets, numbers, short = plan.decode(x)
    load = np.bincount(np.unique(numbers, return_inverse=True)[1])
    compared = float((load.astype(float) ** 2).sum()) / len(x) ** 2 + short.mean()
    assert compared < 0.15
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [(k, k + 1) for k in range(0, len(x) // 20 - 1, 2) if unit[k] @ unit[k + 1] >= 0.9]
    missed = [
        not (short[a] or short[b]) and not len(np.intersect1d(numbers[offsets[a] : offsets[a + 1]], numbers[offsets[b] : offsets[b + 1]]))
        for a, b in near
    ]
    assert len(near) > 100 and sum(missed) == 0


def test_a_thousand_million_rows_are_planned():
    plan = caps.Plan(leaning(7, 2_000, 64, 0.0), 1_000_000_000, 0.9)
    assert plan.filters.whole and plan.filters.number is np.int64
    a, b = caps.pairs_at(64, 0.9, 200, 5)
    (s, x), (t, y) = plan.filters.decode(a), plan.filters.decode(b)
    assert all(len(np.intersect1d(x[s[k] : s[k + 1]], y[t[k] : t[k + 1]])) for k in range(200))


@pytest.mark.parametrize("codes", [caps.MOST_CODES, 1])
def test_short_rests_and_failing_filters_are_compared_with_all(spark, monkeypatch, codes):
    """Leaning vectors, some of them hardly off the common direction; and a code too few, so that all are compared."""
    monkeypatch.setattr(caps, "MOST_CODES", codes)
    monkeypatch.setattr(caps, "BLOCK", 128)
    x = leaning(8, 900, 32, 0.6)
    common = x.mean(axis=0)
    x[850:] = common + 0.05 * x[850:]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    m = x.astype(np.float32).astype(np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    roots = components_of(range(900), lambda a, b: near[a, b])
    want = [(k, int(near[k].sum()) - 1, roots[k], roots[k] == k) for k in range(900)]
    assert sorted(map(tuple, caps.near_vectors(table(spark, rows)).collect())) == want


def test_filters_find_pairs_at_the_least_similarity():
    draw = np.random.default_rng(2)
    a = draw.standard_normal((1_500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    filters = caps.Filters(64, 50_000, 0.9)
    (s, x), (t, y) = filters.decode(a), filters.decode(b)
    shared = [len(np.intersect1d(x[s[k] : s[k + 1]], y[t[k] : t[k + 1]])) for k in range(len(a))]
    assert np.mean([n > 0 for n in shared]) >= 0.995


@pytest.mark.parametrize("rows", [100_000, 1_000_000, 10_000_000])
def test_filters_find_pairs_whatever_the_row_count(rows):
    filters = caps.Filters(64, rows, 0.9)
    draw = np.random.default_rng(3)
    for similarity in (0.9, 0.96):
        a = draw.standard_normal((3_000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = draw.standard_normal(a.shape)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = similarity * a + np.sqrt(1 - similarity**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        (s, x), (t, y) = filters.decode(a), filters.decode(b)
        missed = [not len(np.intersect1d(x[s[k] : s[k + 1]], y[t[k] : t[k + 1]])) for k in range(len(a))]
        assert np.mean(missed) <= 0.001
        assert np.diff(s).min() > 0


def test_only_vectors_that_may_have_partners_bring_their_lists_along(spark, monkeypatch, tmp_path):
    """Ten near pairs among unrelated vectors: the groups that are compared exactly hold few bytes of all memberships."""
    draw = np.random.default_rng(12)
    x = draw.standard_normal((1_500, 48))
    x[10:20] = x[:10] + 0.2 * draw.standard_normal((10, 48))
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    plain, folder = caps._link, str(tmp_path)

    def counting(dimension, similarity):
        run = plain(dimension, similarity)

        def counted(batches):
            def each():
                for batch in batches:
                    with open(f"{folder}/{os.getpid()}", "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            yield from run(each())

        return counted

    monkeypatch.setattr(caps, "_link", counting)
    got = {r.vec_id: r.n_links for r in caps.near_vectors(table(spark, rows)).collect()}
    assert got == {k: int(k < 20) for k in range(1_500)}
    compared = sum(int(n) for f in tmp_path.iterdir() for n in f.read_text().split())
    assert 0 < compared < 0.1 * 1_500 * 48 * 4 * 20


def test_sketches_bound_the_cosine_and_groups_may_have_any_size():
    draw = np.random.default_rng(13)
    x = draw.standard_normal((900, 24))
    x[600:700] = x[599] + 0.3 * draw.standard_normal((100, 24))
    unit, sketch = caps._unit(x), caps.sketches(x)
    head = np.ascontiguousarray(sketch[:, :8]).view(np.float32).astype(np.float64)
    held = sketch[:, 8:].view(np.int8) * head[:, :1]
    assert (unit @ unit.T <= held @ held.T + head[:, 1:] + head[:, 1] + 1e-6).all()
    starts = np.array([0, 1, 3, 8, 40, 300, 300 + caps.SMALL_GROUP + 2, 890])
    side = np.zeros(900, dtype=np.int8)
    side[300:890] = draw.integers(1, 3, 590)
    group = np.searchsorted(starts, np.arange(900), side="right")
    near = (unit @ unit.T >= 0.9) & (group[:, None] == group) & ((side[:, None] != side) | (side == 0))
    np.fill_diagonal(near, False)
    found = caps.may_link(sketch, side, starts, 0.9)
    assert found[near.any(axis=1)].all() and near.any() and found.mean() < 0.2


def test_no_vectors(spark):
    assert caps.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in caps.near_vectors(table(spark, [(5, None)])).collect()] == [(5, 0, 5, True)]
    assert neighbours.nearest(table(spark, []), neighbours.F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("recall_asked", [0.3, 0.97])
def test_neighbours_against_brute_force(spark, recall_asked):
    is_query = neighbours.F.col("vec_id") % 20 == 0
    got = {}
    for r in neighbours.nearest(table(spark, ROWS), is_query, top=20, recall=recall_asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([i for i, _ in GOOD])
    m = np.stack([v for _, v in GOOD])
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    recall = []
    for query, found in got.items():
        score = (m[ids == query][0] * m).sum(axis=1)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != query][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        recall.append(len({f[1] for f in found} & set(ids[order].tolist())) / 20)
        assert all(abs(f[2] - score[ids == f[1]][0]) < 1e-9 for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) 
    assert np.mean(recall) >= (0.9 if recall_asked == 0.97 else 0.2)


@pytest.mark.parametrize("stretched", [1.0, 20.0])
def test_neighbours_of_many_rows_and_of_one_long_vector(spark, monkeypatch, stretched):
    monkeypatch.setattr(neighbours, "POINTS", 512)
    x = np.random.default_rng(4).standard_normal((12_000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= stretched
    spread = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    is_query = neighbours.F.col("vec_id") % 100 == 0
    for r in neighbours.nearest(spread, is_query, top=20, cell_rows=2).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x[::100].astype(np.float64) @ x.T.astype(np.float64)
    score[np.arange(120), np.arange(0, 12_000, 100)] = -np.inf
    true = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[100 * k] & set(t.tolist())) / 20 for k, t in enumerate(true)]) >= 0.9


def test_recall_on_the_table_comes_through_the_hashes(spark, sf_dir, monkeypatch):
    """Whole embeddings against brute force; every band hashes, and the recall column says what was measured."""
    taken = []
    calibrated = neighbours.calibrated
    monkeypatch.setattr(neighbours, "calibrated", lambda *a: taken.append(calibrated(*a)) or taken[-1])
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got, measured = {}, set()
    for r in neighbours.nearest(rows, neighbours.F.col("vec_id") % 20 == 0, top=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        measured.add(r["sample_recall"])
    assert taken and all(h.projections > 0 and h.tables * h.probes >= 1 for h in taken)
    held = rows.collect()
    ids, x = np.array([r["vec_id"] for r in held]), np.array([r["embedding"] for r in held], dtype=np.float64)
    hits = []
    for query, found in got.items():
        score = (x[ids == query][0] * x).sum(axis=1)
        true = [ids[k] for k in np.lexsort((ids, -score)) if ids[k] != query][:20]
        hits.append(len(found & set(true)) / 20)
    assert len(got) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.95
    assert len(measured) == 1 and abs(measured.pop() - np.mean(hits)) < 1e-9  # the sample holds all queries here


def test_turns_equal_the_order_of_visits():
    draw = np.random.default_rng(8)
    hashes = neighbours.Hashes(6, 4, 2, 1, 1.5, 1.0)
    q, x = draw.standard_normal((2, 40, 6))
    x = q + 0.4 * x
    x /= 2 * np.abs(x).max()
    for table_number in range(2):
        cells, within = hashes.places(q, table_number, True)
        points = hashes.places(x, table_number, False)[0]
        turns = neighbours.ranks_of(hashes, q, x, table_number)
        for k in range(40):
            visits = neighbours.probe_order(within[k], 81)
            off = {tuple(sorted((p, s) for p, s in v)): n for n, v in enumerate(visits)}
            moved = points[k] - cells[k]
            key = tuple((p, int(s)) for p, s in enumerate(moved) if s)
            assert turns[k] == (off[key] if np.abs(moved).max() <= 1 else 81)


def test_few_rows_give_all_candidates(spark):
    rows = [(k, [1.0, float(k)]) for k in range(5)]
    found = neighbours.nearest(table(spark, rows), neighbours.F.col("vec_id") == 0, top=20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [
        (k + 1, k + 1, 1.0) for k in range(4)
    ]
    assert neighbours.nearest(table(spark, rows[:1]), neighbours.F.col("vec_id") == 0).count() == 0


def test_probes_come_by_rising_cost():
    within = np.array([0.1, 0.45, 0.8])
    visits = neighbours.probe_order(within, 27)

    def cost(moves):
        return sum((within[k] if step < 0 else 1 - within[k]) ** 2 for k, step in moves)

    assert len({tuple(sorted(v)) for v in visits}) == len(visits) == 27 and visits[0] == ()
    costs = [cost(v) for v in visits]
    assert costs == sorted(costs)


def test_the_setting_sends_few_rows_at_every_size():
    """Copies of points and visits of queries, on 3,000 and 15,000 rows of which a twentieth ask."""
    draw = np.random.default_rng(9)
    x = draw.standard_normal((15_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sent = []
    for rows in (3_000, 15_000):
        ids = np.arange(rows)
        q, found, _ = neighbours.best_of(x[:rows:20][:150], ids[::20][:150], x[:rows], ids, 20)
        hashes = neighbours.calibrated(64, rows, 1.0, 0, x[:rows:20][q], x[found], queries=rows // 20)
        turns = [neighbours.ranks_of(hashes, x[:rows:20][q], x[found], t) for t in range(hashes.tables)]
        assert (np.min(turns, axis=0) < hashes.probes).mean() >= neighbours.RECALL
        sent.append(hashes.tables * (rows + rows // 20 * hashes.probes))
        assert sent[-1] <= 4 * rows
    assert sent[1] <= 6 * sent[0]

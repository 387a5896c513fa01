"""Cap filters and learned partitions against brute force."""

import inspect
import math

import numpy as np
import pytest

from ledgerfold.llm import cap_filters as C
from ledgerfold.llm import learned_partitions as L


def vectors(n=900, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:220] = x[100] + rng.normal(size=(120, dim)) * 0.11  # a group around the threshold
    x[300:330] = x[300]
    x[400:420] = x[401] + rng.normal(size=(20, dim)) * 0.08
    label = rng.integers(0, 3, n)
    label[100:220] = 1
    label[300:330] = 2
    label[400:420] = 0
    return [(int(i), [float(v) for v in r], int(g)) for i, (r, g) in enumerate(zip(x, label))]


def odd_vectors():
    return [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None] + [1.0] * 23, 1), (1004, [math.inf] + [1.0] * 23, 1), (1005, [], 1),
            (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [2.0, 4.0], None), (1009, [1.0, 2.0], 1), (1009, [1.0, 2.0], 1), (1010, [-1.0, -2.0], 1), (None, [5.0, 10.0], 1)]


def brute(rows, threshold=0.98):
    ok = [v is not None and g is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, g in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted(((-1 if rows[i][0] is None else rows[i][0]), links[i], least.get(find(i), -1)) for i in range(n))


def test_cap_filters_find_the_links(spark):
    rows = vectors() + odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in C.near_duplicates(df, list_rows=32).collect())
    want = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], g) for i, v, g in rows])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want)), "no link below the threshold"
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.995 * len(want)
    assert C.near_duplicates(df.limit(0)).count() == 0


def test_large_lists_are_split(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    rows = [(i, [float(v) for v in (base + rng.normal(size=24) * 0.05)], 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = C.near_duplicates(df).collect()
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    have = np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])
    assert (have <= want).all() and have.sum() >= 0.995 * want.sum()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_decoding_lists_all_filters_above_the_threshold():
    code = C.ProductCode(20, 12, 8.0)
    rng = np.random.default_rng(1)
    u = rng.normal(size=(50, 20))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    turned = u @ code.rotation
    whole = (turned[:, :10] @ code.books[0].T)[:, :, None] + (turned[:, 10:] @ code.books[1].T)[:, None, :]
    for got, s in zip(code.decode(u), whole.reshape(50, -1)):
        assert got.tolist() == np.flatnonzero(s >= code.threshold).tolist()
    many = np.mean([len(f) for f in C.ProductCode(20, 40, 8.0).decode(rng.normal(size=(2000, 20)) / 4.4)])
    assert 4 < many < 14


@pytest.mark.parametrize("words", [16, 50, 159, 500])
def test_isolated_pairs_share_a_filter_at_every_size(words):
    """Pairs at exactly 0.98 of 64 components, alone in their surroundings."""
    per, rows_a_list, codes, least = (inspect.signature(C.near_duplicates).parameters[k].default for k in ("per_vector", "list_rows", "codes", "least"))
    assert C.book_words(round(words**2 * rows_a_list * codes / per), per, rows_a_list, codes) == words
    rng = np.random.default_rng(words)
    u, w = rng.normal(size=(2, 1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    v = 0.98 * u + math.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    one, two = (C.filter_lists(x, words, per, codes, least) for x in (u, v))
    assert all(len(np.unique(f)) == len(f) >= codes * least for f in one + two)
    assert sum(not np.isin(a, b).any() for a, b in zip(one, two)) <= 1


def exact(rows, is_query, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(is_query(ids)):
        s = x @ x[i]
        other = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [int(v) for v in ids[other[np.lexsort((ids[other], -s[other]))]][:k]]
    return out


@pytest.mark.parametrize("n,options", [(400, {}), (6000, {"part_rows": 512, "sample_rows": 3000, "target_recall": 0.95})])
def test_search_recall(spark, n, options):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, 16)) * 0.6
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in L.nearest(df, "vec_id % 20 = 0", 20, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = exact(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q].values()} & set(w)) for q, w in want.items())
    assert hits / (20 * len(want)) >= (1.0 if not options else 0.9)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        order = [found[r] for r in sorted(found)]
        assert order == sorted(order, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for v, s in order)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.0, 0.0]), (20, None), (40, [math.nan, 1.0]), (60, [1.0, None]), (80, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<double>, rid int, part int")
    got = sorted(map(tuple, L.nearest(df, "vec_id % 20 = 0", 2).collect()))
    assert got == [(0, 1, 4, 2.0)] * 2 + [(0, 2, 0, 1.0)] * 2  # the other row of id 0 counts
    assert L.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1024, 8))
    graph = L.neighbour_graph(x, 8)
    part = L.balanced_parts(graph, 8)
    assert np.bincount(part).tolist() == [128] * 8
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 0.35  # at random: 0.125

"""Classes of the n-gram join against all pairs."""

import random
import re

import pytest

from ledgerfold.llm import graph, ngram_join


def shingles(text, k):
    w = [m.encode().lower() for m in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, threshold):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                m = len(sets[i] & sets[j])
                if 100 * m >= threshold * (len(sets[i]) + len(sets[j]) - m):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), least.get(find(i), -1) if s else (d if d is not None else -1)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def fixture_rows(seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = text(60)
    texts = []
    for group in range(8):  # near copies at growing distance, chains included
        base = text(rng.randrange(30, 200))
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
            if rng.random() < 0.3:
                base = t
    texts += [" ".join(passage + text(rng.randrange(1, 14))) for _ in range(60)]
    texts += [" ".join(text(rng.randrange(1, 8))) for _ in range(60)]
    texts += ["One  two\tthree", "one TWO three", "one two", "é É", "É É", "x"] * 2 + ["", "  \n", None, None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,threshold", [(4, 85), (5, 80)])
def test_classes_equal_all_pairs(spark, k, threshold):
    rows = fixture_rows(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(df, k, threshold).collect())
    assert got == brute(rows, k, threshold)


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (7, "q r s t u"), (3, "q r s t u"), (None, "z y x w"), (None, None), (2, ""), (9, "q " * 30_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, component_id long")
    out = ngram_join.link_classes(df, 4, 85)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in out.collect())
    assert got == brute(rows, 4, 85)
    kept = ngram_join.keep_one(df, 4, 85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:9]) for r in kept.collect()) == [(-1, ""), (-1, "z y x w"), (2, ""), (3, "q r s t u"), (7, "a b c d e"), (9, "q q q q q")]
    assert ngram_join.link_classes(df.limit(0), 4, 85).count() == 0 and ngram_join.keep_one(df.limit(0), 4, 85).count() == 0


def test_one_large_group_makes_no_pairs(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(600):
        t = list(base)
        t[i % 120] = f"v{i}"
        rows.append((i, " ".join(t)))
    out = ngram_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.component_id for r in out} == {0}


def test_near_copies_without_a_common_pivot_make_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):  # linked with the last row, not with each other
        t = list(base)
        t[rng.randrange(10, 55)], t[rng.randrange(65, 110)] = f"u{i}", f"v{i}"
        rows.append((i, " ".join(t)))
    rows.append((300, " ".join(base)))
    met, verify = [], ngram_join._verify

    def counted(pairs, *more):
        met.append(pairs.count())
        return verify(pairs, *more)

    monkeypatch.setattr(ngram_join, "_verify", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_classes(df, 4, 85).collect())
    assert got == brute(rows, 4, 85) and {c for _, _, c in got} == {0}
    assert sum(met) < 20 * len(rows), met


@pytest.mark.parametrize("sizes", [(0, 1, 255, 256), (257, 300, 700, 5000)])
def test_sketches_never_differ_in_more_bits_than_the_sets(spark, sizes):
    import numpy as np

    rng = np.random.default_rng(5)
    sets = []
    for n in sizes:
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for lost in (0, 1, 20):
            sets.append(np.concatenate([one[lost:], rng.integers(0, 1 << 63, lost // 2).astype(np.uint64)]))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketches = ngram_join._sketches(np.concatenate(sets), offsets).to_pylist()
    classes = spark.createDataFrame([(i, len(s), w) for i, (s, w) in enumerate(zip(sets, sketches))], "node long, n long, sketch array<long>")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i)], "a long, b long")
    for r in ngram_join._apart(pairs, classes).collect():
        apart = len(np.setxor1d(sets[r.a], sets[r.b]))
        assert r.apart <= apart and (apart > 60 or r.apart >= apart / 2 or r.apart >= apart - 8), (r, apart)


def test_components(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)] + [(500, 501)], [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], [(1, 1)]):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r.node: r.component for r in graph.components(df).collect()}
        assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_query(spark, sf_small):
    from ledgerfold.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op2_ngram_jaccard"](spark, sf_small).collect())) == brute(rows, 4, 85)

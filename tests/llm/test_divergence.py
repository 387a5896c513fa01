"""Source divergence against a plain version, over the edges of buckets and chunks."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerfold.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, add=5, scale=10**9, top=50):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        words = Counter(w.translate(LOWER) for w in TERM.findall(t))
        docs[lang].update(words.keys())
        groups[lang, source].update(words)
    out = set()
    for lang, source in groups:
        kept = [w for w, n in docs[lang].items() if n >= min_docs]
        v = len(kept)
        sources = [s for a, s in groups if a == lang]

        def share(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + scale * (counts[w] + add) // (total + add * v) for w in kept}

        p, q = share(groups[lang, source]), share(sum((groups[lang, s] for s in sources), Counter()))
        pairs = []
        for other in sources:
            if other != source:
                r = share(groups[lang, other])
                pairs.append((-sum(abs(p[w] - r[w]) for w in kept), other.encode()))
        terms = [(q[w] - p[w], w.encode()) for w in kept if groups[lang, source][w] and p[w] > q[w]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            for rank, (f, item) in enumerate(sorted(found)[:limit], 1):
                out.add((lang, source, part, item.decode(), -f, rank))
    return out


def check(spark, rows, schema="text string, lang string, source string", **how):
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema), **how).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain([r[:3] for r in rows], how["min_docs"], top=how.get("top_terms", 50))


def test_terms():
    assert divergence.terms_of("Ab,aB É-é 日本x7y\x00z".encode()) == {k.encode(): n for k, n in {"ab": 2, "É": 1, "é": 1, "日本x": 1, "y": 1, "z": 1}.items()}


def test_random_texts(spark):
    rng = random.Random(4)
    words = [a + b for a in "aeiouéß日" for b in "bcdfgBCDFG"]
    rows = [(" ".join(rng.choice(words[k % 5 * 7:]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), f"s{k % 7}") for k in range(400)]
    check(spark, rows, min_docs=30)
    check(spark, rows, min_docs=3, top_terms=4)


def test_more_sources_than_a_chunk_and_more_terms_than_a_bucket(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 5) for _ in range(12)), "xx", f"s{k % 150:03d}") for k in range(600)]
    check(spark, rows, min_docs=2)
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 7)  # buckets are counted on the driver
    check(spark, rows[:200], min_docs=2)


def test_counters_are_passed_on_in_parts(spark, monkeypatch):
    held = divergence.HELD
    try:
        divergence.HELD = 50
        import pyarrow as pa
        texts = [f"w{chr(97 + k % 26)} same {chr(97 + k % 7) * 3}".encode() for k in range(600)]
        batch = pa.record_batch({"lang": ["l"] * 600, "source": ["s"] * 600, "text": texts})
        total = Counter()
        parts = list(divergence._count(iter([batch])))
        for p in parts:
            for r in p.to_pylist():
                total[r["term"]] += r["docs"]
    finally:
        divergence.HELD = held
    assert len(parts) > 1 and total == sum((Counter(set(divergence.terms_of(t))) for t in texts), Counter())


def test_nulls_ties_repeats_long_texts_and_other_columns(spark):
    rows = [(None, None, None, 1), (None, None, "x", 1), ("", "en", "b", 2), ("a b", "en", "a", 2), ("a b", "en", "a", 2), ("B A " * 50_000, "en", None, 3), ("7", "fr", "q", 0)]
    check(spark, rows, schema="text string, lang string, source string, p long", min_docs=1)
    check(spark, rows, schema="text string, lang string, source string, rank long", min_docs=30)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("name", ["op13_source_divergence"])
def test_query(spark, sf_small, name):
    from ledgerfold.llm.queries import QUERIES

    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES[name](spark, sf_small).collect()} == plain(rows, 30)

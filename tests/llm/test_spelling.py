"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerfold.llm import spelling

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def plain(rows, min_length=6, min_count=5, ratio=5, noise=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def check(spark, rows, **how):
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA), **how).collect()]
    assert len(got) == len(set(got))
    how.pop("symbols", None)
    assert set(got) == plain(rows, **how)
    return got


def _neighbours(word, rng):
    i = rng.randrange(len(word))
    c = rng.choice("abcéÿz")
    return rng.choice([word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:]])


@pytest.mark.parametrize("symbols", [2, 3, 5])
def test_random_words(spark, symbols):
    rng = random.Random(symbols)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 11))) for _ in range(150)]
    words += [_neighbours(w, rng) for w in words] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    rows = [(k, " ".join(rng.choice(words).title() + rng.choice([" ", "1", "-"]) for _ in range(90))) for k in range(120)]
    got = check(spark, rows, min_count=2, ratio=2, symbols=symbols, noise=7)
    assert sum(r[4] > 0 for r in got) > 100


def test_every_edit_is_found(spark):
    """One word, all its edits at every place and letter class."""
    word = "straßenbahn"
    rng = random.Random(1)
    others = {_neighbours(word, rng) for _ in range(400)} | {word[:i] + "q" + word[i:] for i in range(12)} | {word[:i] + word[i + 1:] for i in range(11)}
    rows = [(1, " ".join([word] * 50))] + [(2, w) for w in sorted(others)]
    got = {r[0]: r for r in check(spark, rows, min_count=1)}
    assert got[word][4] == len(others - {word}) and all(got[w][1] == word for w in others - {word})


def test_chains_ties_and_hot_words(spark):
    rows = [(1, "kettenwort " * 1000 + "kettenwor " * 100 + "kettenwo " * 10 + "kettenw " * 2), (2, "gleicha " * 9 + "gleichb " * 9 + "gleich " + "gleichc")]
    got = {r[0]: r for r in check(spark, rows, min_count=1)}
    assert got["kettenw"][2] == "kettenwort" and got["gleich"][1] == "gleicha"


def test_nulls_empty_long_repeats_and_other_columns(spark):
    long = "x" * 20_000 + "y"
    rows = [(None, None), (None, "Wörtern wörtern Ärger÷x ÄRGER×Y"), (None, "Wörtern wörtern Ärger÷x ÄRGER×Y"), (3, ""), (4, f"{long} {long}z {long} z{long}")]
    check(spark, rows, min_count=1, noise=3)
    check(spark, rows, min_count=1)
    clash = spark.createDataFrame([(1, "wortlaut wortlaut", 5, "w")], "doc_id long, text string, n long, word string")
    assert [tuple(r) for r in spelling.variants(clash, min_count=2).collect()] == [("wortlaut", None, "wortlaut", 2, 0, None)]
    assert spelling.variants(clash.limit(0)).count() == 0
    assert spelling.variants(clash.select("doc_id", "text")).count() == 0


def test_words_are_passed_on_in_parts(spark):
    rows = [(k, f"parts{chr(97 + k % 26)}{chr(97 + k // 26)} together") for k in range(600)]
    held = spelling.HELD
    spelling.HELD = 40
    try:
        docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        got = {r.word: r.n for r in spelling.word_counts(docs, 6, None).collect()}
    finally:
        spelling.HELD = held
    assert got["together"] == 600 and len(got) == 601


def test_query(spark, sf_small):
    from ledgerfold.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op12_spelling_variants"](spark, sf_small).collect()} == plain(rows, noise=199)

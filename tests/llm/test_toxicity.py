"""The grammar's patterns, what is learned, and held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerfold.llm import toxicity as T


def patterns(text, words=("idiot", "stupid"), stems=("lowei",)):
    c = T.Matcher(words, stems).counts(text)
    return {p: int(n) for p, n in zip(T.PATTERNS, c) if n}


def test_patterns():
    assert patterns("You are an idiot") == {"insult_aimed": 1}
    assert patterns("he is an idiot.") == {"insult": 1}
    assert patterns("he is not an idiot") == {"insult_denied": 1}
    assert patterns("they said: fine. They said you are an idiot") == {"insult_reported": 1}
    assert patterns("I will kill time") == {}
    assert patterns("you, I will kill you") == {"threat_aimed": 1}
    assert patterns("loweitum xlowei idioty") == {"insult": 1}
    assert patterns("you idiot, idiot! idiot") == {"insult_aimed": 2, "insult": 1}
    assert patterns("") == {} and patterns("x" * 100_000) == {} and patterns("idiot " * 1000) == {"insult": 1000}
    assert patterns("not a b c d idiot") == {"insult": 1}


def test_composition_equals_running_the_parts():
    marked = T._IN + ["I/r", "T/r"]
    a, b = T._reported(), T._within("N", 3, "/n", marked)
    ab = a.compose(b, T._IN)
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = [T._IN[i] for i in rng.integers(0, len(T._IN), 12)]
        x, y, z, got, want = a.start, b.start, ab.start, [], []
        for c in s:
            x, mid = a.step[x, c]
            y, out = b.step[y, mid]
            z, out2 = ab.step[z, c]
            want.append(out)
            got.append(out2)
        assert got == want


def test_learns_unseen_stems_and_holds_up(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = list(rng.choice(vocabulary, 40))
        toxic = i % 5 == 0
        if toxic:
            words.insert(7, "zorgk" + "".join(rng.choice(list("abc"), 3)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(docs, known)
    assert any("zorgk".startswith(s) or s.startswith("zorgk") for s in model.stems)
    out = T.score(docs, model).collect()
    held = [(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean(held) > 0.97
    scores = {r.doc_id: r.score for r in T.score(spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "zorgkaaa")], "doc_id long, text string"), model).collect()}
    assert scores[1] == scores[2] < 0.5 < scores[3]


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = [(i, f"plain words here number{i}" + (" zzztop" if zlib.crc32(str(i).encode()) % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = T.fit(docs, known)
    assert not any("zzz" in w for w in (*model.words, *model.stems))


def test_scores_do_not_change_with_held_out_labels(spark):
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = spark.createDataFrame([(i, f"some words of text {i % 7}" + (" you zzztop" if i % 4 == 0 else "")) for i in range(400)], "doc_id long, text string")
    scores = []
    for flip in (False, True):
        known = spark.createDataFrame([(i, int(i % 4 == 0) ^ int(flip and i in held)) for i in range(400)], "doc_id long, toxic int")
        scores.append(sorted((r.doc_id, r.score) for r in T.score(docs, T.fit(docs, known)).collect()))
    assert scores[0] == scores[1]


def test_precision_is_that_of_the_table_not_of_the_sample(spark):
    """200 toxic and 2,000 clean rows; a word in all toxic and a tenth of the clean ones is no insult,
    also where the sample holds as many rows of either label."""
    rows = [(i, "zzztop here" if i % 11 == 0 or i % 10 == 1 else f"other words {i % 13}") for i in range(2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.concat("text", F.lit(" n"), "doc_id"))
    known = spark.createDataFrame([(i, int(i % 11 == 0)) for i in range(2200)], "doc_id long, toxic int")
    assert not any("zzz" in w for w in T.fit(docs, known, fit_rows=100).words)


def test_empty_tables_and_clashes(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, none)
    out = T.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxic", "score"] and out.first().score >= 0.5
    assert T.score(docs.limit(0), T.fit(docs.limit(0), none)).count() == 0


def test_query(spark, sf_small):
    from ledgerfold.llm.queries import QUERIES

    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(held) > 0.9

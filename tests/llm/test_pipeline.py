"""The pipeline's stages against plain versions, and its contract."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from ledgerfold.llm.queries import bpe_path
from tests.llm.test_ngram_join import brute


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    kept = C.drop_toxic(spark, docs, sf_small)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert all(labels.get(i, 1) == 1 for i in gone)
    one = C.keep_one_of_each_class(spark, kept, sf_small)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, c in brute(rows, C.SHINGLE_WORDS, C.SIMILARITY) if d == c)
    hidden = C.hide_private_values(spark, one, sf_small)
    assert hidden.columns == docs.columns and hidden.count() == one.count()
    assert all(r.n_chars == len(r.text) for r in hidden.collect())
    mixed = C.mix_sources(spark, hidden, sf_small)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in hidden.collect()}


def test_run(spark, sf_small):
    out = C.run(spark, sf_small)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    rows = out.collect()
    assert rows and all(len(r.ids) == r.n_tokens for r in rows)


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, 0, "e"), (2, "", "en", "s", 0, "e"), (2, "", "en", "s", 0, "e"), (3, "a b c d e f g", "en", "s", 13, "e"), (4, "a b c d e f g", "en", "t", 13, "e"),
            (None, "you idiot, you stupid moron", "en", "t", 1, "e"), (5, "mail x.34@mail7.example.com " * 3, "en", "t", 1, "e"), (6, "z " * 60_000, None, "t", 1, "e")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"], name
    final = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == {1, 2, 3, 5, 6}
    tok = Tokenizer.from_file(bpe_path())
    assert next(r for r in final if r.doc_id == 3).ids == np.array(tok.encode("a b c d e f g", add_special_tokens=False).ids).tolist()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0

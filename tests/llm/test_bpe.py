"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerfold.llm import bpe
from ledgerfold.llm.queries import bpe_path

ODD = ["", " \n\t", "a" * 5000, "!" * 999, "<|endoftext|>x <|startoftext|>", "İΣΑΣ ΟΔΟΣ it's THEY'RE 'S's", "\x1c\x1d a\x85b", "e\u0301 ﬁ ²½Ⅷ", "\u0558֌⁝", "日本語 テスト 한국어"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_path())


def _random_texts(n: int) -> list[str]:
    rng = random.Random(3)
    pool = [chr(c) for a, b in ((0, 0x300), (0x300, 0x590), (0x2000, 0x2070), (0x4E00, 0x4E20), (0x1F600, 0x1F610), (0x1160, 0x1180)) for c in range(a, b)]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_same_ids_and_decoding(library):
    mine = bpe.RankArrayBpe(bpe_path())
    for t in ODD + _random_texts(1500):
        ids = library.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert mine.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    mine = bpe.RankArrayBpe(bpe_path())
    rng = random.Random(5)
    for _ in range(300):
        parts = [rng.choice(mine.inner) for _ in range(rng.randrange(1, 60))]
        assert mine._scan(list(parts)) == mine._heap(list(parts))


def test_query_over_documents(spark, sf_small, library):
    from ledgerfold.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op7_rank_array_bpe"](spark, sf_small).collect()}
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_clashing_and_empty(spark):
    df = spark.createDataFrame([(1, None, 9), (None, "a b", 9), (1, None, 9)], "doc_id long, text string, ids long")
    out = bpe.encode(df, bpe_path())
    assert sorted((r.doc_id or 0, r.n_tokens, len(r.ids)) for r in out.collect()) == [(0, 2, 2), (1, 0, 0), (1, 0, 0)]
    assert {r.text for r in bpe.decode(out, bpe_path()).collect()} == {"", "a</w> b</w>"}
    assert bpe.round_trip_digests(df.limit(0), bpe_path()).count() == 0


def test_path_is_a_parameter():
    assert bpe_path() == public_tokenizers.path("word_bpe_49k.json")

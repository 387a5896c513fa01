"""Offset-preserving encoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from ledgerfold.llm import piece_bpe
from ledgerfold.llm.queries import piece_path

ODD = ["", " ", "   ", " a", "a ", "▁", "▁▁ x▁", "a" * 5000, "!" * 999, "<s>x</s><unk><0x41>", "\x00\x01\t\n\r\n", "é ﬁ ²½Ⅷ",
       "日本語 テスト 한국어", "🙂👨‍👩‍👧 ok", "﻿x y　z", "ab  cd     ef" + " " * 40 + "g", "\U0010ffff�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_path())


def _random_texts(n: int, most: int = 60) -> list[str]:
    rng = random.Random(11)
    pool = [chr(c) for a, b in ((0, 0x180), (0x300, 0x320), (0x2000, 0x2070), (0x2580, 0x2584), (0x4E00, 0x4E20), (0xFB00, 0xFB07), (0xFF10, 0xFF60), (0x1F600, 0x1F610))
            for c in range(a, b)] + [" "] * 60 + list("etaoinshr") * 12
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_ids_spans_and_decoding_are_the_librarys(library):
    mine = piece_bpe.PieceBpe(piece_path())
    for t in ODD + _random_texts(2000) + _random_texts(20, 3000):
        ids, first, end = mine.encode(t)
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True), t
        assert mine.decode(ids) == library.decode(ids.tolist()), t
        assert list(zip(first[1:-1].tolist(), end[1:-1].tolist())) == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces], t


def test_decoding_any_ids(library):
    mine = piece_bpe.PieceBpe(piece_path())
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), rng.randrange(259, 300)]) for _ in range(rng.randrange(12))]
        assert mine.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_scan_and_heap_agree():
    mine = piece_bpe.PieceBpe(piece_path())
    for t in _random_texts(500):
        assert mine._merge(t) == mine._heap(list(t))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("tidy", [True, False])
def test_compiled_map_and_alignment(rule, prefix, tidy):
    """The longest-prefix map and its offsets, on the library's own rule sets."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=tidy)
    spec = dict(piece_bpe._fields(dict(piece_bpe._fields(library.serialized_model_proto()))[3]))
    mine = piece_bpe.Normaliser(spec[2], prefix, tidy)
    for t in [o for o in ODD if "\x00" not in o] + [r.replace("\x00", "") for r in _random_texts(400)]:
        out, origin = mine(t)
        want, places = library.normalize(t, with_offsets=True)
        assert out.decode() == want, t
        raw = t.encode()
        assert [len(raw[:origin[len(out.decode()[:k].encode())]].decode()) for k in range(len(want) + 1)] == list(places), t


def test_query_over_documents(spark, sf_small, library):
    from ledgerfold.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_offset_pieces"](spark, sf_small).collect()}
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_clashing_and_empty(spark):
    df = spark.createDataFrame([(1, None, 9), (None, "a b", 9), (1, None, 9), (2, "", 0)], "doc_id long, text string, ids long")
    out = piece_bpe.encode(df, piece_path())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == [(0, 4), (1, 2), (1, 2), (2, 2)]
    row = out.where("doc_id is null").first()
    assert list(zip(row.first_byte, row.end_byte)) == [(0, 0), (0, 1), (1, 3), (3, 3)]
    assert {r.text for r in piece_bpe.decode(out, piece_path()).collect()} == {"", "a b"}
    assert piece_bpe.round_trip_digests(df.limit(0), piece_path()).count() == 0


def test_a_very_long_text_without_blanks(library):
    mine = piece_bpe.PieceBpe(piece_path())
    t = "abcde日🙂" * 30_000
    assert mine.encode(t)[0].tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_another_kind_of_model_is_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))  # trainer: model type 1
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(path))

"""BPE encoding and decoding with a contiguous rank array.

A vocabulary file of the ``tokenizers`` library (BPE over byte-level symbols
with a word-end suffix) is read once per task from ``path``; the path is a
parameter.  Texts are normalised (NFC, lower case character by character),
split into words, and each distinct word is merged once and kept in a bounded
table of the task.

A word of up to ``SHORT`` symbols keeps two plain arrays: the part ids (the
boundaries) and the rank of every adjacent pair.  The loop scans for the least
rank, joins that pair, deletes one boundary and refreshes the two neighbouring
ranks.  A longer word runs the same merges from a heap, since scanning would be
quadratic in its length; both give the same ids.

Defined cases: a null text counts as empty and gives no ids; ids of texts that
hold a special token's string contain that token, as the library does;
repeated rows give repeated results; columns other than the id and the text are
ignored by :func:`encode`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import map_batches, texts_of

SHORT = 64
#: Distinct words kept per task; beyond it the table starts anew.
CACHE_WORDS = 200_000
_NO_RANK = 1 << 60

#: Fixed: white space as the vocabulary's pattern understands it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_LATIN_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Texts below U+0250 take the plain module (faster); all others Unicode classes.
_FAST = re.compile(f"[{_LATIN_LETTERS}]+|{_CONTRACTIONS}|[{_LATIN_NUMBERS}]|[^{_SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]+")
#: Fixed: ranges that the regex module already counts as letters or numbers
#: (its Unicode tables are newer) and the tokenizers library does not.
_LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 "
    "1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead "
    "323b0-33479 3d000-3fc3f"
)
_LATER_CLASS = "[" + "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in _LATER.split()) + "]"
_LETTER, _NUMBER = rf"[\p{{L}}--{_LATER_CLASS}]", rf"[\p{{N}}--{_LATER_CLASS}]"
_FULL = regex.compile(rf"(?V1){_CONTRACTIONS}|{_LETTER}+|{_NUMBER}|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Fixed: lower-case forms that the library knows beyond Python's tables, and
#: capital sigma without Python's word-final rule.
_LOWER_ALSO = str.maketrans(
    {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7DC: 0x19B}
    | {c: c + 1 for c in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)
_BEYOND = re.compile("[^\\x00-\\u024f]")


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes (public byte-level BPE convention)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class RankArrayBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special: dict[str, int] = {}
        for t in spec["added_tokens"]:
            self.special[t["content"]] = t["id"]
            self.tokens[t["id"]] = t["content"]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab.get(s, -1) for s in symbols]
        self.final = [vocab.get(s + suffix, -1) for s in symbols]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}

    def merge_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        parts = [p for p in parts if p >= 0]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        merge, none = self.merge, (_NO_RANK, -1)
        ranks = [merge.get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = merge[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge.get((parts[i - 1], parts[i]), none)[0]
            if i < len(ranks):
                ranks[i] = merge.get((parts[i], parts[i + 1]), none)[0]
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, merge = len(parts), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(merge[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in merge]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = merge[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (p := (parts[left], parts[right])) in merge:
                    heapq.heappush(queue, (merge[p][0], left, *p))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> bytes:
        """Ids (little-endian unsigned 32 bits) of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        wide = _BEYOND.search(text)
        text = (text.translate(_LOWER_ALSO) if wide else text).lower()
        words, out = self.words, []
        for w in (_FULL if wide or _BEYOND.search(text) else _FAST).findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                ids = np.array(self.merge_word(w), dtype="<u4").tobytes()
                if len(w) <= SHORT:
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.split_special is None:
            return self._plain(text)
        pieces = self.split_special.split(text)
        if len(pieces) == 1:
            return self._plain(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(pieces))

    def decode(self, ids: bytes) -> str:
        """Token strings joined by one space (the file names no decoder)."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[str, RankArrayBpe] = {}


def load(path: str) -> RankArrayBpe:
    """The vocabulary of ``path``, read once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = RankArrayBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids array<int>) for every row, whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = [bpe.encode(t) for t in texts_of(batch.column(1))]
        lengths = np.array([len(i) // 4 for i in ids], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=[id_col, "n_tokens", "ids"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        texts = [bpe.decode(np.array(i or [], dtype="<u4").tobytes()) for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(id_col, "ids"), run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass,
    so that ids and decoded texts need not be stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        n, a, b = [], [], []
        for t in texts_of(batch.column(1)):
            ids = bpe.encode(t)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(F.col(id_col), F.col(text_col)), run,
        f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )

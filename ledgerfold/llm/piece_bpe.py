"""SentencePiece BPE encoding that keeps byte offsets, and decoding.

A model file of the ``sentencepiece`` library (BPE) is read once per task from
``path``; the path is a parameter.

1. *Normalising with alignment.*  At every place the longest entry of the
   model's compiled character map (a double-array trie over bytes) that the
   text goes on with is replaced; where none fits, one character is kept.
   Blanks become the visible blank, a leading one is added, and superfluous ones
   go, as the model says.  Each byte of the normalised text keeps the byte
   offset of the source it came from.
2. *Merging.*  The normalised text is cut where no piece of the vocabulary
   crosses: before a blank that follows something else, and between letters and
   other signs.  Which of these cuts hold is checked when the model is loaded;
   without any the text stays whole.  Each distinct cut is merged once per task and kept in a bounded
   table: short ones by scanning for the best score, long ones from a heap.
   Characters without a piece fall back to byte pieces.
3. *Projection.*  Pieces are laid end to end over the normalised bytes and read
   through the alignment, so that every id has its span of source bytes.  All
   byte pieces of a character but the last are empty spans, as in the library.

Defined cases: a null text counts as empty and gives the begin and end ids
only; repeated rows give repeated results; other columns are ignored.  Models
of another kind, with unused pieces or with a denormaliser raise ``ValueError``.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerfold.llm.common import map_batches, texts_of

#: The visible blank of the library's pieces.
BLANK = "▁"
#: Longest cut that is merged by scanning and kept.
SHORT = 64
#: Distinct cuts kept per task; beyond it the table starts anew.
CACHE_CUTS = 300_000
_NO_RANK = 1 << 60
#: Letters, and all else but the blank, for the finer cut.
_LETTER, _OTHER = "[^\\W\\d_\\xb2\\xb3\\xb9\\xbc-\\xbe]", f"(?:[\\W\\d_\\xb2\\xb3\\xb9\\xbc-\\xbe](?<!{BLANK}))"
#: (a piece that the cut would break, the cut), finest first.
_CUTS = (
    (f"[^{BLANK}]{BLANK}|{_LETTER}{_OTHER}|{_OTHER}{_LETTER}", f"{BLANK}*(?:{_LETTER}+|{_OTHER}+)|{BLANK}+"),
    (f"[^{BLANK}]{BLANK}", f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"),
)

# Fixed: piece types and the model type of the public protocol.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message; groups do not occur."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(blob):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, blob[at:at + size]
        at += size


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a double-array trie
    over bytes, whose values are places in a list of zero-ended texts."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
        self.texts = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest entry at ``at``."""
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._offset(unit)
            if unit & 256:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1]:end]


class Normaliser:
    """Normalised bytes of a text and, for each, the source byte it came from."""

    def __init__(self, character_map: bytes = b"", dummy_prefix: bool = True, tidy_blanks: bool = True,
                 escape_blanks: bool = True, blank_last: bool = False, symbols: list[str] = ()):
        self.map = CharacterMap(character_map) if character_map else None
        self.dummy_prefix, self.tidy_blanks, self.blank_last = dummy_prefix, tidy_blanks, blank_last
        self.blank = BLANK.encode() if escape_blanks else b" "
        kept = sorted((s.encode() for s in symbols), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, kept))) if kept else None

    def _prefixes(self, raw: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, start, bytes taken) from left to right."""
        at = 0
        while at < len(raw):
            symbol = self.symbols.match(raw, at) if self.symbols else None
            hit = (len(symbol[0]), symbol[0]) if symbol else self.map.longest(raw, at) if self.map else None
            if hit is None:
                first = raw[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                hit = n, raw[at:at + n]
            yield hit[1], at, hit[0]
            at += hit[0]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source offsets: one a byte and one for the end)."""
        raw = text.encode("utf-8")
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.map is None and self.symbols is None and not self.tidy_blanks:
            out, origin = self._identity(raw)
            end = len(raw)
        else:
            out, origin, end = self._mapped(raw)
            if out is None:
                return b"", np.zeros(1, np.int64)
        return out, np.append(origin, end)

    def _identity(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """No map: blanks are widened, every byte points at its character's start."""
        byte = np.frombuffer(raw, np.uint8)
        start = np.arange(len(raw), dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
        if not raw.isascii():
            start = np.maximum.accumulate(start * ((byte & 0xC0) != 0x80))
        origin = np.repeat(start, 1 + (len(self.blank) - 1) * (byte == 32).view(np.int8))
        out = raw.replace(b" ", self.blank)
        if self.dummy_prefix:
            around = np.full(len(self.blank), len(raw) if self.blank_last else 0)
            if self.blank_last:
                return out + self.blank, np.concatenate([origin, around])
            return self.blank + out, np.concatenate([around, origin])
        return out, origin

    def _mapped(self, raw: bytes) -> tuple[bytes | None, np.ndarray, int]:
        parts: list[bytes] = []
        lengths: list[int] = []
        sources: list[int] = []

        def put(what: bytes, source: int) -> None:
            parts.append(what)
            lengths.append(len(what))
            sources.append(source)

        begun, after_blank, end = False, self.tidy_blanks, 0
        for new, at, taken in self._prefixes(raw):
            end = at + taken
            if not begun:
                if self.tidy_blanks and new == b" ":
                    continue
                begun = True
                if self.dummy_prefix and not self.blank_last:
                    put(self.blank, at)
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", self.blank), at)
                after_blank = new.endswith(b" ")
            after_blank = after_blank and self.tidy_blanks
        if not begun:
            return None, np.zeros(0, np.int64), 0
        out, origin = b"".join(parts), np.repeat(np.array(sources, np.int64), lengths)
        if self.tidy_blanks:
            while out.endswith(self.blank):
                out = out[:-len(self.blank)]
                end = int(origin[len(out)])
                origin = origin[:len(out)]
        if self.dummy_prefix and self.blank_last:
            out, origin = out + self.blank, np.append(origin, np.full(len(self.blank), end))
        return out, origin, end


class PieceBpe:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._read(f.read())
        self.cuts: dict[str, bytes] = {}

    def _read(self, blob: bytes) -> None:
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for number, value in _fields(blob):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode("utf-8"), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
            elif number == 5 and dict(_fields(value)).get(2):
                raise ValueError("models with a denormaliser are not supported")
        if trainer.get(3, 1) != BPE:
            raise ValueError("not a BPE model")
        if any(kind == UNUSED for *_, kind in pieces):
            raise ValueError("models with unused pieces are not supported")
        own = [p for p, _, kind in pieces if kind == USER_DEFINED]
        self.tidy_blanks, self.blank_last = bool(normal.get(4, 1)), bool(trainer.get(24, 0))
        self.dummy_prefix = bool(normal.get(3, 1))
        self.normalise = Normaliser(normal.get(2, b""), self.dummy_prefix, self.tidy_blanks, bool(normal.get(5, 1)), self.blank_last, own)
        self.frozen = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True))) + "|(?s:.)") if own else None
        self.own = set(own)
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        place = {s: k for k, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        self.rank = {p: place[s] for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        self.unknown = next(i for i, (*_, kind) in enumerate(pieces) if kind == UNKNOWN)
        named = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.begin = named[trainer.get(45 + 1, b"<s>").decode()]
        self.end = named[trainer.get(45 + 2, b"</s>").decode()]
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE} if trainer.get(35) else None
        surface = trainer.get(44, " ⁇ ".encode())
        self.shown: list[bytes] = []
        for p, _, kind in pieces:
            self.shown.append(b"" if kind == CONTROL else surface if kind == UNKNOWN
                              else bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode())
        self.starts_blank = [p.startswith(BLANK) and kind in (NORMAL, USER_DEFINED) for p, _, kind in pieces]
        self.silent = np.array([kind == CONTROL for *_, kind in pieces])
        safe = [cut for broken, cut in _CUTS if not any(map(re.compile(broken).search, self.id))]
        self.cut = re.compile(safe[0]) if safe and self.byte_id is not None else None

    # ------------------------------------------------------------------ merging

    def _symbols(self, text: str) -> tuple[list[str], set[int]]:
        if self.frozen is None:
            return list(text), set()
        parts = self.frozen.findall(text)
        return parts, {i for i, p in enumerate(parts) if p in self.own}

    def _merge(self, text: str) -> list[str]:
        parts, frozen = self._symbols(text)
        return self._scan(parts) if len(parts) <= SHORT and not frozen else self._heap(parts, frozen)

    def _scan(self, parts: list[str]) -> list[str]:
        """Join the best pair, the leftmost of equals, again and again."""
        rank = self.rank.get
        ranks = [rank(a + b, _NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NO_RANK:
                break
            i = ranks.index(best)
            here = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + here, _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(here + parts[i + 1], _NO_RANK)
        return parts

    def _heap(self, parts: list[str], frozen: set[int] = frozenset()) -> list[str]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else n
            if right < n and left not in frozen and right not in frozen:
                both = parts[left] + parts[right]
                if both in rank:
                    heapq.heappush(queue, (rank[both], left, len(both)))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _pieces(self, text: str) -> bytes:
        """Ids of a cut, each with the normalised bytes that it covers, as packed numbers."""
        out: list[int] = []
        unknown_before = False
        for p in self._merge(text):
            i = self.id.get(p, self.unknown)
            raw = p.encode("utf-8")
            if i == self.unknown and self.byte_id is not None:
                for b in raw:
                    out += (self.byte_id[b], 0)
                out[-1] = len(raw)
            elif i == self.unknown and unknown_before:
                out[-1] += len(raw)
            else:
                out += (i, len(raw))
            unknown_before = i == self.unknown
        return array("I", out).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with begin and end, first source byte, source byte after the last) of a text."""
        normal, origin = self.normalise(text)
        whole = normal.decode("utf-8")
        cuts = self.cut.findall(whole) if self.cut else [whole] if whole else []
        known = self.cuts
        found = list(map(known.get, cuts))
        if None in found:
            fresh: dict[str, bytes] = {}
            for k, cut in enumerate(cuts):
                if found[k] is None:
                    found[k] = fresh.get(cut) or fresh.setdefault(cut, self._pieces(cut))
            if len(known) + len(fresh) > CACHE_CUTS:
                known.clear()
            if len(fresh) <= CACHE_CUTS:
                known.update((cut, p) for cut, p in fresh.items() if len(cut) <= SHORT)
        packed = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2)
        ids, size = packed[:, 0], packed[:, 1]
        last = np.cumsum(size, dtype=np.int64)
        edge = origin[-1:]
        return (
            np.concatenate([[self.begin], ids, [self.end]]).astype("<u4"),
            np.concatenate([[0], origin[last - size], edge]),
            np.concatenate([[0], origin[last], edge]),
        )

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces joined (a byte that is part of no character
        gives U+FFFD; begin and end ids part bytes), the leading blank that
        encoding added taken away."""
        ids = np.asarray(ids, dtype=np.int64)
        parts = np.flatnonzero(self.silent[ids])
        texts = [ids[a:b].tolist() for a, b in zip([0, *(parts + 1)], [*parts, len(ids)]) if a < b]
        out = "".join(b"".join(map(self.shown.__getitem__, t)).decode("utf-8", errors="each_byte") for t in texts)
        added = (self.dummy_prefix or self.tidy_blanks) and not self.blank_last
        return out[1:] if added and texts and self.starts_blank[texts[0][0]] else out


_LOADED: dict[str, PieceBpe] = {}


def load(path: str) -> PieceBpe:
    """The model of ``path``, read once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids, first_byte, end_byte: array<int>) of every row's whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(path)
        done = [model.encode(t) for t in texts_of(batch.column(1))]
        lengths = np.array([len(i) for i, *_ in done], dtype=np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(d[k] for d in done)]).astype(np.int32))) for k in range(3)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), *lists], names=[id_col, "n_tokens", "ids", "first_byte", "end_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, first_byte array<int>, end_byte array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(path)
        texts = [model.decode(np.array(i or [], dtype="<u4")) for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(id_col, "ids"), run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): both directions
    in one pass, so that ids and decoded texts need not be stored.  The spans' digest is
    that of first and end bytes, by turns, as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(path)
        n, a, b, c = [], [], [], []
        for t in texts_of(batch.column(1)):
            ids, first, end = model.encode(t)
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            b.append(hashlib.sha256(model.decode(ids).encode("utf-8")).hexdigest())
            c.append(hashlib.sha256(np.stack([first, end], 1).astype("<u4").tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (a, b, c))],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run,
                       f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")

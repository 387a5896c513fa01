"""Word shingles of whole texts as 64-bit digests, computed batch-wise in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A word's digest is a
polynomial over random byte weights (exact arithmetic modulo 2**64), a
shingle's mixes its words' digests.  Equal shingles always get equal digests;
different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerfold.llm.common import mix64

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.int64).astype(np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
#: Texts are worked on in pieces of about this many bytes (whole rows).
PIECE = 1 << 19
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(int(base), have, 1 << 64))
        more = min(have, n - have)
        out[have:have + more] = out[:more] * step
        have += more
    return out[:n]


#: Odd factors of a shingle's words, by place.
_FACTORS = _powers(np.uint64(0xD6E8FEB86659FD93), 65)[1:]
_KEPT: dict[int, np.ndarray] = {}


def _kept_powers(base: np.uint64, n: int) -> np.ndarray:
    if n > 2 * PIECE:
        return _powers(base, n)
    if int(base) not in _KEPT:
        _KEPT[int(base)] = _powers(base, 2 * PIECE)
    return _KEPT[int(base)][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; nulls have no bytes."""
    col = col.fill_null("").cast(pa.large_string())
    col = pa.concat_arrays([col])  # offsets from 0
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest of every word, its row) in order."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _IS_WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begins[inner] = word[inner]  # a row's first byte begins a word
    starts = np.flatnonzero(begins)
    # A word ends where the next non-word byte, the next start or the row ends.
    stops = word.copy()
    stops[:-1] &= ~word[1:] | begins[1:]
    ends = np.flatnonzero(stops) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _kept_powers(_P, n), dtype=np.uint64)])
    back = _kept_powers(_P_INVERSE, n)[starts]
    digest = mix64((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64) * _P)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return digest, rows


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests, offsets): row i's distinct shingles, ascending, are
    digests[offsets[i]:offsets[i + 1]].  A row of fewer than ``k`` words has its
    whole sequence as one shingle, a row without words none."""
    raw, offsets = text_bytes(col)
    sets, sizes, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        digest, size = _piece(raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], k)
        sets.append(digest)
        sizes.append(size)
        at = to
    return np.concatenate(sets), np.cumsum(np.concatenate(sizes))


def _piece(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests, number of them by row) of some whole rows."""
    rows_n = len(offsets) - 1
    word, row = words_of(raw, offsets)
    per_row = np.bincount(row, minlength=rows_n)
    first = np.concatenate([[0], np.cumsum(per_row)])
    n = len(word)
    digest = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        digest[:n - j] += word[j:] * _FACTORS[j]
    digest = mix64(digest)
    keep = np.arange(n) - first[row] <= per_row[row] - k
    for r in np.flatnonzero((per_row > 0) & (per_row < k)):  # whole sequence, tagged by its length
        at, h = first[r], np.array([per_row[r]], dtype=np.uint64)
        for w in word[at:at + per_row[r]]:
            h = mix64(h * _P + w)
        digest[at], keep[at] = h[0], True
    digest, row = digest[keep], row[keep]
    ends = np.cumsum(np.bincount(row, minlength=rows_n))
    for a, b in zip(ends - np.diff(ends, prepend=0), ends):
        digest[a:b].sort()
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    return digest[new], np.bincount(row[new], minlength=rows_n)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

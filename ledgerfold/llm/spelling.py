"""Spelling variants: words one edit apart, each led to its most frequent form.

*Words.*  Maximal runs of Latin letters, A-Z lowered, counted per task in bounded
tables and added up by Spark.  With ``noise`` a run loses one letter wherever the crc32
of ``<document>:<run>`` is divisible by it (a controlled source of misspellings).

*Reduced alphabet.*  Every letter is hashed to one of ``symbols`` symbols.  The full
one-edit neighbourhood of a reduced word (every replacement, deletion and insertion
of a symbol, and the word itself, as the replaced letter may have the same symbol) is
joined with the reduced vocabulary.  A neighbour also says which half of the word
its edit leaves alone, and the join asks for the same letters there; so words that share
a reduced form are not compared with all others of it.  Reduced words are joined by
64-bit polynomial hashes, from which each edit follows by a few numpy operations, however long the
word.  Candidates are verified on the original strings; nothing is capped.

*Forms.*  A word's form is its near word of the largest count (ties: the smallest in
code-point order) if that is ``ratio`` times its own or more.  Roots follow the forms
by one join a step; counts grow by ``ratio`` with each step, so the steps
are few.

Defined cases: null or empty text has no words; a null id counts as empty text;
repeated rows count again; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import LOWER, UPPER, mix64, staged

#: Fixed: the letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Distinct words that a task holds before it passes them on.
HELD = 200_000
#: Neighbours made at a time.
AT_ONCE = 500_000

_LOW = str.maketrans(UPPER, LOWER)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(doc_id: object, text: str, find: re.Pattern[str], noise: int | None) -> Counter[str]:
    """Occurrences of the runs of one document, as they count."""
    out: Counter[str] = Counter()
    for run, n in Counter(find.findall(text)).items():
        out[run.lower() if run.isascii() else run.translate(_LOW)] += n
    if not noise:
        return out
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    changed = [(w, h) for w in out if not (h := zlib.crc32(w.encode(), start)) % noise]
    lost: Counter[str] = Counter()
    for w, h in changed:
        at = h % len(w)
        lost[w[:at] + w[at + 1:]] += out.pop(w)
    out.update(lost)
    return out


def word_counts(docs: DataFrame, min_length: int, noise: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of ``min_length`` letters or more."""
    pattern = f"[{LETTERS}]{{{min_length},}}"  # a shorter maximal run stays too short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern)
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w, n in words_of(doc_id, text or "", find, noise).items():
                        if len(w) >= min_length:
                            held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class _Hashes:
    """Polynomial hashes of words of one length: reduced, and of the letters themselves."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.size = codes.shape[1]
        self.symbols = symbols
        self.reduced = mix64(codes) % np.uint64(symbols)
        self.value = mix64(np.arange(1, symbols + 1, dtype=np.uint64))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.size, _BASE)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.size, _BACK)]))
        self.before = self._prefixes(self.value[self.reduced.astype(np.int64)])
        self.letters = self._prefixes(mix64(codes + np.uint64(1 << 40)))

    def _prefixes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.size + 1), np.uint64)
        np.cumsum(values * self.power[:-1], axis=1, out=out[:, 1:])
        return out

    def half(self, first: int, last: int) -> np.ndarray:
        """Hash of the letters from ``first`` up to ``last``."""
        return (self.letters[:, last] - self.letters[:, first]) * self.back[first]

    @staticmethod
    def key(reduced: np.ndarray, half: np.ndarray, size: int, side: int) -> np.ndarray:
        return mix64(reduced + mix64(half + np.uint64(2 * size + side)))

    def own(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys of the words themselves: (word numbers, keys) by half."""
        n, middle, whole = np.arange(len(self.reduced)), self.size // 2, self.before[:, -1]
        return [(n, self.key(whole, self.half(0, middle), self.size, 0)), (n, self.key(whole, self.half(middle, self.size), self.size, 1))]

    def neighbours(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of all words of at least ``least`` letters that one edit can give."""
        r, size, whole = self.reduced, self.size, self.before[:, -1:]
        value, power, before = self.value, self.power, self.before
        yield from self.own()
        for s in range(self.symbols):
            new = whole + (value[s] - value[r.astype(np.int64)]) * power[:-1]
            yield from self._by_half(new, r != s, size, 0)
            new = before + value[s] * power + (whole - before) * _BASE
            fresh = np.ones(new.shape, bool)
            fresh[:, 1:] = r != s
            yield from self._by_half(new, fresh, size + 1, -1)
        if size > least:
            new = before[:, :-1] + (whole - before[:, 1:]) * _BACK
            fresh = np.ones(new.shape, bool)
            fresh[:, 1:] = r[:, 1:] != r[:, :-1]
            yield from self._by_half(new, fresh, size - 1, 1)

    def _by_half(self, new: np.ndarray, fresh: np.ndarray, size: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of edits at all places, each with the half of the new word that it
        leaves alone: the first for edits from the middle on.  ``fresh`` marks edits that
        give no reduced word of the place before; the first place of each half counts in any case.
        Letter k of the new word's second half is letter k + ``shift`` of the old one."""
        middle = size // 2
        if not shift:
            again = fresh
        else:
            again = fresh.copy()
            again[:, middle] = True
        for side, part, half in ((1, slice(0, middle), self.half(middle + shift, self.size)), (0, slice(middle, None), self.half(0, middle))):
            word, place = np.nonzero(again[:, part])
            yield word, self.key(new[:, part][word, place], half[word], size, side)


def _keyed(words: DataFrame, least: int, symbols: int, neighbours: bool) -> DataFrame:
    """(key, id) of the words, or of all their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            for size in np.unique(sizes):
                chosen = np.flatnonzero(sizes == size)
                step = max(1, AT_ONCE // int(size * symbols))
                for at in range(0, len(chosen), step):
                    part = chosen[at:at + step]
                    codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(part), size)
                    hashes = _Hashes(codes, symbols)
                    for word, key in hashes.neighbours(least) if neighbours else hashes.own():
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[part[word]])], names=["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_words(words: DataFrame, least: int, symbols: int) -> DataFrame:
    """(id, near, near_word, near_n): every ordered pair of words of (id, word, n) one edit apart."""
    vocabulary = _keyed(words, least, symbols, False).withColumnRenamed("id", "near")
    pairs = _keyed(words, least, symbols, True).join(vocabulary, "key").where("id <> near").select("id", "near").distinct()
    other = words.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    both = pairs.join(words.select("id", "word"), "id").join(other, "near")
    return both.where(F.levenshtein("word", "near_word", 1) == 1).select("id", "near", "near_word", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last form that is reached from each word of (id, form_id)."""
    step = forms.select(F.col("id").alias("at"), F.col("form_id").alias("next"))
    going, found = forms.select("id", F.col("form_id").alias("at")), None
    while True:
        moved = staged(going.join(step, "at", "left"))
        ended = moved.where("next is null").select("id", F.col("at").alias("root"))
        found = ended if found is None else found.unionByName(ended)
        going = moved.where("next is not null").select("id", F.col("next").alias("at"))
        if going.isEmpty():
            return found


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, symbols: int = 5, noise: int | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``min_length`` letters
    and ``min_count`` occurrences or more."""
    counts = word_counts(docs, min_length, noise, id_col, text_col).where(F.col("n") >= min_count)
    words = staged(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near_word", "near"))
    near = near_words(words, min_length, symbols).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = staged(near.select("id", "n_near", F.col("best.near").alias("near"), F.col("best.near_word").alias("near_word"), (-F.col("best.order")).alias("near_n")))
    led = words.join(near, "id", "left").withColumn("leads", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False)))
    led = staged(led.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                            *(F.when(F.col("leads"), F.col(c)).alias(a) for c, a in (("near", "form_id"), ("near_word", "form"), ("near_n", "form_n")))))
    roots = _roots(led.where("form_id is not null").select("id", "form_id"))
    names = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    roots = roots.join(names, "root").select("id", "root_word")
    return led.join(roots, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")

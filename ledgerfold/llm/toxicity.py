"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses at sentence marks.  Each word of a clause becomes a
class symbol: insult, threat, target, negation, reported speech, or other.  Four
small transducers read that string and are composed into one machine:

* reported speech: after a reporting verb, insults and threats become reported;
* negation: within three words after a negation they become denied;
* target: within four words after a target (you, du, tu, ...) they become aimed;
* threat: a threat verb counts only once a target has been seen in the clause.

The composed machine emits, for each insult or threat, one of the patterns
``PATTERNS``; each pattern is an arc weight.  A document's score is the logistic
function of its summed, damped arc weights.

What is learned, from a bounded sample of labelled rows (``fit_rows``):

* the insult lexicon: words and word beginnings that mark labelled texts, found
  by counting them per document and keeping those of high precision; a listed
  beginning stands for all of its longer forms;
* the arc weights, by logistic regression on the pattern counts.

Defined cases: a null or empty text has no pattern and gets the score of a text
without any match; ties between labels of one id are settled by the larger
label; ids without a label are scored like all others; unlabelled rows, language
and source never enter a score; repeated rows get equal scores; an empty label
table leaves the seed lexicon with its prior weights.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import crc_mod, map_batches, texts_of

#: Fixed seed lists, in four languages; the learned lexicon is added to them.
SEED_INSULTS = ("idiot", "moron", "scum", "imbecile", "arschloch", "dummkopf", "connard", "salaud", "gilipollas", "pendejo")
THREATS = ("kill", "murder", "strangle", "töten", "umbringen", "tuer", "égorger", "matar", "degollar")
TARGETS = ("you", "your", "u", "yourself", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "vous", "te", "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "no", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "nannte", "disait", "écrivit", "appelé", "dijo", "escribió", "llamó")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
PATTERNS = ("insult", "insult_aimed", "insult_denied", "insult_reported", "threat_aimed", "threat_denied", "threat_reported")
#: Arc weights before any label is seen; training pulls away from them.
PRIOR = np.array([3.0, 4.0, 0.5, 0.5, 3.0, 0.5, 0.5])
PRIOR_BIAS = -3.0
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:\n|…]")


class Transducer:
    """Deterministic transducer: (state, symbol) -> (state, output)."""

    def __init__(self, start: int, step: dict[tuple[int, str], tuple[int, str]]):
        self.start, self.step = start, step

    def compose(self, after: Transducer, symbols: list[str]) -> Transducer:
        """The machine that feeds this one's outputs to ``after``."""
        start, todo, name, step = (self.start, after.start), [(self.start, after.start)], {(self.start, after.start): 0}, {}
        while todo:
            a, b = todo.pop()
            for s in symbols:
                a2, mid = self.step[a, s]
                b2, out = after.step[b, mid]
                if (a2, b2) not in name:
                    name[a2, b2] = len(name)
                    todo.append((a2, b2))
                step[name[a, b], s] = (name[a2, b2], out)
        return Transducer(name[start], step)


#: Input symbols and the marks that machines add to insults and threats.
_IN = ["I", "T", "Y", "N", "R", "."]


def _reported() -> Transducer:
    mark = {"I": "I/r", "T": "T/r"}
    step = {}
    for state in (0, 1):
        for s in _IN:
            step[state, s] = (1 if state or s == "R" else 0, mark.get(s, s) if state else s)
    return Transducer(0, step)


def _within(trigger: str, reach: int, mark: str, symbols: list[str]) -> Transducer:
    """Marks insults and threats up to ``reach`` words after the trigger; those
    that carry a mark already are left alone."""
    step = {}
    for state in range(reach + 1):
        for s in symbols:
            left = reach if s == trigger else max(0, state - 1)
            step[state, s] = (left, s + mark if s in ("I", "T") and state else s)
    return Transducer(0, step)


def _emit(symbols: list[str]) -> Transducer:
    """Names the pattern; a threat without a target stays silent."""
    name = {"I": "insult", "I/y": "insult_aimed", "I/n": "insult_denied", "I/r": "insult_reported",
            "T/y": "threat_aimed", "T/n": "threat_denied", "T/r": "threat_reported"}
    return Transducer(0, {(0, s): (0, name.get(s, "")) for s in symbols})


def grammar() -> list[list[tuple[int, int]]]:
    """The composed machine as a table: [state][class] -> (state, pattern or -1)."""
    marked = _IN + ["I/r", "T/r"]
    more = marked + ["I/n", "T/n"]
    last = more + ["I/y", "T/y"]
    m = _reported().compose(_within("N", 3, "/n", marked), _IN)
    m = m.compose(_within("Y", 4, "/y", more), _IN).compose(_emit(last), _IN)
    states = 1 + max(s for s, _ in m.step)
    assert m.start == 0
    return [[(m.step[q, s][0], PATTERNS.index(p) if (p := m.step[q, s][1]) else -1) for s in _IN] for q in range(states)]


@dataclass
class Model:
    words: tuple[str, ...] = SEED_INSULTS
    stems: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(counts) @ self.weights / math.log(2) + self.bias, -40, 40)))


class Matcher:
    """Counts the grammar's patterns in texts, for one lexicon."""

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...]):
        self.table = grammar()
        self.kind: dict[str, int] = {w: k for k, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, words)) for w in ws}
        self.stems = frozenset(stems)
        self.lengths = sorted({len(s) for s in stems})
        self.find = ahocorasick.Automaton()
        for w in {*words, *THREATS, *stems}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def class_of(self, word: str) -> int:
        k = self.kind.get(word)
        if k is None:
            k = INSULT if any(word[:n] in self.stems for n in self.lengths) else OTHER
        return k

    def counts(self, text: str) -> np.ndarray:
        out = np.zeros(len(PATTERNS))
        low = text.lower()
        done = -1
        for end, n in self.find.iter(low):
            start = end - n + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            # The clause around the match, read once.
            left = start
            while left and not _CLAUSE_END.match(low[left - 1]):
                left -= 1
            m = _CLAUSE_END.search(low, end + 1)
            done = m.start() if m else len(low)
            state = 0
            for w in _WORD.finditer(low, left, done):
                state, pattern = self.table[state][self.class_of(w[0])]
                if pattern >= 0:
                    out[pattern] += 1
        return out


def _known(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, toxic) of the labels that may be learned from: held-out rows have no part in anything."""
    return labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != 0)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))


def _training_rows(docs: DataFrame, known: DataFrame, fit_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most ``fit_rows`` rows of each label; one per text."""
    place = F.xxhash64(F.lit(5), F.col(id_col))
    some = known.where("toxic = 1").orderBy(place, id_col).limit(fit_rows).unionByName(known.where("toxic = 0").orderBy(place, id_col).limit(fit_rows))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), id_col)
    return rows.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("text", "toxic")


def learn_lexicon(rows: DataFrame, clean_weight: float = 1.0, most: int = 2_000, least_share: float = 0.005, precision: float = 0.95, strong_share: float = 0.03) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, stems) found in toxic rows: counted once per row, kept when at
    least ``least_share`` of the toxic rows hold them (3 at least) and rows that
    hold them are toxic with ``precision``, where a clean row stands for
    ``clean_weight`` times the rows that a toxic one stands for; at most ``most`` of
    either, and only those that are frequent or needed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, list[int]] = {}
        for t, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
            words = set(_WORD.findall(t.lower()))
            marks = {w + "$" for w in words} | {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}
            for k in marks:
                seen.setdefault(k, [0, 0])[y] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            names=["mark", "neg", "pos"],
        )

    toxic = rows.where("toxic = 1").count()
    if not toxic:
        return SEED_INSULTS, ()
    least = max(3, math.ceil(least_share * toxic))
    counted = map_batches(rows.select("text", "toxic"), run, "mark string, neg long, pos long", rows=4096).groupBy("mark").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    good = counted.where((F.col("pos") >= least) & (F.col("pos") >= precision * (F.col("pos") + clean_weight * F.col("neg"))))
    found = {r["mark"]: r["pos"] for r in good.orderBy(F.desc("pos"), "mark").limit(most).collect()}
    stems: list[str] = []
    for s in sorted((m for m in found if not m.endswith("$")), key=lambda m: (len(m), m)):
        if any(s.startswith(t[:3]) and t.startswith(s) or s.startswith(t) for t in stems):
            continue
        # The longest beginning that says the same, or the one word behind it.
        longer = [m for m in found if m.startswith(s) and found[m] >= 0.95 * found[s]]
        best = max(longer, key=lambda m: (len(m.rstrip("$")), m))
        if not best.endswith("$"):
            stems.append(best)
    words = [m[:-1] for m in found if m.endswith("$") and not any(m.startswith(s) for s in stems)]
    return _needed(rows.where("toxic = 1"), found, words, stems, max(8, math.ceil(strong_share * toxic)))


def _needed(rows: DataFrame, found: dict[str, int], words: list[str], stems: list[str], strong: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Of the words and stems those that ``strong`` rows hold, or that explain at
    least two rows which more frequent ones don't: words that merely stand next
    to insults in copies of one text explain none."""
    marks = sorted([w + "$" for w in words] + stems, key=lambda m: (-found[m], m))
    place = {m: i for i, m in enumerate(marks)}
    lengths = sorted({len(s) for s in stems})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in texts_of(batch.column(0)):
            ws = set(_WORD.findall(t.lower()))
            out.append(sorted({place[k] for w in ws for k in (w + "$", *(w[:n] for n in lengths)) if k in place}))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["marks"])

    held: dict[int, list[int]] = {}
    for row, r in enumerate(map_batches(rows.select("text"), run, "marks array<int>").collect()):
        for m in r["marks"]:
            held.setdefault(m, []).append(row)
    covered: set[int] = set()
    kept = set()
    for i, m in enumerate(marks):
        new = [r for r in held.get(i, []) if r not in covered]
        if found[m] >= strong or len(new) >= 2:
            kept.add(m)
            covered.update(new)
    return tuple(sorted({*(m[:-1] for m in kept if m.endswith("$")), *SEED_INSULTS})), tuple(sorted(m for m in kept if not m.endswith("$")))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn lexicon and arc weights from at most ``2 * fit_rows`` labelled rows
    whose crc32(id) mod 5 is not 0."""
    known = _known(labels, id_col)
    rows = _training_rows(docs, known, fit_rows, id_col, text_col).persist()
    try:
        # The sample is drawn by label; weights bring back the shares of the table.
        shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
        drawn = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        weight = {k: shares.get(k, 1) / max(1, drawn.get(k, 0)) for k in (0, 1)}
        words, stems = learn_lexicon(rows, weight[0] / weight[1])
        pandas = _counted(rows.select("toxic", "text"), words, stems, "toxic", "text").toPandas()
    finally:
        rows.unpersist()
    model = Model(words, stems)
    if not len(pandas):
        return model
    x = np.log1p(np.array(pandas["counts"].tolist())) / math.log(2)
    y = pandas["toxic"].to_numpy()
    w = np.array([weight[0], weight[1]])[y]
    w *= len(y) / w.sum()
    theta, prior = np.append(PRIOR, PRIOR_BIAS), np.append(PRIOR, PRIOR_BIAS)
    x1 = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(len(PRIOR), 1.0), 1e-3)
    for _ in range(40):  # Newton steps towards the penalised optimum
        p = 1 / (1 + np.exp(-np.clip(x1 @ theta, -30, 30)))
        grad = x1.T @ (w * (p - y)) + ridge * (theta - prior)
        hess = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
        theta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.weights, model.bias = np.maximum(theta[:-1], 0), float(theta[-1])
    return model


def _counted(rows: DataFrame, words: tuple[str, ...], stems: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _matcher(words, stems)
        counts = [m.counts(t) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.float64()))], names=[id_col, "counts"])

    kind = rows.schema[id_col].dataType.simpleString()
    return map_batches(rows.select(id_col, text_col), run, f"`{id_col}` {kind}, counts array<double>")


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(words: tuple[str, ...], stems: tuple[str, ...]) -> Matcher:
    """One matcher per worker process and lexicon."""
    if (words, stems) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[words, stems] = Matcher(words, stems)
    return _MATCHERS[words, stems]


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score column added; all rows and columns stay."""
    fields = docs.schema.fields
    if any(f.name == score_col for f in fields):
        raise ValueError(f"the input has a column {score_col}")
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _matcher(model.words, model.stems)
        counts = np.array([m.counts(t) for t in texts_of(batch.column(at))])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(counts), pa.float64())], names=[*batch.schema.names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_batches(docs, run, f"{schema}, `{score_col}` double")

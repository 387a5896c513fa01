"""Secret scan: exact patterns plus a character convolutional network.

Three exact patterns (assignments, access keys, long hex runs) give the base
findings of every whole text; they always stay.  Every further candidate, a run
of key characters as long as the shortest assigned value, is scored together
with its surrounding characters by a small convolutional network in numpy:

* input: 16 characters before, the candidate, 8 after; a candidate longer than
  the window is read in windows that cover it whole, and its best one counts;
* one convolution (width 5) over symbol weights, rectified; its maximum and mean
  over places; one dense layer; logistic loss, Adam, fixed seed;
* training set: the candidates of all documents, labelled by the exact patterns.
  Found ones also enter with the context of a place ``AWAY`` characters further
  out, so that the shape of the key itself is learned as well.  A found assignment
  enters by its value; its name is in neither label;
* training begins with at most ``max_per_class`` windows of each label (by a
  digest; others than found ones from about ``fit_docs`` documents): they only
  give the weights to start from.  Then documents are dealt by a digest to shards
  of about ``SHARD`` characters.  Each goes on from the start over all its distinct
  windows, and the network's weights are the mean of all shards';
* a fifth of the windows, by a digest, trains nothing.  All of it calibrates the
  scores (Platt scaling) and sets the threshold: the highest one that keeps
  ``min_recall`` of the held-out findings and has a probability of at least
  ``min_probability``.  Scores are counted there by steps of 1 / ``STEPS``.

The fitted model is a few thousand numbers; it travels with the tasks' closure.

Defined cases: null texts count as empty; a document without findings has empty
spans; offsets are code points, ends exclusive; repeated rows give repeated
results; when there are fewer than ``LEAST`` findings or other candidates, there
is nothing to learn from and only base findings are returned; columns other than
id and text are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import map_batches, map_sorted_groups, mix64, texts_of

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A candidate, and an assigned value: at least this many key characters in a row.
SHORTEST = 8
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
#: Which symbols are key characters.
_KEY = np.array([_CANDIDATE.fullmatch(chr(c) * SHORTEST) is not None for c in range(128)], np.int8)
LEFT, BODY, RIGHT = 16, 48, 8
WIDTH, FILTERS, SYMBOLS = 5, 24, 256
LEAST = 8
#: Candidates of a text that are scored at a time.
PIECE = 4096
AWAY = 40
#: Characters of a shard; windows of a training step, and found ones beside them; least steps of a shard.
SHARD, BATCH, BESIDE, LEAST_STEPS = 4 << 20, 512, 64, 200
#: Windows in the network at a time: what they make there fits the processor's cache.
ROWS = 128
#: Positions of a symbol that are added up side by side.
GROUP = 16
#: A fifth of the windows is held out.
FOLDS = 5
#: Steps of a raw score in the calibration, and weights as whole numbers.
STEPS, UNIT = 256, 2.0**30


def base_spans(text: str, longest: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns, by start, then by kind.  ``longest``:
    length of the text's longest candidate, if known; each finding holds one."""
    found: list[tuple[int, int, str]] = []
    if longest is not None and longest < SHORTEST:
        return found
    low = text.lower()
    if [w for w in _WORDS if w in low]:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest is None or longest >= 32:
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return list(map(tuple, _runs(_symbols(text)).tolist()))


def _runs(symbols: np.ndarray) -> np.ndarray:
    """Start and end of the candidates, in order: what ``_CANDIDATE`` finds."""
    key = np.zeros(len(symbols) + 2, np.int8)
    key[1:-1] = _KEY[symbols]
    edges = np.flatnonzero(key[1:] != key[:-1]).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= SHORTEST]


def _longest(runs: np.ndarray) -> int:
    return int((runs[:, 1] - runs[:, 0]).max(initial=0))


def value_start(text: str, span: tuple[int, int, str]) -> int:
    """Where the key itself begins in a base finding."""
    start, end, kind = span
    return _ASSIGN.match(text, start, end).start(2) if kind == "assign" else start


def windows(text: str, start: int, end: int, away: int = 0) -> np.ndarray:
    """Symbol codes of the windows that cover text[start:end]; ``away`` takes
    their context from so many characters further out."""
    return _windows(_symbols(text), [(start, end)], away)[0]


def _symbols(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.maximum(np.minimum(raw, np.uint32(127)).astype(np.uint8), np.uint8(1))


def _windows(symbols: np.ndarray, spans: list[tuple[int, int]], away: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all ``spans``, and the first one of each."""
    start, end = np.asarray(spans, dtype=np.int64).reshape(-1, 2).T
    per = -((start - end) // BODY)
    first = np.cumsum(per) - per
    at = np.repeat(start, per) + BODY * (np.arange(per.sum()) - np.repeat(first, per))
    size = np.minimum(np.repeat(end, per) - at, BODY)
    # Beyond the text lies padding, so every window can be read whole.
    padded = np.zeros(len(symbols) + 2 * (LEFT + BODY + RIGHT + away), np.uint8)
    padded[LEFT + BODY + RIGHT + away:][:len(symbols)] = symbols
    rows = np.ndarray((len(padded) - (LEFT + BODY + RIGHT) + 1, LEFT + BODY + RIGHT), np.uint8, padded, strides=(1, 1))
    at += BODY + RIGHT + away
    if not away:
        return rows[at] & _SEEN[size] | _INSIDE[size] & np.uint8(128), first
    inside = _INSIDE[size]
    outside = np.concatenate([rows[at - away][:, :LEFT], rows[at + away][:, LEFT:]], 1)
    return np.where(inside, rows[at] | np.uint8(128), outside & _SEEN[size]), first


_PLACE = np.arange(-LEFT, BODY + RIGHT)[None, :]
_SIZE = np.arange(BODY + 1)[:, None]
#: By the size of a window's part of the candidate: 255 where it is, and 255 where the window shows anything.
_INSIDE = np.where((_PLACE >= 0) & (_PLACE < _SIZE), 255, 0).astype(np.uint8)
_SEEN = np.where(_PLACE < _SIZE + RIGHT, 255, 0).astype(np.uint8)


@dataclass
class CharCnn:
    conv: np.ndarray  # (WIDTH, SYMBOLS, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # 2 * FILTERS
    offset: float
    scale: float = 1.0  # Platt scaling of the raw score
    shift: float = 0.0
    threshold: float = 0.5

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        """Windows x places x filters.  In memory the places come first: maxima and
        sums over them then run along whole rows."""
        n = x.shape[1] - WIDTH + 1
        codes = x.T.astype(np.intp, order="C")
        out = np.take(self.conv[0] + self.bias, codes[:n], axis=0)
        one = np.empty_like(out)
        for k in range(1, WIDTH):
            out += np.take(self.conv[k], codes[k:k + n], axis=0, out=one, mode="clip")
        one[:] = 0
        return np.maximum(out, one, out=out).transpose(1, 0, 2)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores; the padding at a window's end is the same at every place, so
        it is not computed again for each."""
        places = x.shape[1] - WIDTH + 1
        blank = np.maximum(self.conv[:, 0].sum(0) + self.bias, 0)
        used = x.shape[1] - (x[:, ::-1] != 0).argmax(1)
        out = np.zeros(len(x))
        order = np.argsort(used, kind="stable")
        for i in range(0, len(x), ROWS):
            at = order[i:i + ROWS]
            n = min(places, int(used[at[-1]]))
            h = self._hidden(x[at, :n + WIDTH - 1])
            top, total = h.max(1), h.sum(1) + (places - n) * blank
            if n < places:
                top = np.maximum(top, blank)
            out[at] = np.concatenate([top, total / places], 1) @ self.dense + self.offset
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -40, 40)))


#: The network's weights.
PARTS = ("conv", "bias", "dense", "offset")


def _gradient(net: CharCnn, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted logistic losses' sum; padding at the windows' ends
    is taken together, as in ``raw``."""
    places = x.shape[1] - WIDTH + 1
    n = min(places, x.shape[1] - int((x[:, ::-1] != 0).any(0).argmax()))
    blank = np.maximum(net.bias, 0)
    h = net._hidden(x[:, :n + WIDTH - 1]).transpose(1, 0, 2)
    top = h.max(0)
    ahead = top >= blank if n < places else np.ones_like(top, dtype=bool)
    pooled = np.concatenate([np.where(ahead, top, blank), (h.sum(0) + (places - n) * blank) / places], 1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.dense + net.offset, -40, 40)))
    g = ((p - y) * weight).astype(np.float32)
    gp = g[:, None] * net.dense[None, :].astype(np.float32)
    most, mean = gp[:, :FILTERS], gp[:, FILTERS:] / np.float32(places)
    # The first place of each maximum; 255: nowhere above zero.
    place = np.negative((h != np.where(top > 0, top, np.inf).astype(h.dtype)).view(np.uint8))
    first = np.bitwise_or(place, np.arange(n, dtype=np.uint8)[:, None, None], out=place).min(0).reshape(-1)
    # Places of zeros before and behind, for symbols that fewer places read.
    rows = len(x)
    gh = np.zeros((n + 3 * WIDTH, rows, FILTERS), np.float32)
    inner = gh[WIDTH - 1:WIDTH - 1 + n]
    np.multiply(h > 0, mean, out=inner)
    cell = np.flatnonzero(first < 255)
    inner.reshape(-1)[first[cell].astype(np.intp) * top.size + cell] += (most * ahead).reshape(-1)[cell]
    # The symbol at place s is read by the places s - WIDTH + 1 to s.
    seen, groups, begin = _by_symbol(x[:, :n + WIDTH - 1].T.reshape(-1), (n + 2 * WIDTH - 1) * rows)
    conv = np.zeros_like(net.conv, dtype=np.float32)
    flat, part = gh.reshape(-1, FILTERS), np.empty((*groups.shape, FILTERS), np.float32)
    for k in range(WIDTH):
        np.take(flat, groups + (WIDTH - 1 - k) * rows, axis=0, out=part, mode="clip")
        conv[k, seen] = np.add.reduceat(part.sum(0), begin, axis=0)
    every = conv[0].sum(0)
    conv[:, 0, :] = 0
    bias = every + (blank > 0) * ((places - n) * mean.sum(0) + (most * ~ahead).sum(0))
    return {"conv": conv, "bias": bias, "dense": pooled.T @ g, "offset": np.float32(g.sum())}


def _by_symbol(codes: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols that occur, their positions in columns of ``GROUP``, where each one's
    columns begin); what is left of a symbol's last column is ``blank``."""
    many = np.bincount(codes, minlength=SYMBOLS)
    seen = np.flatnonzero(many)
    many = many[seen]
    columns = -(-many // GROUP)
    begin = np.cumsum(columns) - columns
    groups = np.full(columns.sum() * GROUP, blank)
    groups[np.arange(len(codes)) + np.repeat(begin * GROUP - (np.cumsum(many) - many), many)] = np.argsort(codes, kind="stable")
    return seen, np.ascontiguousarray(groups.reshape(-1, GROUP).T), begin


def _label_gradient(net: CharCnn, x: np.ndarray, label: int) -> dict[str, np.ndarray]:
    """Gradient of a step's windows of one label, which have half its weight, some at a time."""
    each = [_gradient(net, part, np.full(len(part), float(label)), np.full(len(part), 0.5 / len(x))) for part in (x[i:i + ROWS] for i in range(0, len(x), ROWS))]
    return {k: sum(g[k] for g in each) for k in PARTS}


class _Adam:
    def __init__(self, net: CharCnn, rate: float):
        self.rate, self.step = rate, 0
        self.state = {k: [np.zeros_like(getattr(net, k), dtype=np.float32) for _ in range(2)] for k in PARTS}

    def __call__(self, net: CharCnn, grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        grad = grad | {"conv": grad["conv"] + 1e-4 * net.conv, "dense": grad["dense"] + 1e-3 * net.dense}
        for name in PARTS:
            m, v = self.state[name]
            m[...] = 0.9 * m + 0.1 * grad[name]
            v[...] = 0.999 * v + 0.001 * grad[name] * grad[name]
            move = self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            setattr(net, name, getattr(net, name) - move)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> CharCnn:
    """Logistic loss with class weights, Adam; x: codes, y: 0 or 1."""
    rng = np.random.default_rng(seed)
    net = CharCnn(rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0)
    net.conv[:, 0, :] = 0  # padding
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    adam = _Adam(net, rate)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            at = order[i:i + batch]
            adam(net, _gradient(net, x[at], y[at], weight[at] / len(at)))
    return net


def train_on(start: CharCnn, others: np.ndarray, found: np.ndarray, rate: float = 1e-3) -> CharCnn:
    """``start`` after all of ``others`` (label 0) and ``found`` (label 1), each at
    least once; a step takes both labels in equal weight."""
    net = CharCnn(*(np.float32(getattr(start, k)).copy() for k in PARTS))
    if not (len(others) and len(found)):
        return net
    # Windows of like length share a step, which then skips their padding.
    used = others.shape[1] - (others[:, ::-1] != 0).argmax(1)
    others = others[np.argsort(used, kind="stable")]
    steps = max(1, -(-len(others) // BATCH), -(-len(found) // BESIDE))
    rounds = max(1, LEAST_STEPS // steps)
    adam, rng = _Adam(net, rate), np.random.default_rng(7)
    cut = np.linspace(0, len(others), steps + 1).astype(np.int64)
    turn = 0
    for _ in range(rounds):
        for i in rng.permutation(steps):
            none = others[cut[i]:cut[i + 1]] if cut[i] < cut[i + 1] else others[rng.integers(0, len(others), BATCH)]
            some = found[(turn + np.arange(min(BESIDE, len(found)))) % len(found)]
            turn += BESIDE
            a, b = _label_gradient(net, none, 0), _label_gradient(net, some, 1)
            adam(net, {k: a[k] + b[k] for k in PARTS})
    return net


def calibrate(net: CharCnn, raw: np.ndarray, y: np.ndarray, n: np.ndarray, min_recall: float, min_probability: float) -> CharCnn:
    """Platt scaling by Newton steps, then the recall-constrained threshold; ``n``
    windows have the raw score ``raw`` and the label ``y``."""
    a, b = 1.0, 0.0
    ones, zeros = n[y == 1].sum(), n[y == 0].sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w = n * (p * (1 - p) + 1e-9)
        grad = np.array([(n * (p - goal) * raw).sum() + 1e-3 * (a - 1), (n * (p - goal)).sum()])
        hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(1e-3, a - move[0]), b - move[1]
    net.scale, net.shift = float(a), float(b)
    order = np.flatnonzero(y == 1)[np.argsort(raw[y == 1], kind="stable")]
    if len(order):
        lowest = raw[order[np.searchsorted(np.cumsum(n[order]), int(np.floor((1 - min_recall) * ones)), side="right")]]
        net.threshold = max(min_probability, float(1 / (1 + np.exp(-np.clip(a * lowest + b, -40, 40)))))
    else:
        net.threshold = max(min_probability, 1.0)
    return net


def digest(codes: np.ndarray) -> np.ndarray:
    """64-bit digests of windows."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(0, codes.shape[1], 8):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(codes[:, k:k + 8]).view(np.uint64)[:, 0] + np.uint64(k))
    return out


def labelled(text: str, others: bool = True):
    """(windows, label) of a text's candidates, piece by piece; without ``others``
    only those that the exact patterns found."""
    symbols = _symbols(text)
    runs = _runs(symbols)
    base = base_spans(text, _longest(runs))
    if not (base or others):
        return
    values = sorted((value_start(text, b), b[1]) for b in base)
    named: tuple[list | np.ndarray, list] = ([] if base else runs, [])
    for s, e in runs.tolist() if base else ():
        y = int(_overlaps(s, e, values))
        if y or (others and not _overlaps(s, e, base)):
            named[y].append((s, e))
    for i in range(0, len(named[0]), PIECE):
        yield _windows(symbols, named[0][i:i + PIECE])[0], 0
    for i in range(0, len(named[1]), PIECE):
        for away in (0, AWAY):
            codes, first = _windows(symbols, named[1][i:i + PIECE], away)
            yield codes[first], 1


def _distinct(texts: list[str], held: bool | None) -> list[np.ndarray]:
    """Distinct windows of each label, by their digest: held-out ones, others (False) or all (None)."""
    parts: tuple[list, list] = ([], [])
    for t in texts:
        for codes, y in labelled(t):
            parts[y].append(codes)
    out = []
    for part in parts:
        codes = np.concatenate([np.zeros((0, LEFT + BODY + RIGHT), np.uint8), *part])
        mark, at = np.unique(digest(codes), return_index=True)
        out.append(codes[at if held is None else at[(mark % np.uint64(FOLDS) == 0) == held]])
    return out


def _overlaps(start: int, end: int, spans: list[tuple]) -> bool:
    """Whether one of ``spans``, ordered by start, overlaps start to end."""
    at = bisect.bisect_left(spans, (end,))
    return any(s[1] > start for s in spans[:at])


def _keep(least: dict[str, bytes], codes: np.ndarray, most: int) -> None:
    """Put windows under their digests; of more than twice ``most`` the least stay."""
    for code in codes:
        raw = code.tobytes()
        least[hashlib.md5(raw).hexdigest()] = raw
    if len(least) > 2 * most:
        for mark in sorted(least)[most:]:
            del least[mark]


def fit(docs: DataFrame, fit_docs: int = 40_000, max_per_class: int = 4_000, min_recall: float = 0.95, min_probability: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> CharCnn | None:
    """Fit on the candidates of all documents; training starts from at most
    ``max_per_class`` of each label, others than found ones from about ``fit_docs``
    documents.  None when there is too little to learn."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.length(text_col).cast("long")).alias("chars")).first()
    share = min(1.0, fit_docs / max(1, size["rows"]))
    place = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), F.lit(1_000_000))
    rows = docs.select(F.col(text_col).alias("text"), (place < math.ceil(share * 1_000_000)).alias("others"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        least: dict[int, dict[str, bytes]] = {0: {}, 1: {}}
        for t, others in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
            for codes, y in labelled(t, others):
                _keep(least[y], codes, max_per_class)
        out = [(c, y, m) for y in (0, 1) for m, c in sorted(least[y].items())[:max_per_class]]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.string()))], names=["code", "y", "mark"])

    found = map_batches(rows, run, "code binary, y int, mark string").dropDuplicates(["mark", "y"])
    found = found.persist()
    try:
        sizes = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
        # A task sends its first rows to the driver.  Digests are spread evenly: below
        # this limit lie about twice the rows that are asked for, over all tasks.
        limits = {y: math.ceil(2**32 * (2 * max_per_class + 100) / n) for y, n in sizes.items()}
        place = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
        rows = [r for y in sorted(limits) for r in found.where((F.col("y") == y) & (place < limits[y])).orderBy("mark").limit(max_per_class).collect()]
    finally:
        found.unpersist()
    y = np.array([r["y"] for r in rows])
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return None
    x = np.array([np.frombuffer(r["code"], dtype=np.uint8) for r in rows])
    held = digest(x) % np.uint64(FOLDS) == 0
    # With too few held-out windows of a label all train, and all calibrate.
    apart = min((y[held] == 0).sum(), (y[held] == 1).sum()) >= 2
    learn = ~held if apart else np.ones(len(y), dtype=bool)
    start = train(x[learn], y[learn])
    net = _train_on_all(docs, start, x[learn & (y == 1)], False if apart else None, 1 + (size["chars"] or 0) // SHARD, id_col, text_col)
    return calibrate(net, *_scores(docs, net, True if apart else None, text_col), min_recall, min_probability)


def _train_on_all(docs: DataFrame, start: CharCnn, known: np.ndarray, held: bool | None, shards: int, id_col: str, text_col: str) -> CharCnn:
    """The mean of the networks that the shards make of ``start``; ``known``: some
    found windows, for shards that have few."""
    shard = F.pmod(F.xxhash64(F.lit(13), F.col(id_col), F.col(text_col)), F.lit(shards))
    texts = docs.where(F.length(text_col) >= SHORTEST).select(shard.alias("shard"), F.col(text_col).alias("text"))

    def learn(group: pa.Table) -> pa.RecordBatch:
        others, found = _distinct(group.column("text").to_pylist(), held)
        found = np.concatenate([found, known])
        net = train_on(start, others, found[np.argsort(digest(found), kind="stable")])
        # Whole numbers add up to the same in any order.
        flat = np.rint(np.concatenate([np.ravel(getattr(net, k)).astype(float) for k in PARTS]) * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.int64()))], names=["weights"])

    each = map_sorted_groups(texts, ["shard"], learn, "weights array<long>")
    # One row for each weight of the network.
    total = each.select(F.posexplode("weights").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.count("*").alias("n")).toPandas().sort_values("at")
    flat = total["v"].to_numpy(dtype=float) / total["n"].to_numpy(dtype=float) / UNIT
    net = CharCnn(start.conv, start.bias, start.dense, start.offset)
    at = 0
    for k in PARTS:
        shape = np.shape(getattr(start, k))
        many = int(np.prod(shape, dtype=np.int64))
        part = flat[at:at + many].reshape(shape).astype(np.float32)
        setattr(net, k, part if shape else float(part))
        at += many
    return net


def _scores(docs: DataFrame, net: CharCnn, held: bool | None, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw score rounded down, label, number of windows) of all held-out windows, or all windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [np.unique(np.floor(np.clip(net.raw(codes), -100, 100) * STEPS).astype(np.int64), return_counts=True) for codes in _distinct(texts_of(batch.column(0)), held)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[0] for o in out])), pa.array(np.repeat([0, 1], [len(o[0]) for o in out]).astype(np.int32)), pa.array(np.concatenate([o[1] for o in out]))],
            names=["step", "y", "n"],
        )

    # At most 200 * STEPS rows of each label.
    rows = map_batches(docs.select(text_col), run, "step long, y int, n long").groupBy("step", "y").agg(F.sum("n").alias("n")).toPandas().sort_values(["y", "step"])
    return rows["step"].to_numpy(dtype=float) / STEPS, rows["y"].to_numpy(), rows["n"].to_numpy(dtype=float)


def scan_text(text: str, net: CharCnn | None) -> list[tuple[int, int, str]]:
    """Base findings and, by the network, further ones that overlap none of them."""
    return scan_texts([text], net)[0]


def scan_texts(texts: list[str], net: CharCnn | None) -> list[list[tuple[int, int, str]]]:
    """The findings of each text; windows of many texts are scored at a time."""
    if net is None:
        return [base_spans(t) for t in texts]
    out: list[list] = []
    waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    added: list[list] = [[] for _ in texts]

    def score() -> None:
        if not waiting:
            return
        p = net.probability(np.concatenate([codes for _, _, codes, _ in waiting]))
        at = 0
        for row, piece, codes, first in waiting:
            best = np.maximum.reduceat(p[at:at + len(codes)], first)
            added[row] += [(s, e, "model") for s, e in piece[best >= net.threshold].tolist()]
            at += len(codes)
        waiting.clear()

    held = 0
    for row, text in enumerate(texts):
        symbols = _symbols(text)
        more = _runs(symbols)
        base = base_spans(text, _longest(more))
        out.append(base)
        if base:
            more = np.array([(s, e) for s, e in more.tolist() if not _overlaps(s, e, base)], dtype=np.int64).reshape(-1, 2)
        for i in range(0, len(more), PIECE):
            piece = more[i:i + PIECE]
            waiting.append((row, piece, *_windows(symbols, piece)))
            held += len(waiting[-1][2])
            if held >= PIECE:
                score()
                held = 0
    score()
    return [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]))) for b, m in zip(out, added)]


def scan(docs: DataFrame, net: CharCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, end, kind>>) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"start": s, "end": e, "kind": k} for s, e, k in found] for found in scan_texts(texts_of(batch.column(1)), net)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, spans array<struct<start:int,end:int,kind:string>>")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base findings, and all spans as text."""
    text = "concat_ws(':', s.kind, s.start, s.end)"

    def count(kind: str):
        return F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)")

    base = f"array_join(transform(filter(spans, s -> s.kind != 'model'), s -> {text}), ',')"
    return scanned.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(f"array_join(transform(spans, s -> {text}), ',')").alias("spans"),
        count("model").alias("n_model"),
    )

"""Approximate nearest neighbours by learned partitions.

* A bounded sample of the rows (``sample_rows``, chosen by digest) gives a
  neighbour graph: each vector's nearest by inner product.
* The graph is cut into equal parts by recursive bisection: a spectral split at
  the median, refined by swapping pairs of vertices that lower the cut.
* A small network (one hidden layer) learns, from the vector, which parts hold
  its neighbours.  Every row of the table is filed under its most probable part.
* A query goes to its most probable parts; all rows of those are ranked again by
  the exact inner product in double precision.
* How many parts are tried is measured: a bounded set of probe vectors is ranked
  against all rows, and the least number of parts that finds ``target_recall``
  of their true neighbours is taken.

The number of parts grows with the square root of the rows, so that routing and
ranking grow alike.  A part may still hold a third of all rows: parts are split into blocks of ``BLOCK`` rows
and queries into blocks of ``QUERIES``; each pair of blocks is one group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as queries nor as candidates; vectors of
different length are never compared; a query is compared with every row of
another id (a repeated row is a candidate of its own; a row of the query's id
never is); ties go to the smaller id; tables of up to ``part_rows`` rows are one
part, which makes the search exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm.common import map_batches, map_sorted_groups, matrix, staged, usable

BLOCK, QUERIES = 4096, 1024
HIDDEN = 64


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest other rows of each row by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(src: np.ndarray, dst: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 40, swaps: int = 8) -> np.ndarray:
    """0 or 1 for each vertex, halves of equal size with few edges across.
    Edges come in both directions."""
    degree = np.bincount(src, minlength=n) + 1e-9
    root = np.sqrt(degree)
    flat = root / np.linalg.norm(root)
    v = rng.normal(size=n)
    for _ in range(rounds):  # second eigenvector by deflated power steps
        v -= flat * (flat @ v)
        v = v / (np.linalg.norm(v) + 1e-12)
        v = v + np.bincount(src, weights=(v / root)[dst], minlength=n) / root
    side = np.zeros(n, dtype=np.int64)
    side[np.argsort(v / root, kind="stable")[n // 2:]] = 1
    for _ in range(swaps):
        other = np.bincount(src, weights=side[src] != side[dst], minlength=n)
        gain = 2 * other - degree
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        good = int(np.count_nonzero(gain[a[:m]] + gain[b[:m]] > 0))
        take = min(good, max(1, n // 50))
        if not good:
            break
        before = np.count_nonzero(side[src] != side[dst])
        side[a[:take]], side[b[:take]] = 1, 0
        if np.count_nonzero(side[src] != side[dst]) >= before:
            side[a[:take]], side[b[:take]] = 0, 1
            break
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Part of each vertex; ``parts`` is a power of two."""
    rng = np.random.default_rng(seed)
    n = len(graph)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, dtype=np.int64)
    for _ in range(int(math.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            where = np.full(n, -1)
            where[own] = np.arange(len(own))
            keep = (part[src] == p) & (part[dst] == p)
            new[own] += _bisect(where[src[keep]], where[dst[keep]], len(own), rng)
        part = new
    return part


@dataclass
class Router:
    """A network with one hidden layer: vector -> scores of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        if self.parts == 1:
            return np.zeros((len(x), 1), dtype=np.int64)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.argsort(-(np.maximum(u @ self.w1 + self.b1, 0) @ self.w2 + self.b2), axis=1, kind="stable")


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 5) -> Router:
    """Cross-entropy against the parts of each vector and its neighbours."""
    rng = np.random.default_rng(seed)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, n = x.shape[1], len(x)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.arange(n), part), 1.0)
    np.add.at(goal, (np.repeat(np.arange(n), graph.shape[1]), part[graph.reshape(-1)]), 1.0)
    goal /= goal.sum(1, keepdims=True)
    p = [rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)) * math.sqrt(d) / 2, np.zeros(HIDDEN), rng.normal(0, math.sqrt(2 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            at = order[i:i + batch]
            h = np.maximum(u[at] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            e = np.exp(s - s.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - goal[at]) / len(at)
            gh = (g @ p[2].T) * (h > 0)
            step += 1
            for j, grad in enumerate((u[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                p[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


@dataclass
class Index:
    dim: int
    router: Router
    probes: int
    filed: DataFrame  # rid, vec_id, x, part
    measured: float  # recall of the probe vectors


def _sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    got = rows.orderBy(F.xxhash64(F.lit(seed), "x"), "rid").limit(n).select("x").collect()
    return np.array([r["x"] for r in got], dtype=np.float64)


def _top(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row of scores; ties to the smaller id."""
    if len(s) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= cut)
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))][:k]


def build(rows: DataFrame, dim: int, total: int, k: int = 20, part_rows: int = 1024, max_parts: int = 1024, sample_rows: int = 8192,
          probe_rows: int = 200, target_recall: float = 0.96) -> Index:
    """``rows``: rid, vec_id, x, all of length ``dim``; ``total`` of them."""
    parts = 1
    while total > part_rows and parts * 2 <= min(max_parts, math.sqrt(total) / 12):
        parts *= 2
    if parts == 1:
        router = Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    else:
        x = _sample(rows, sample_rows, 1)
        graph = neighbour_graph(x, 10)
        router = train_router(x, balanced_parts(graph, parts), graph, parts)

    def file(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = router.ranked(matrix(batch.column(2), dim))[:, 0]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["rid", "vec_id", "x", "part"])

    kind = rows.schema["x"].dataType.simpleString()
    filed = staged(map_batches(rows.select("rid", "vec_id", "x"), file, f"rid long, vec_id long, x {kind}, part long"))
    probes, measured = (1, 1.0) if parts == 1 else _measure(filed, router, dim, k, _sample(rows, probe_rows, 2), target_recall)
    return Index(dim, router, probes, filed, measured)


def _measure(filed: DataFrame, router: Router, dim: int, k: int, probe: np.ndarray, target: float) -> tuple[int, float]:
    """Least number of parts with the target recall, over all rows."""

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, rid, part = matrix(batch.column(1), dim), batch.column(0).to_numpy(), batch.column(2).to_numpy()
        s = probe @ x.T
        q, at = [], []
        for i, row in enumerate(s):
            top = _top(row, rid, k + 1)
            q.append(np.full(len(top), i))
            at.append(top)
        q, at = np.concatenate(q), np.concatenate(at)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(s[q, at]), pa.array(part[at])], names=["q", "s", "part"])

    w = Window.partitionBy("q").orderBy(F.desc("s"))
    found = map_batches(filed.select("rid", "x", "part"), best, "q long, s double, part long").withColumn("r", F.row_number().over(w))
    found = found.where((F.col("r") > 1) & (F.col("r") <= k + 1)).select("q", "part").toPandas()  # without the probe itself
    place = np.argsort(router.ranked(probe), axis=1, kind="stable")
    need = place[found["q"].to_numpy(), found["part"].to_numpy()] + 1
    for probes in range(1, router.parts + 1):
        if (recall := float((need <= probes).mean())) >= target:
            break
    return probes, recall


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each of ``queries`` (vec_id, x)."""
    router, probes, dim = index.router, index.probes, index.dim

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = router.ranked(matrix(batch.column(1), dim))[:, :probes]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(parts), pa.list_(pa.int64()))], names=["rid", "parts"])

    queries = queries.select("rid", "vec_id", "x")
    routed = map_batches(queries.select("rid", "x"), route, "rid long, parts array<long>").select("rid", F.explode("parts").alias("part"))
    routed = staged(routed.join(queries, "rid"))
    load = routed.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks"))
    stock = index.filed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("x_blocks"))
    # One row for each part: at most the parameter max_parts of build().
    blocks = F.broadcast(load.join(stock, "part"))

    def dealt(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        return (
            df.join(blocks, "part")
            .withColumns({f"{own[0]}b": F.pmod(F.xxhash64("rid"), F.col(own)).cast("int"), f"{other[0]}b": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
            .select("part", "xb", "qb", F.lit(kind).alias("kind"), "rid", "vec_id", "x")
        )

    both = dealt(index.filed, "x_blocks", "q_blocks", 0).unionByName(dealt(routed, "q_blocks", "x_blocks", 1))

    def rank(group: pa.Table) -> pa.RecordBatch:
        kind, ids, rid = (group.column(c).to_numpy() for c in ("kind", "vec_id", "rid"))
        x = matrix(group.column("x"), dim)
        rows, asked = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        out: list[tuple] = []
        for a in range(0, len(asked), 256):
            at = asked[a:a + 256]
            s = x[at] @ x[rows].T
            for i, row in zip(at, s):
                other = np.flatnonzero(rid[rows] != rid[i])  # other rows of the same id stay
                top = other[_top(row[other], ids[rows[other]], k)]
                out.append((np.full(len(top), rid[i]), np.full(len(top), ids[i]), ids[rows[top]], row[top]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rid", "query_id", "vec_id", "score"])

    found = map_sorted_groups(both, ["part", "xb", "qb"], rank, "rid long, query_id long, vec_id long, score double")
    w = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **build_options) -> DataFrame:
    """The ``k`` nearest found rows of every row that ``is_query`` (a condition
    on vec_id) selects; one index for each vector length in the table."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where(F.col("vec_id").isNotNull() & usable("x"))
    rows = staged(rows.withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("x")}))
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy("dim").count().orderBy("dim").collect():
        same = rows.where(F.col("dim") == r["dim"])
        index = build(same, r["dim"], r["count"], k, **build_options)
        out = out.unionByName(search(index, same.where(is_query), k))
    return out

"""Embedding near-duplicates by spherical-cap filters.

Every vector is mapped to the filter directions it comes close to; only vectors
of one label that share a filter are compared, by the exact cosine in double
precision.

The directions form a random product code: after a fixed random rotation a
vector is cut in two halves, each half has a code book of random directions, and
a filter is a pair of code words.  Its inner product with a vector is the sum of
two table entries, so all filters above the threshold are listed from the two
sorted tables without trying every pair (list decoding).  ``codes`` such codes
with rotations and books of their own are used.  The threshold is the point of
the sphere's own distribution that a vector exceeds for ``per_vector`` filters on
average over all codes; a vector always has its ``least`` best filters of each
code as well, even below the threshold, so none is left without.  The number of
filters grows with the rows, so lists stay of about ``list_rows`` rows.

Equal vectors of a label are one node with a multiplicity.  A list of more than
``CHUNK`` nodes is split into chunks, and each pair of chunks is its own group,
so no group is unbounded.  Inside a group the products are one matrix product;
pairs are never written: each node's number of new links is added up (a pair
counts in its first common filter only) and the group's connected parts are
reported as one row a node.

Defined cases: null, empty, zero vectors and those with null or non-finite
components, and rows without a label, link with nothing; vectors of different
length never link; labels of any type are compared by a 64-bit digest; vectors of up to four components share a single filter, so
they are compared exactly; repeated rows count as separate rows; a null id never
names a class unless the class has no other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import map_batches, map_sorted_groups, matrix, staged, usable
from ledgerfold.llm.graph import components

#: Most nodes of one side of a group.
CHUNK = 512
#: Vectors of up to so many components are compared exactly.
EXACT_DIM = 4


class ProductCode:
    """Filters of vectors of one length: code words (i, j) of two books."""

    def __init__(self, dim: int, words: int, per_vector: float, number: int = 0):
        rng = np.random.default_rng([1000 + dim, number] if number else 1000 + dim)
        self.words = words
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cut = (dim + 1) // 2
        self.books = []
        for part in (self.cut, dim - self.cut):
            c = rng.normal(size=(words, part))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(part / dim))
        self.threshold = cap_height(dim, min(0.5, per_vector / words**2))

    def decode(self, unit: np.ndarray, least: int = 0) -> list[np.ndarray]:
        """Ascending filter numbers of each row of ``unit``: all above the
        threshold, and the ``least`` best ones in any case."""
        turned = unit @ self.rotation
        s1, s2 = turned[:, :self.cut] @ self.books[0].T, turned[:, self.cut:] @ self.books[1].T
        o2 = np.argsort(-s2, axis=1, kind="stable")
        out = []
        for a, b, order in zip(s1, s2, o2):
            down = b[order]
            rows = np.flatnonzero(a + down[0] >= self.threshold)
            # How many words of the second book reach the threshold with each.
            n = np.searchsorted(-down, a[rows] - self.threshold, side="right")
            if n.sum() < least:
                # The best pairs are made of the best words of each book.
                first, second = np.argsort(-a, kind="stable")[:least], order[:least]
                best = np.argsort(-(a[first][:, None] + b[second]).ravel(), kind="stable")[:least]
                out.append(np.sort(first[best // len(second)] * self.words + second[best % len(second)]))
            else:
                out.append(np.sort(np.concatenate([i * self.words + order[:k] for i, k in zip(rows, n)])) if len(rows) else np.zeros(0, np.int64))
        return out


def cap_height(dim: int, share: float) -> float:
    """t so that a random unit vector's first component is at least t with
    probability ``share``."""
    t = np.linspace(-1, 1, 200_001)
    with np.errstate(divide="ignore"):
        density = np.maximum(1 - t * t, 0) ** ((dim - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-tail / tail[0], -share)])


_CODES: dict[tuple, ProductCode] = {}


def _code(dim: int, words: int, per_vector: float, number: int) -> ProductCode:
    key = (dim, words, per_vector, number)
    if key not in _CODES:
        _CODES[key] = ProductCode(*key)
    return _CODES[key]


def book_words(most: int, per_vector: float, list_rows: int, codes: int) -> int:
    """Words of a book for lists of about ``list_rows`` of ``most`` rows."""
    return max(4, math.ceil(math.sqrt(most * per_vector / codes / list_rows)))


def filter_lists(unit: np.ndarray, words: int, per_vector: float, codes: int, least: int) -> list[np.ndarray]:
    """Ascending filter numbers of each row of ``unit`` in all codes."""
    found = [_code(unit.shape[1], words, per_vector / codes, k).decode(unit, least) for k in range(codes)]
    return [np.concatenate([f + k * words**2 for k, f in enumerate(row)]) for row in zip(*found)]


def _parts(link: np.ndarray) -> np.ndarray:
    """Least row of each row's connected part in a symmetric boolean matrix."""
    n = len(link)
    label = np.arange(n)
    while True:
        least = np.where(link, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, per_vector: float = 16.0, list_rows: int = 64, codes: int = 2, least: int = 8,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = staged(
        vectors.select(F.col(id_col).alias("vec_id"), F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col)).alias("label"), F.col(vector_col).alias("x"))
        .withColumns({"ok": F.col("label").isNotNull() & usable("x"), "rid": F.monotonically_increasing_id()})
        .withColumns({"h1": F.when(F.col("ok"), F.xxhash64("x")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "x"))})
    )
    nodes = staged(
        rows.where("ok").groupBy("label", "h1", "h2")
        .agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.min_by("x", "rid").alias("x"))
        .withColumn("dim", F.size("x"))
    )
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    words = book_words(most, per_vector, list_rows, codes)

    def filters(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(2).to_numpy()
        found: list = [None] * len(dims)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            if dim <= EXACT_DIM:
                lists = [np.zeros(1, np.int64)] * len(at)
            else:
                x = matrix(batch.column(1).take(pa.array(at)), int(dim))
                lists = filter_lists(x / np.linalg.norm(x, axis=1, keepdims=True), words, per_vector, codes, least)
            for i, f in zip(at, lists):
                found[i] = f
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "filters"])

    lists = staged(map_batches(nodes.select("node", "x", "dim"), filters, "node long, filters array<long>"))
    entry = nodes.select("node", "label", "dim").join(lists, "node").select("node", "label", "dim", F.explode("filters").alias("f"))
    big = entry.groupBy("label", "dim", "f").count().where(F.col("count") > CHUNK).withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count")
    placed = entry.join(big, ["label", "dim", "f"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = (
        placed.join(nodes.select("node", "copies", "x"), "node").join(lists, "node")
        .select("label", "dim", "f", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "copies", "x",
                F.expr("filter(filters, g -> g < f)").alias("before"))
    )

    def compare(group: pa.Table) -> pa.RecordBatch:
        dim, lo, hi = (group.column(c)[0].as_py() for c in ("dim", "lo", "hi"))
        x = matrix(group.column("x"), dim)
        norm = np.linalg.norm(x, axis=1)
        mine, node, copies = (group.column(c).to_numpy() for c in ("mine", "node", "copies"))
        link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
        if lo != hi:
            link &= mine[:, None] != mine[None, :]
        np.fill_diagonal(link, False)
        before = group.column("before").combine_chunks()
        flat = before.flatten().to_numpy()
        known, code = np.unique(flat, return_inverse=True)
        new = link
        busy = np.flatnonzero(link.any(1))
        if len(busy) and len(known):
            owner = np.repeat(np.arange(len(x)), np.diff(before.offsets.to_numpy()))
            has = np.zeros((len(x), len(known)), dtype=np.float32)
            has[owner, code] = 1
            shared = has[busy] @ has[busy].T > 0
            new = link.copy()
            new[np.ix_(busy, busy)] &= ~shared
        links = new @ copies.astype(np.int64)
        root = _parts(link)
        told = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
        return pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(links[told]), pa.array(node[root[told]])], names=["node", "links", "root"])

    told = staged(map_sorted_groups(groups, ["label", "dim", "f", "lo", "hi"], compare, "node long, links long, root long"))
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(told.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("label", "h1", "h2", "node", "copies", "least_id").join(links, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"], "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

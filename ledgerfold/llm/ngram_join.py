"""N-gram Jaccard join with set-relation skipping.

Documents whose sets of ``k``-word shingles have a Jaccard similarity of at
least ``threshold`` per cent are linked; the result is each document's class.

1. Equal sets are one node: rows are grouped by a 128-bit digest of the set.
2. Every node indexes the rarest few of its shingles (prefix filter): a set of
   n shingles needs n - ceil(t n) + 1 of them so that any linked set meets it in
   at least one index list.  "Rare" follows a bounded list of the most frequent
   shingles of all documents; all others are ordered by their digest.
3. Skipping by set relation.  In each index list the least node is the pivot.
   First only (pivot, member) pairs are verified, never all pairs of a list: in
   a group of copies this finds every class with one comparison a member.
   A member that is linked to the pivot takes over its class; of its answers
   only those outside that class are still to be found.  While lists hold far
   more pairs of different classes than members, as a group of near copies does
   whose least node links few, other pivots follow: some members of a list's
   largest class meet those outside it, ever one comparison a member and pivot.
4. What is left are members of one list in different classes.  A list is cut
   into blocks by set size, and a block meets only its own and the next one;
   positions in the lists bound the overlap; and the distances to the pivot,
   verified or bounded by sketches, bound the distance of two members from below
   (Jaccard distance is a metric): d(x, pivot) - d(y, pivot) > 1 - t rules the
   pair out.  The rest is verified.  A linked pair shares a list, so it is either
   in one class by then or verified here: no link between classes is lost.
5. Before any verification sketches are compared.  A sketch has about a bit or
   two a shingle, each the parity of the shingles that fall on it; two sets
   differ in at least as many shingles as their sketches differ in bits.  Only a
   pair whose bits leave room for a link is verified.

Verification counts common shingles of whole texts.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; a text of fewer than ``k`` words has its whole sequence as one shingle;
rows may repeat and ids may be null or shared by different texts (a null id
never names a class unless the class has no other); other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import map_batches, mix64, staged
from ledgerfold.llm.graph import components
from ledgerfold.llm.shingles import shingle_sets, signed
from ledgerfold.session import materialize, release

#: Length of the list of frequent shingles (12 bytes each in every task).
FREQUENT = 1 << 17
#: A shingle is counted from this many occurrences in one batch of up to 8,192 rows.
SEEN = 4
#: Bits of the sieve (2 MB in every task): it only saves work, so when more sets
#: are wanted than it can tell apart, more rows pass and the join drops them.
SIEVE_BITS = 1 << 24
#: Least words of a sketch.
SKETCH = 4
#: Further pivots of a list at a time, and the pairs a member from which they are tried.
PIVOTS, CROWDED = 4, 8


def frequent_shingles(docs: DataFrame, k: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(digests ascending, counts) of the most frequent shingles of all rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, _ = shingle_sets(batch.column(0), k)
        place = digest >> np.uint64(61)
        found = []
        for part in range(8):  # an eighth at a time takes less memory
            value, n = np.unique(digest[place == part], return_counts=True)
            found.append((value[n >= SEEN], n[n >= SEEN]))
        value, n = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n.astype(np.int64))], names=["h", "n"])

    top = map_batches(docs.select(text_col), run, "h long, n long", rows=8192).groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    h, n = top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _set_digest(digest: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's mixed shingles."""
    out = []
    for tag in (0x1234567, 0x89ABCDEF1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(digest ^ np.uint64(tag)), dtype=np.uint64)])
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return out[0], out[1]


def _sketches(digest: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Parities of each set's shingles by the low bits of their digests, as words: a
    power of two that gives at least a bit a shingle."""
    size = np.diff(offsets)
    words = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(words)])
    bit = digest & np.repeat(64 * words - 1, size).astype(np.uint64)
    flat = np.zeros(first[-1], np.uint64)
    np.bitwise_xor.at(flat, np.repeat(first[:-1], size) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(flat)))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes na and nb of their sets and ``apart``: a number
    of shingles in which they differ at least, by sizes and sketches."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    # A sketch of twice the words folds to the smaller one.
    fold = "if(size(s{0}) > least(size(sa), size(sb)), s{0}[i] ^ s{0}[i + least(size(sa), size(sb))], s{0}[i])"
    bits = f"aggregate(sequence(0, least(size(sa), size(sb)) - 1), 0, (v, i) -> v + bit_count({fold.format('a')} ^ {fold.format('b')}))"
    near = "greatest(size(sa), size(sb)) <= 2 * least(size(sa), size(sb))"
    return pairs.withColumn("apart", F.expr(f"greatest(abs(na - nb), if({near}, {bits}, 0))")).drop("sa", "sb")


def _merge(first: DataFrame, links: DataFrame) -> DataFrame:
    """Classes ``first`` (node, component) joined by links (a, b) of nodes."""
    joined = links.join(first.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(first.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    roots = first.unionByName(joined.select(F.col("a").alias("node"), F.coalesce("ca", "a").alias("component"))).unionByName(joined.select(F.col("b").alias("node"), F.coalesce("cb", "b").alias("component"))).distinct()
    return staged(roots.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def _describe(docs: DataFrame, k: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text digest th, set size n, set
    digests f1 and f2, sketch, and its index entries (prefix), rarest first."""
    frequent, weight = frequent_shingles(docs, k, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, offsets = shingle_sets(batch.column(2), k)
        f1, f2 = _set_digest(digest, offsets)
        size = np.diff(offsets)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, digest), len(frequent) - 1)
            count = np.where(frequent[at] == digest, weight[at], 0)
        else:
            count = np.zeros(len(digest), np.int64)
        common = np.concatenate([[0], np.cumsum(count > 0)])[offsets]
        take = np.where(size > 0, size - (threshold * size + 99) // 100 + 1, 0)
        chosen = []
        for a, b, p, c in zip(offsets[:-1], offsets[1:], take, np.diff(common)):
            if not c:
                chosen.append(digest[a:a + p])
            else:
                chosen.append(digest[a:b][np.lexsort((digest[a:b], count[a:b]))[:p]])
        flat = signed(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size.astype(np.int64)), pa.array(signed(f1)), pa.array(signed(f2)), _sketches(digest, offsets), prefix],
            names=["doc_id", "th", "n", "f1", "f2", "sketch", "prefix"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    described = map_batches(rows, run, f"doc_id {kind}, th long, n long, f1 long, f2 long, sketch array<long>, prefix array<long>")
    return staged(described.withColumn("rid", F.monotonically_increasing_id()))


def _sieve(known: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the (text digest, id) pairs in ``known``."""
    place = F.pmod(F.xxhash64("th", "node_id"), F.lit(SIEVE_BITS)) + 1
    rows = (
        known.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    )
    bits = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r["m"], dtype=np.uint8)
        bits[(r["b"] - 1) * len(part):r["b"] * len(part)] = part
    return bits


def _sets(known: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str, folder: list[str]) -> DataFrame:
    """(id, th2, is_a, is_b, s): the shingle sets of the rows that ``known`` (node_id, th,
    is_a, is_b) wants as left or right side, from whole texts, written where they are
    read: a bitmap for each side tells wanted rows, and the few that pass by chance
    meet no pair."""
    left, right = (_sieve(known.where(side)) for side in ("is_a", "is_b"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th2"), F.col(text_col).alias("text")).withColumn("place", F.pmod(F.xxhash64("th2", "id"), F.lit(SIEVE_BITS)))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = batch.column(3).to_numpy()
        is_a, is_b = ((bits[place >> 3] >> (place & 7) & 1).astype(bool) for bits in (left, right))
        wanted = is_a | is_b
        batch = batch.filter(pa.array(wanted))
        digest, offsets = shingle_sets(batch.column(2), k)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(is_a[wanted]), pa.array(is_b[wanted]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(digest)))],
            names=["id", "th2", "is_a", "is_b", "s"],
        )

    return materialize(map_batches(texts, sets, f"id {kind}, th2 long, is_a boolean, is_b boolean, s array<long>"), folder)


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, na, nb, common) of each pair of nodes (a, b)."""

    def overlap(batch: pa.RecordBatch) -> pa.RecordBatch:
        sa, sb = batch.column(2), batch.column(3)
        na, nb, common = [], [], []
        for x, y in zip(sa, sb):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            na.append(len(x))
            nb.append(len(y))
            common.append(len(np.intersect1d(x, y, assume_unique=True)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (na, nb, common))], names=["a", "b", "na", "nb", "common"])

    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(True).alias("is_a")), F.struct(F.col("b").alias("node"), F.lit(False).alias("is_a"))
    )).alias("x")).select("x.*")
    ends = sides.groupBy("node").agg(F.bool_or("is_a").alias("is_a"), F.bool_or(~F.col("is_a")).alias("is_b"))
    known = staged(ends.join(classes.select("node", "node_id", "th"), "node"))
    folder: list[str] = []
    sets = _sets(known, docs, k, id_col, text_col, folder)
    both = pairs
    for side in ("b", "a"):
        # Pairs learn the text and id that name a side's set; the digest leads, so
        # that null or shared ids don't gather in one task.
        own = known.select(F.col("node").alias(side), F.col("th").alias(f"th_{side}"), F.col("node_id").alias(f"id_{side}"))
        both = both.join(own, side)
    for side in ("b", "a"):
        named = sets.where(f"is_{side}").select("id", "th2", F.col("s").alias(f"s{side}"))
        both = both.join(named, (F.col("th2") == F.col(f"th_{side}")) & F.col("id").eqNullSafe(F.col(f"id_{side}"))).drop("id", "th2", f"th_{side}", f"id_{side}")
    out = staged(map_batches(both.select("a", "b", "sa", "sb"), overlap, "a long, b long, na long, nb long, common long").distinct())
    release(docs.sparkSession, folder)
    return out


def link_classes(docs: DataFrame, k: int, threshold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, th (digest of the text),
    n_shingles, node (of its set), component (of its class), component_id (the
    class's least id).  ``rid`` numbers the rows of this result only."""
    rows = _describe(docs, k, threshold, id_col, text_col)
    classes = staged(
        rows.where("n > 0").groupBy("f1", "f2", "n")
        .agg(F.min(F.struct("rid", "th", "doc_id", "sketch")).alias("one"), F.min("doc_id").alias("least_id"))
        .select("f1", "f2", "n", F.col("one.rid").alias("node"), F.col("one.th").alias("th"), F.col("one.doc_id").alias("node_id"), F.col("one.sketch").alias("sketch"), "least_id")
    )
    index = (
        rows.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
        .select(F.col("rid").alias("node"), "n", F.posexplode("prefix").alias("pos", "h"))
    )
    lists = index.groupBy("h").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1").select("h", "pivot")
    entries = staged(index.join(lists, "h").where("node != pivot"))

    may_link = f"100 * (na + nb - apart) >= {threshold} * (na + nb + apart)"
    linked = F.expr(f"100 * common >= {threshold} * (na + nb - common)")
    stars = staged(_apart(entries.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), classes))
    checked = _verify(stars.where(may_link).select("a", "b"), classes, docs, k, id_col, text_col)
    first = staged(components(checked.where(linked).select("a", "b")))

    # Distances to the pivot: verified ones, else from the sketches' bound up.
    distance = F.expr("1 - common / (na + nb - common)")
    far = checked.select("a", "b", distance.alias("d"))
    far = stars.join(far, ["a", "b"], "left").select(
        F.col("a").alias("pivot"), F.col("b").alias("node"), F.expr("coalesce(d, 2 * apart / (na + nb + apart))").alias("d"), F.expr("coalesce(d, 1D)").alias("e")
    )
    step = math.log(100 / threshold) if threshold < 100 else 1.0
    slack = 1 - threshold / 100 + 1e-9
    # Members of one list are compared by sketches of the least size.
    words = [f"w{i}" for i in range(SKETCH)]
    folded = classes.select("node", *(F.expr(f"aggregate(sequence(0, size(sketch) div {SKETCH} - 1), 0L, (v, j) -> v ^ sketch[{SKETCH} * j + {i}])").alias(w) for i, w in enumerate(words)))
    bits = "(" + " + ".join(f"bit_count({w}_x ^ {w}_y)" for w in words) + ")"
    fits = (
        f"c_x != c_y and 100 * least(n_x, n_y) >= {threshold} * greatest(n_x, n_y) "
        f"and (100 + {threshold}) * least(n_x - pos_x, n_y - pos_y) >= {threshold} * (n_x + n_y) "
        f"and coalesce(d_x - e_y <= {slack} and d_y - e_x <= {slack}, true) "
        f"and 100 * (n_x + n_y - {bits}) >= {threshold} * (n_x + n_y + {bits})"
    )
    own = ("node", "n", "pos", "c", "d", "e", *words)
    before = None
    for turn in itertools.count():
        members = entries.join(first.select("node", F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node")).join(far, ["pivot", "node"], "left")
        mixed = members.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 != c2").select("h")
        rest = staged(members.join(mixed, "h").join(folded, "node").select("h", *own, F.floor(F.log("n") / step).alias("block")))
        parts = rest.groupBy("h", "c").agg(F.count("*").alias("m"))
        lists = parts.groupBy("h").agg(F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
        crowd = lists.agg(F.sum("m").alias("members"), F.expr("sum((m * m - same) / 2)").alias("pairs")).first()
        if not crowd["members"] or crowd["pairs"] <= CROWDED * crowd["members"] or (before and crowd["pairs"] > 0.75 * before):
            break
        before = crowd["pairs"]
        chosen = rest.join(lists.select("h", F.col("most.c").alias("c")), ["h", "c"]).groupBy("h").agg(
            F.array(*(F.max(F.struct(F.xxhash64("node", F.lit(PIVOTS * turn + i)).alias("by"), *own)) for i in range(PIVOTS))).alias("p")
        )
        x = chosen.select("h", F.explode(F.array_distinct("p")).alias("p")).select("h", *(F.col(f"p.{v}").alias(f"{v}_x") for v in own)).distinct()
        y = rest.select("h", *(F.col(v).alias(f"{v}_y") for v in own))
        spokes = x.join(y, "h").where(fits).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
        likely = staged(_apart(spokes, classes).where(may_link).select("a", "b"))
        if not likely.limit(1).count():
            break
        first = _merge(first, _verify(likely, classes, docs, k, id_col, text_col).where(linked).select("a", "b"))

    x = rest.select("h", "block", *(F.col(v).alias(f"{v}_x") for v in own))
    y = rest.select("h", F.explode(F.array("block", F.col("block") - 1)).alias("block"), *(F.col(v).alias(f"{v}_y") for v in own))
    # Of two sets x is the smaller one, so y lies in its block or the next.
    across = x.join(y, ["h", "block"]).where(f"(n_x < n_y or (n_x = n_y and node_x < node_y)) and {fits}")
    more = staged(_apart(across.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct(), classes).where(may_link).select("a", "b"))
    if more.limit(1).count():
        first = _merge(first, _verify(more, classes, docs, k, id_col, text_col).where(linked).select("a", "b"))

    named = classes.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select("f1", "f2", "n", "node", "component", "component_id")
    return (
        rows.select("rid", "doc_id", "th", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
        .select("rid", "doc_id", "th", F.col("n").alias("n_shingles"), "node", "component",
                F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, k: int, threshold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one of the least id, of equal ids
    the one of the least row number.  Rows without words all stay."""
    classes = link_classes(docs, k, threshold, id_col, text_col).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"), F.col("th"))).alias("one")
    kept = staged(classes.groupBy("component").agg(first).select(F.col("one.doc_id").alias("__keep_id"), F.col("one.th").alias("__keep_th")).distinct())
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    tagged = docs.withColumn("__th", F.xxhash64(text_col))
    stay = (
        tagged.where(has_words).join(kept, (F.col("__th") == F.col("__keep_th")) & F.col(id_col).eqNullSafe(F.col("__keep_id")), "left_semi")
        .dropDuplicates(["__th", id_col])
    )
    return stay.unionByName(tagged.where(~has_words)).select(*docs.columns)

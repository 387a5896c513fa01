"""How the sources of each language differ in the words that they use.

*Tokenizer.*  One ``bytes.translate`` lowers A-Z and blanks every separator (all
ASCII but letters); ``bytes.split`` gives a document's terms and a ``Counter``
their frequencies.  A task adds up the counters of its documents as Arrow
tables, group by group, and passes on what it holds whenever that grows beyond
``HELD`` rows; Spark adds up the rest.

*Profiles.*  A language keeps the terms that occur in ``min_docs`` of its
documents or more; V is their number.  A group (language and source) of N kept
occurrences gives a term that it holds ``count`` times the smoothed share
``p = 1 + floor(scale * (count + add) / (N + add * V))``, also with count 0.  The
language's own share of the term is q.  All arithmetic is on whole numbers.

*Pairs.*  The distance of two sources is the sum of |p - p'| over all kept terms.
Only cells with a count are ever written: terms are dealt to buckets, sources to
chunks, and a task compares two chunks in one bucket, filling in count 0 there;
terms that neither chunk holds are added at the end by their number.  A hot
source or term therefore never lands in one task, and no task holds all sources.

*Terms.*  The terms with p > q of each group, by p - q.

Defined cases: null text, language and source count as ''; a group without any
term takes part; repeated rows count as often as they occur; a language without
kept terms has distances 0 and no terms; ties rank by the bytes of the item;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm.common import LOWER, UPPER, map_sorted_groups, staged

#: (group, term) rows that a task holds before it passes them on.
HELD = 400_000
#: Kept terms of a bucket on average, and sources of a chunk.
BUCKET_TERMS, CHUNK_SOURCES = 2048, 64

#: Letters A-Z lowered, a-z and all bytes beyond ASCII kept, the rest blanked.
TABLE = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b > 127 or chr(b) in LOWER else 32 for b in range(256))


def terms_of(text: bytes) -> Counter[bytes]:
    """Frequencies of the terms of one document."""
    return Counter(text.translate(TABLE).split())


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(
        ["lang", "source", "term", "n", "docs"]
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0

    def flush(limit: int) -> Iterator[pa.RecordBatch]:
        """Add up what is held; pass it on if more than ``limit`` rows are left."""
        nonlocal held, rows
        if held:
            held = [_summed(held)]
            rows = held[0].num_rows
            if rows > limit:
                yield from held[0].to_batches(max_chunksize=20_000)
                held, rows = [], 0

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words: list[bytes] = []
            counts: list[int] = []
            sizes: list[int] = []
            for text in part.column(2).to_pylist():
                found = terms_of(text)
                words += found.keys()
                counts += found.values()
                sizes.append(len(found))
            doc = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            held.append(pa.table({
                "lang": part.column(0).take(doc), "source": part.column(1).take(doc), "term": pa.array(words, pa.binary()),
                "n": pa.array(counts, pa.int64()), "docs": pa.array(np.ones(len(counts), np.int64)),
            }))
            rows += len(counts)
            if rows > HELD:
                yield from flush(HELD // 2)
    yield from flush(0)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of
    every group, from (lang, source, text) without nulls."""
    found = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        _count, "lang string, source string, term binary, n long, docs long"
    )
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column | str, total: str, scale: int, add: int) -> Column:
    """1 + floor(scale * (count + add) / (total + add * v)), exactly; null without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    count = F.col(count) if isinstance(count, str) else count
    top = F.lit(scale).cast("decimal(12,0)") * wide(count + F.lit(add))
    below = F.when(F.col("v") > 0, wide(F.col(total) + F.lit(add) * F.col("v")))
    return F.lit(1) + F.call_function("div", top, below)


def _block(group: pa.Table) -> pa.RecordBatch:
    """Distances of all pairs of two chunks of sources over one bucket of terms.

    Rows without a term name the sources and their share of a term that they lack."""
    col = {n: group.column(n).to_numpy(zero_copy_only=False) for n in ("lang_id", "lo", "hi", "place", "term_id", "p")}
    named = col["term_id"] < 0
    place, at = np.unique(col["place"], return_inverse=True)
    rest = np.zeros(len(place), np.int64)
    rest[at[named]] = col["p"][named]
    terms, row = np.unique(col["term_id"][~named], return_inverse=True)
    shares = np.repeat(rest[:, None], len(terms), 1)
    shares[at[~named], row] = col["p"][~named]
    lo, hi = int(col["lo"][0]), int(col["hi"][0])
    left, right = np.flatnonzero(place // CHUNK_SOURCES == lo), np.flatnonzero(place // CHUNK_SOURCES == hi)
    sums = np.array([np.abs(shares[right] - shares[i]).sum(1) for i in left], np.int64).reshape(len(left), len(right))
    a, b = np.repeat(place[left], len(right)), np.tile(place[right], len(left))
    total = sums.ravel()
    if lo != hi:
        a, b, total = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([total, total])
    good = a != b
    n = int(good.sum())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, col["lang_id"][0])), pa.array(a[good]), pa.array(b[good]), pa.array(total[good]), pa.array(np.full(n, len(terms), np.int64))],
        names=["lang_id", "a", "b", "part_sum", "seen"],
    )


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    chunk = F.floor(F.col("place") / CHUNK_SOURCES)
    last = F.floor((F.col("n_sources") - 1) / CHUNK_SOURCES)
    named = groups.select("lang_id", "place", "n_sources", F.lit(-1).cast("long").alias("term_id"), F.col("rest").alias("p"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("buckets"), F.lit(1)) - 1)).alias("bucket"))
    held = cells.select("lang_id", "place", "n_sources", "term_id", "p", F.pmod(F.xxhash64("term_id"), F.col("buckets")).alias("bucket"))
    dealt = held.unionByName(named).withColumn("p", F.coalesce("p", F.lit(1).cast("long")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = dealt.select("lang_id", "bucket", F.least(chunk, "other").alias("lo"), F.greatest(chunk, "other").alias("hi"), "place", "term_id", "p")
    sums = map_sorted_groups(blocks, ["lang_id", "bucket", "lo", "hi"], _block, "lang_id long, a long, b long, part_sum long, seen long")
    sums = sums.groupBy("lang_id", "a", "b").agg(F.sum("part_sum").alias("part_sum"), F.sum("seen").alias("seen"))
    one = groups.select("lang_id", F.col("place").alias("a"), "lang", "source", "v", F.col("rest").alias("rest_a"))
    two = groups.select("lang_id", F.col("place").alias("b"), F.col("source").alias("item"), F.col("rest").alias("rest_b"))
    unseen = (F.col("v") - F.col("seen")) * F.abs(F.col("rest_a") - F.col("rest_b"))
    value = F.when(F.col("v") > 0, F.col("part_sum") + unseen).otherwise(F.lit(0).cast("long"))
    return sums.join(one, ["lang_id", "a"]).join(two, ["lang_id", "b"]).select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, add: int = 5, scale: int = 1_000_000_000, top_terms: int = 50,
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the
    language (part ``pair``, all ranks) and the ``top_terms`` terms that a source uses
    beyond its language (part ``term``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = staged(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= min_docs)
    kept = staged(kept.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("term_id")))
    cells = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "term_id", "n", "lang_n"))

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")))
    in_lang = Window.partitionBy("lang")
    groups = groups.select(
        "*", F.xxhash64("lang").alias("lang_id"), (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("place"),
        F.count(F.lit(1)).over(in_lang).alias("n_sources"), F.ceil(F.col("v") / BUCKET_TERMS).cast("long").alias("buckets"),
        _share(zero, "total", scale, add).alias("rest"),
    )
    groups = staged(groups)

    cells = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", scale, add))
    pairs = _pairs(cells, groups).withColumn("part", F.lit("pair"))
    over = F.col("p") - _share("lang_n", "lang_total", scale, add)
    terms = cells.where(over > 0).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
    ranked = pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
    return ranked.select("lang", "source", "part", "item", "value", "rank")

"""Preparing a training corpus: five stages over ``documents``.

Each stage reads all that its predecessor kept, written as Parquet in the shared
checkpoint folder.  All but the last return the columns of ``documents``.

1. toxicity: documents scored 0.5 or more are rejected.  Labels train the
   grammar; a missing or empty label table leaves its seed lexicon.
2. near duplicates: one document of each class of linked shingle sets stays.
3. PII: private values become pseudonyms; ``n_chars`` follows the new text.
4. mixing: sources are tempered to a repeat limit; every document stays, those
   of small sources may come twice.
5. BPE: ids of every text (doc_id, n_tokens, ids).

Null and empty texts pass all stages; extra columns of ``documents`` pass the
first four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import bpe, mixing, ngram_join, pii, toxicity
from ledgerfold.llm.queries import PII_KEY, bpe_path
from ledgerfold.session import materialize

#: A document of this score or more is rejected.
TOXIC = 0.5
#: Words of a shingle, and the similarity in per cent from which documents link.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: No source is read more often than this when the least read one is read once.
MAX_REPEATS = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, score_col="__toxicity").where(F.col("__toxicity") < TOXIC).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def hide_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(docs, PII_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(docs, max_repeats=MAX_REPEATS)
    return rows.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_class),
    ("pii", hide_private_values),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the learned grammar; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights by temperature.

Every source has a token share p.  Its weight is p ** exponent, normalised.
The exponent (1: as collected, 0: all sources alike) is bisected:

* ``target_entropy``: the entropy of the weights, as a part of the largest
  possible (log of the number of sources), reaches the target;
* ``max_repeats``: no source is read more than that many times, when the source
  that is read least often is read once.  The exponent is the least that keeps
  to the limit; when both are given, the larger exponent of the two counts.

``budget_tokens`` tokens are then shared out by the weights.  Without a budget
the source read least often is read exactly once, so no document is lost.
A source's documents are dealt to ``n_blocks`` blocks by a digest of their id
and text.  Each pass over a source (an epoch) visits its blocks in a permutation
of its own, given by a digest of seed, source, epoch and block.  Whole epochs
take every block; the last, partial epoch takes blocks in its order until the
budget is met, so a source misses its budget by at most one block.

Only sums by (source, block) are gathered: the blocks of one source are few and
fixed in number, so a source with a third of all rows is counted and joined like
any other.  The per-source shares (one row each) reach the driver; the number of
sources is checked against ``max_sources``.

Defined cases: a null source is a source of its own (shown as null); null and
empty texts have no tokens, belong to their source and follow its blocks; a
source without any tokens is read once; repeated rows are rows; an empty table
gives an empty result; other columns of the input stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import materialize


def token_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``, counted in the JVM: the places where a
    word begins."""
    flat = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(flat, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    """What the mixture decided: exponent, weights and tokens by source."""

    exponent: float
    weights: dict[str | None, float]
    tokens: dict[str | None, int]
    budgets: dict[str | None, float]

    @property
    def entropy(self) -> float:
        return entropy(list(self.weights.values()))


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    raw = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def bisect_exponent(shares: list[float], target_entropy: float | None, max_repeats: float | None, steps: int = 60) -> float:
    """The exponent in 0 .. 1 that meets the target; entropy falls and the
    spread of repeats shrinks as it grows."""
    shares = [s for s in shares if s > 0]
    if len(shares) < 2:
        return 1.0

    def bisect(fits) -> float:
        """The least exponent that fits, where larger ones fit as well."""
        if fits(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        return high

    found = []
    if target_entropy is not None:
        goal = target_entropy * math.log(len(shares))
        # Entropy above the goal counts as too flat: the exponent may grow.
        found.append(1.0 if entropy(tempered(shares, 1.0)) >= goal else bisect(lambda e: entropy(tempered(shares, e)) <= goal))
    if max_repeats is not None:
        spread = max(shares) / min(shares)
        found.append(bisect(lambda e: spread ** (1 - e) <= max_repeats))
    return max(found, default=1.0)


def plan_mixture(
    totals: dict[str | None, int], target_entropy: float | None, max_repeats: float | None, budget_tokens: float | None,
) -> Plan:
    names = [s for s, n in totals.items() if n > 0]
    all_tokens = sum(totals.values())
    shares = [totals[s] / all_tokens for s in names]
    exponent = bisect_exponent(shares, target_entropy, max_repeats)
    weights = dict(zip(names, tempered(shares, exponent)))
    if budget_tokens is None:
        budget_tokens = max((totals[s] / w for s, w in weights.items()), default=0.0)
    return Plan(exponent, weights, dict(totals), {s: w * budget_tokens for s, w in weights.items()})


def _digest(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def mix(
    docs: DataFrame, *, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget_tokens: float | None = None,
    n_blocks: int = 256, seed: int = 17, max_sources: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, Plan]:
    """(the chosen rows with ``__epoch``, ``__order`` and ``__tokens``, the plan).

    ``__epoch`` counts from 1; ``__order`` is the block's place in that epoch's
    permutation.  A row comes as often as epochs chose its block.
    """
    spark = docs.sparkSession
    block = F.pmod(_digest(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int")
    tagged = docs.withColumns({"__block": block, "__tokens": token_count(F.col(text_col))})
    sums = materialize(
        tagged.groupBy(F.col(source_col).alias("__source"), "__block").agg(F.sum("__tokens").alias("__n"))
    )
    per_source = sums.groupBy("__source").agg(F.sum("__n").alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    plan = plan_mixture({r["__source"]: r["n"] for r in per_source}, target_entropy, max_repeats, budget_tokens)

    goals = spark.createDataFrame(
        [(s, n, plan.budgets.get(s, 0.0) / n if n else 1.0) for s, n in sorted(plan.tokens.items(), key=lambda x: str(x[0]))],
        "__source string, __total long, __epochs double",
    )
    # One row for each epoch that a source begins; its block order; its share.
    epochs = goals.select("__source", "__total", "__epochs", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.round("__epochs", 9)).cast("int")))).alias("__epoch"))
    blocks = sums.join(F.broadcast(epochs), sums["__source"].eqNullSafe(epochs["__source"])).select(
        sums["__source"], "__block", "__n", "__total", "__epochs", "__epoch",
        _digest(F.lit(seed), F.coalesce(sums["__source"], F.lit("\u0000")), "__epoch", "__block").alias("__key"),
    )
    by_epoch = Window.partitionBy("__source", "__epoch").orderBy("__key", "__block")
    before = F.coalesce(F.sum("__n").over(by_epoch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = (
        blocks.withColumns({"__before": before, "__order": F.row_number().over(by_epoch)})
        .where(F.col("__before") < F.round((F.col("__epochs") - F.col("__epoch") + 1) * F.col("__total"), 3))
        .unionByName(  # a source without tokens has nothing to measure: read once
            blocks.where("__total = 0").withColumns({"__before": F.lit(0).cast("long"), "__order": F.row_number().over(by_epoch)})
        )
        .groupBy("__source", "__block").agg(F.collect_list(F.struct("__epoch", "__order")).alias("__visits"))
    )
    tagged = tagged.withColumn("__source", F.col(source_col))
    rows = tagged.join(chosen.withColumnRenamed("__source", "__s").withColumnRenamed("__block", "__b"),
                       F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    out = rows.select(*[tagged[c] for c in docs.columns], "__tokens", F.explode("__visits").alias("__v"))
    return out.select(*docs.columns, "__tokens", F.col("__v.__epoch").alias("__epoch"), F.col("__v.__order").alias("__order")), plan

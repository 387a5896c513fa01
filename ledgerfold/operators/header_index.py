"""Header matching against names of any number, without all pairs.

An inverted index over letter counts.  A normalised text is the set of its numbered letters
(``a1 a2 e1``); two texts can only be as similar as a ratio t asks when they share
t/2 of their letters taken together.  So their lengths lie within t/(2-t) of each other, and
with the letters in one fixed order, rarest first, their beginnings have a letter in common: a
beginning is as long as what may be missing, plus one.  Headers and names are
joined on these letters; the exact count of shared letters decides what is
scored.  Names with a key-token rule have a second, longer beginning for the
lower ratio, met only by headers that hold the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import normalize_header
from ledgerfold.operators.headers import EXACT_RATIO, LETTERS, TOKEN_RATIO, shared_letters, similarity_ratio, tokens_match

#: All letters of normalised texts, seldom ones first (any fixed order is right).
RARE_FIRST = "".join(sorted(LETTERS, key=lambda c: "qzjxkvbpgwyfmucdlhrsnioate ".find(c)))
#: Rules of the key tokens.
RULES = ("captive", "client", "salesperson", "vendor")


def numbered_letters(n: Column) -> Column:
    """The letters of a normalised text as sorted numbers: repeats first, then seldom letters."""
    def copies(c: Column, i: Column) -> Column:
        times = F.length(n) - F.length(F.replace(n, c))
        numbers = F.transform(F.sequence(F.lit(1), times), lambda k: (F.lit(1_000_000) - k) * 64 + i)
        return F.when(times > 0, numbers).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.flatten(F.transform(F.array(*map(F.lit, RARE_FIRST)), copies)))


def _beginning(letters: Column, ratio: float) -> Column:
    """As many letters as one more than may be missing in a text that is ``ratio`` similar."""
    size = F.size(letters)
    needed = F.ceil(size * F.lit(ratio / (2 - ratio)) - F.lit(1e-9)).cast("int")
    return F.slice(letters, 1, F.greatest(size - needed + 1, F.lit(0)))


def _indexed(texts: DataFrame, ratio: float) -> DataFrame:
    return texts.select("*", F.explode(_beginning(F.col("letters"), ratio)).alias("letter"))


def candidates(headers: DataFrame, names: DataFrame) -> DataFrame:
    """(header, canonical, n_act, n_can, exact, token) of every pair that may match, from
    (header) and (canonical, rule); repeated texts count once."""
    acts = headers.select("header").distinct().withColumn("n_act", normalize_header("header")).filter(F.col("n_act") != "")
    forms = acts.select("n_act").distinct()
    forms = forms.withColumn("letters", numbered_letters(F.col("n_act")))
    forms = forms.withColumn("rules", F.array_compact(F.array(*(F.when(tokens_match(F.lit(r), F.col("n_act")), r) for r in RULES))))
    named = names.select("canonical", "rule").distinct().withColumn("n_can", normalize_header("canonical")).filter(F.col("n_can") != "")
    named = named.withColumn("letters", numbered_letters(F.col("n_can")))

    def meet(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
        a = _indexed(left.withColumn("size_act", F.size("letters")), ratio).drop("letters")
        b = _indexed(right.withColumn("size_can", F.size("letters")), ratio).drop("letters")
        near = F.least("size_act", "size_can") * 2.0 / (F.col("size_act") + F.col("size_can")) >= ratio
        return a.join(b, "letter").filter(near)

    plain = meet(forms, named, EXACT_RATIO)
    keyed = meet(forms.filter(F.size("rules") > 0), named.filter(F.col("rule").isNotNull()), TOKEN_RATIO).filter(F.array_contains("rules", F.col("rule")))
    token = F.coalesce(F.array_contains("rules", F.col("rule")), F.lit(False))
    pairs = plain.unionByName(keyed).select("n_act", "canonical", "n_can", token.alias("token")).distinct()
    need = F.when(F.col("token"), TOKEN_RATIO).otherwise(EXACT_RATIO)
    fits = shared_letters(F.col("n_act"), F.col("n_can")) * 2.0 / (F.length("n_act") + F.length("n_can")) >= need
    return acts.join(pairs.filter(fits), "n_act").select("header", "canonical", "n_act", "n_can", (F.col("n_act") == F.col("n_can")).alias("exact"), "token")


def match_names(headers: DataFrame, names: DataFrame) -> DataFrame:
    """(header, canonical, exact, ratio) of all pairs that match: equal after normalising,
    a ratio of 0.72, or of 0.40 where the key tokens are there."""
    pairs = candidates(headers, names)
    ratios = pairs.filter("NOT exact").select("n_can", "n_act").distinct().withColumn("ratio", similarity_ratio("n_can", "n_act"))
    known = pairs.join(ratios, ["n_can", "n_act"], "left").withColumn("ratio", F.when(F.col("exact"), 1.0).otherwise(F.col("ratio")))
    return known.filter((F.col("ratio") >= EXACT_RATIO) | (F.col("token") & (F.col("ratio") >= TOKEN_RATIO))).select("header", "canonical", "exact", "ratio")

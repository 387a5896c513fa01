"""Header harmonisation: observed headers joined to canonical names.

Input is a small table of observed headers ``(file, col_idx, header)`` -- one row
per column of each file, never per data row.  Matching runs on *distinct*
header texts times the spec's canonical list (a fixed, bounded list exploded
from literals, not a join).  The similarity ratio is the only Python in the
path: an Arrow-batched pandas UDF, evaluated only on pairs that can still match.
A bound from the letters that both texts share (JVM-side) must reach 0.72, or
0.40 where the key-token rule holds; so data cells, which the table search also
compares, practically never reach Python.

The one-to-one assignment of headers to canonical names is sequential by
nature: a fold over one array, JVM-side, once for every distinct list of headers
(at most columns x canonical names pairs).
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.functions.numbers import strip
from ledgerfold.functions.text import clean_header, is_nuisance_header, normalize_header
from ledgerfold.spec import KEY_RULES, ReportSpec

# Typo-tolerant key tokens for the key columns.
CAPTIVE_TOKENS = ("captive", "captiev", "captve", "captiv")
NAME_TOKENS = ("name",)
CLIENT_TOKENS = ("client", "cliant", "clent")
SALESPERSON_TOKENS = ("salesperson", "sales person")
VENDOR_TOKENS = ("vendor", "referrer", "referral")

EXACT_RATIO = 0.72
TOKEN_RATIO = 0.40

HEADER_SCHEMA = "file string, col_idx int, header string"


def _any_token(n: Column, tokens: Sequence[str]) -> Column:
    out = None
    for t in tokens:
        c = n.contains(t)
        out = c if out is None else (out | c)
    return out


def tokens_match(rule: Column, n_act: Column) -> Column:
    """Key-token rule on a normalised header (``rule`` from ``spec.KEY_RULES``)."""
    nonempty = n_act != ""
    return nonempty & (
        F.when(rule == "captive", _any_token(n_act, CAPTIVE_TOKENS) & _any_token(n_act, NAME_TOKENS))
        .when(rule == "client", _any_token(n_act, CLIENT_TOKENS))
        .when(rule == "salesperson", _any_token(n_act, SALESPERSON_TOKENS))
        .when(rule == "vendor", _any_token(n_act, VENDOR_TOKENS))
        .otherwise(F.lit(False))
    )


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of (canonical, actual), as ``difflib`` computes it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def canonical_table(canonical: Sequence[str]) -> Column:
    """Literal array of (canon_pos, canonical, rule) to explode."""
    from ledgerfold.functions.sqltext import lit

    items = [
        f"named_struct('canon_pos', {i}, 'canonical', {lit(c)}, 'rule', {lit(KEY_RULES[c]) if c in KEY_RULES else 'CAST(NULL AS STRING)'})"
        for i, c in enumerate(canonical)
    ]
    return F.expr("array(" + ", ".join(items) + ")")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def shared_letters(a: Column, b: Column) -> Column:
    """Letters that two normalised texts share, counted with repeats: no
    similarity ratio exceeds twice this over the sum of their lengths."""

    def times(text: Column, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter))

    return F.aggregate(
        F.array(*[F.lit(c) for c in LETTERS]), F.lit(0), lambda total, c: total + F.least(times(a, c), times(b, c))
    )


def candidate_pairs(headers: DataFrame, canonical: Sequence[str], header_col: str = "header") -> DataFrame:
    """Distinct headers x canonical names with ``exact`` and ``may_match``: only
    pairs that may match need a similarity ratio.  JVM-side."""
    distinct = headers.select(F.col(header_col).alias("header")).distinct()
    pairs = distinct.select("header", normalize_header("header").alias("n_act"), F.inline(canonical_table(canonical)))
    pairs = pairs.withColumn("n_can", normalize_header("canonical"))
    return pairs.withColumns({
        "exact": (F.col("n_can") == F.col("n_act")) & (F.col("n_act") != ""),
        "token": F.coalesce(tokens_match(F.col("rule"), F.col("n_act")), F.lit(False)),
        "may_match": _fits(F.col("n_act"), F.struct(F.col("n_can").alias("n"), F.col("rule").alias("rule"))),
    })


def may_match_any(header_col: str, canonical: Sequence[str]) -> Column:
    """Whether a text can match any of a few canonical names (see
    :func:`candidate_pairs`), as one expression on the row."""
    n = normalize_header(header_col)
    one = F.transform(F.array(n), lambda act: F.exists(
        F.array(*[F.struct(normalize_header(F.lit(c)).alias("n"), F.lit(KEY_RULES.get(c)).cast("string").alias("rule")) for c in canonical]),
        lambda can: _fits(act, can),
    ))
    return F.coalesce(F.element_at(one, 1), F.lit(False))


def _fits(act: Column, can: Column) -> Column:
    a, c = F.length(act), F.length(can["n"])
    need = F.when(F.coalesce(tokens_match(can["rule"], act), F.lit(False)), TOKEN_RATIO).otherwise(EXACT_RATIO)
    return (a > 0) & (2.0 * F.least(a, c) / (a + c) >= need) & (shared_letters(act, can["n"]) * 2.0 / (a + c) >= need)


def match_pairs(headers: DataFrame, canonical: Sequence[str], header_col: str = "header", score_all: bool = False) -> DataFrame:
    """Distinct headers x canonical names with ``exact``, ``ratio`` and ``matched``.

    ``matched``: equal after normalising, or ratio >= 0.72, or ratio >= 0.40 and
    the key-token rule holds; an empty header never matches.  Pairs that can't
    match are not scored and have a null ratio; ``score_all`` scores them too."""
    pairs = candidate_pairs(headers, canonical, header_col)
    # The UDF runs only on pairs that need it (a filter, not a CASE: Spark
    # evaluates Python UDFs on every row of the node that holds them).
    wanted = pairs if score_all else pairs.filter("may_match AND NOT exact")
    ratios = wanted.select("n_can", "n_act").distinct().withColumn("ratio", similarity_ratio("n_can", "n_act"))
    out = pairs.join(ratios, ["n_can", "n_act"], "left")
    ratio = F.coalesce(F.col("ratio"), F.when(F.col("exact"), F.lit(1.0)))
    known = F.coalesce(ratio, F.lit(0.0))
    matched = (F.coalesce(F.col("header"), F.lit("")) != "") & F.col("may_match") & (
        F.col("exact") | (known >= EXACT_RATIO) | ((known >= TOKEN_RATIO) & F.col("token"))
    )
    return out.select("header", "canon_pos", "canonical", "n_act", "exact", ratio.alias("ratio"), F.coalesce(matched, F.lit(False)).alias("matched"))


def _assign(pairs: Column, strategy: str) -> Column:
    """One-to-one assignment of a list's matched pairs (array of structs of col_idx,
    header, canonical, canon_pos, exact, ratio), as a fold over the pairs in order of
    preference; the columns and names taken so far are its state.

    ``first``: each name (in list order) takes its first free column; ``best``: pairs in
    score order, each column and name used once."""
    best = strategy != "first"
    zero = F.lit(0.0)
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(
        (F.when(p["exact"], 0).otherwise(1) if best else F.lit(0)).alias("grade"), (-p["ratio"] if best else zero).alias("order"),
        p["canon_pos"].alias("canon_pos"), p["col_idx"].alias("col_idx"), p["header"].alias("header"), p["canonical"].alias("canonical"),
    )))
    chosen = "array<struct<col_idx:int,header:string,canonical:string>>"
    start = F.struct(F.array().cast("array<int>").alias("cols"), F.array().cast("array<string>").alias("names"), F.array().cast(chosen).alias("kept"))

    def step(state: Column, p: Column) -> Column:
        taken = F.array_contains(state["cols"], p["col_idx"]) | F.array_contains(state["names"], p["canonical"])
        pick = F.struct(p["col_idx"], p["header"], p["canonical"])
        return F.when(taken, state).otherwise(F.struct(
            F.array_append(state["cols"], p["col_idx"]).alias("cols"), F.array_append(state["names"], p["canonical"]).alias("names"),
            F.concat(state["kept"], F.array(pick).cast(chosen)).alias("kept"),
        ))

    return F.aggregate(ordered, start, step, lambda state: state["kept"])


def resolve_mapping(headers: DataFrame, canonical: Sequence[str], strategy: str = "best") -> DataFrame:
    """Observed headers ``(file, col_idx, header)`` -> mapped ``(file, col_idx,
    header, canonical)``, one-to-one per file.

    ``first``: canonical names in list order each take the first matching header
    not yet taken (the reference's greedy rule, which can shift columns when a
    name is missing).  ``best``: exact matches first, then by highest ratio."""
    # One assignment for each distinct list of headers: files that carry the
    # same headers share it.
    lists = (
        headers.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("cols"))
        .withColumn("sig", F.sha2(F.to_json("cols"), 256))
    )
    columns = lists.groupBy("sig").agg(F.any_value("cols").alias("cols")).select(F.col("sig").alias("file"), F.inline("cols"))
    pairs = match_pairs(columns, canonical).filter("matched")
    pair = F.struct(F.col("col_idx").cast("int").alias("col_idx"), "header", "canonical", "canon_pos", "exact", F.col("ratio").cast("double").alias("ratio"))
    # At most columns x canonical names pairs in a list.
    cand = columns.join(pairs, "header").groupBy(F.col("file").alias("sig")).agg(F.collect_list(pair).alias("pairs"))
    mapped = cand.select("sig", F.inline(_assign(F.col("pairs"), strategy)))
    return lists.select("file", "sig").join(mapped, "sig").select("file", "col_idx", "header", "canonical")


# ------------------------------------------------------------------ header hygiene


def py_repr(s: Column) -> Column:
    """Text quoted as Python prints it: single quotes, or double ones around a text with
    single quotes only; backslashes, line breaks and tabs escaped."""
    plain = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def header_issues(headers: DataFrame) -> DataFrame:
    """Per header: cleaned name, and ``issue`` when it is a nuisance column or a
    later duplicate of a cleaned name in the same file (else null).  A missing
    header is printed as the text None."""
    h = headers.withColumn("name", clean_header("header"))
    nuisance = is_nuisance_header(F.col("name"))
    # Nuisance columns do not claim a name, so they rank apart from the rest.
    w = Window.partitionBy("file", "name", "nuisance").orderBy("col_idx")
    h = h.withColumn("nuisance", nuisance).withColumn(
        "dup_rank", F.when(~F.col("nuisance"), F.row_number().over(w))
    )
    shown = F.when(F.col("header").isNull(), F.lit("None")).otherwise(F.col("name"))
    issue = (
        F.when(F.col("nuisance"), F.concat(F.lit("Omitted nuisance column at index "), F.col("col_idx").cast("string"),
                                           F.lit(": "), py_repr(shown)))
        .when(F.col("dup_rank") > 1, F.concat(F.lit("Omitted duplicate column at index "), F.col("col_idx").cast("string"),
                                              F.lit(": "), py_repr(F.col("name"))))
    )
    return h.select("file", "col_idx", "header", "name", issue.alias("issue"))


def issues_per_file(issues: DataFrame) -> DataFrame:
    """``(file, n_issues, header_issues)`` with issues in column order."""
    s = issues.filter(F.col("issue").isNotNull())
    return s.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "issue"))), lambda x: x["issue"]).alias("header_issues"),
    )


def uniquify_headers(headers: DataFrame) -> DataFrame:
    """Blank -> ``column``; the k-th repeat of a name (k >= 2) -> ``name_k``."""
    base = F.when(strip(F.coalesce(F.col("header"), F.lit(""))) == "", F.lit("column")).otherwise(strip("header"))
    h = headers.withColumn("base", base)
    k = F.row_number().over(Window.partitionBy("file", "base").orderBy("col_idx"))
    return h.select(
        "file", "col_idx", "header",
        F.when(k > 1, F.concat(F.col("base"), F.lit("_"), k.cast("string"))).otherwise(F.col("base")).alias("name"),
    )


def prepare_headers(headers: DataFrame, spec: ReportSpec) -> DataFrame:
    """Clean observed headers the way the spec's family does before matching:
    drop nuisance/duplicate columns (captive) or uniquify names (referral)."""
    if spec.drop_nuisance_headers:
        iss = header_issues(headers)
        return iss.filter(F.col("issue").isNull()).select("file", "col_idx", F.col("name").alias("header"))
    if spec.uniquify_headers:
        return uniquify_headers(headers.withColumn("header", clean_header("header"))).select(
            "file", "col_idx", F.col("name").alias("header")
        )
    return headers.select("file", "col_idx", clean_header("header").alias("header"))


# ------------------------------------------------------------------ gates and type

# Rejection messages of the three families.
INVALID_MESSAGES = {
    "captive": "Upload a valid Salesforce Captive Report file.",
    "commission": "Upload a valid Commission Report file.",
    "referral": "Upload a valid Referral Report file.",
}


def validate_files(mapped: DataFrame, spec: ReportSpec, files: DataFrame | None = None) -> DataFrame:
    """Per file: required columns present and enough target columns mapped.

    ``mapped`` is ``(file, canonical)``; ``files`` lists every file (so a file
    with no mapped column is reported too)."""
    targets = list(spec.coverage_targets)
    per = mapped.groupBy("file").agg(
        F.count_distinct(F.when(F.col("canonical").isin(*targets), F.col("canonical"))).alias("n_targets"),
        *[F.bool_or(F.col("canonical") == r).alias(f"req{i}") for i, r in enumerate(spec.required)],
    )
    if files is not None:
        per = files.select("file").distinct().join(per, "file", "left")
    has_req = F.lit(True)
    for i in range(len(spec.required)):
        has_req = has_req & F.coalesce(F.col(f"req{i}"), F.lit(False))
    n = F.coalesce(F.col("n_targets"), F.lit(0)).cast("bigint")
    enough = n >= spec.min_coverage()
    msg = INVALID_MESSAGES.get(spec.name, "Upload a valid report file.")
    missing_msg = "Missing required columns." if spec.name == "captive" else msg
    return per.select(
        "file", n.alias("n_targets"), has_req.alias("has_required"), (has_req & enough).alias("ok"),
        F.when(~has_req, F.lit(missing_msg)).when(~enough, F.lit(msg)).alias("error"),
    )


def detect_type(mapped: DataFrame, row_counts: DataFrame | None = None,
                left_tag: str = "RLIP", right_tag: str = "RAP") -> DataFrame:
    """Per file: ``combined`` / ``RLIP-only`` / ``RAP-only`` from which measure
    columns exist (after cleaning every existing measure column holds values
    whenever the file has rows); no such columns, or no rows -> ``combined``.
    Further columns of ``row_counts (file, n_rows, ...)`` are passed on."""
    per = mapped.groupBy("file").agg(
        F.bool_or(F.col("canonical").contains(left_tag)).alias("has_l"),
        F.bool_or(F.col("canonical").contains(right_tag)).alias("has_r"),
    )
    extra: list[str] = []
    filled = F.lit(True)
    if row_counts is not None:
        extra = [c for c in row_counts.columns if c not in ("file", "n_rows")]
        per = per.join(row_counts, "file", "left")
        filled = F.coalesce(F.col("n_rows"), F.lit(0)) > 0
    left, right = F.col("has_l") & filled, F.col("has_r") & filled
    kind = F.when(left & ~right, F.lit(f"{left_tag}-only")).when(right & ~left, F.lit(f"{right_tag}-only")).otherwise(F.lit("combined"))
    return per.select("file", kind.alias("file_type"), *extra)

"""URL verdicts from path rules and empirical-Bayes host reputation.

DataFrame functions only.  A rule (action, host, path) fits its host and every
subdomain of it when the url's path starts with the rule's path; the longest
rule wins.  All other urls are judged by the reputation of their host: the
labelled outcomes of its pages, shrunk towards its registered domain, which is
shrunk towards its suffix, which is shrunk towards all pages.

Each level is a beta-binomial: its prior's mean is the parent's posterior mean,
its strength k follows from the method of moments over the groups of that level
(four one-row aggregates reach the driver).  A host is blocked when the lower
bound of its posterior bad rate, mean - z * standard deviation, exceeds
``max_bad_rate``; so a host needs evidence against it before it is blocked.

Defined cases: a null url or one without ``://`` has an empty host and path, and
is judged by the pages of empty host; a host without dots is its own domain and
suffix; without any outcome the prior mean is ``prior_rate`` and nothing is
blocked; repeated outcomes of a page count once each; columns of the inputs
other than the named ones are left out, so clashing names can't matter.
Hot hosts: outcomes are pre-aggregated by host before anything is joined, and
the final join has one row per host on one side, so Spark can split the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import ascii_lower

#: (action, host, path); the contract's rule list.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels that are treated as one suffix.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule; null when none fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rhost, rpath in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        text = F.when(fits, F.lit(rhost + rpath)).otherwise(text)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(wide, two).otherwise(F.element_at(labels, -1))
    keep = F.when(wide, 3).otherwise(2)
    domain = F.concat_ws(".", F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), 3))
    return domain, suffix


def _strength(groups: DataFrame, default: float = 10.0, least: float = 0.5, most: float = 1e5) -> tuple[float, float]:
    """(mean, k) of a beta prior by moments over groups with columns n, bad."""
    r = groups.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s"),
    ).first()
    if not r["n"]:
        return 0.0, default
    n, g, m = float(r["n"]), float(r["g"]), float(r["bad"]) / float(r["n"])
    within = m * (1 - m)
    if g < 2 or within <= 0:
        return m, default
    # sum n_i (p_i - m)^2 = sum bad_i^2 / n_i - n m^2; its expectation is
    # within * ((g - 1) + rho * (n - n2 / n - (g - 1))), rho = 1 / (k + 1).
    spread = float(r["s"]) - n * m * m
    room = n - float(r["n2"]) / n - (g - 1)
    if room <= 0:
        return m, default
    rho = (spread / within - (g - 1)) / room
    k = most if rho <= 0 else min(most, max(least, 1 / rho - 1))
    return m, k


def reputations(
    pages: DataFrame, outcomes: DataFrame, z: float = 1.64, prior_rate: float = 0.1, prior_weight: float = 2.0,
) -> DataFrame:
    """One row per host of ``pages`` (page_id, url): host, domain, suffix,
    n_labelled, bad_rate (posterior mean) and bad_low (its lower bound).

    ``outcomes`` has (page_id, bad): bad is 1 for a page labelled bad, else 0;
    null outcomes don't count.
    """
    host, _ = host_and_path(F.col("url"))
    known = outcomes.where("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    per_host = (
        pages.select("page_id", host.alias("host")).join(known, "page_id", "left")
        .groupBy("host").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    )
    domain, suffix = domain_and_suffix(F.col("host"))
    per_host = per_host.withColumns({"domain": domain, "suffix": suffix})
    per_domain = per_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    per_suffix = per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    _, k_host = _strength(per_host)
    _, k_domain = _strength(per_domain)
    _, k_suffix = _strength(per_suffix)
    total = per_suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    root = ((total["bad"] or 0) + prior_rate * prior_weight) / ((total["n"] or 0) + prior_weight)

    def mean(k: float, parent: Column) -> Column:
        return (F.col("bad") + k * parent) / (F.col("n") + k)

    s = per_suffix.select("suffix", mean(k_suffix, F.lit(root)).alias("up_suffix"))
    d = per_domain.join(s, "suffix").select("domain", "suffix", mean(k_domain, F.col("up_suffix")).alias("up_domain"))
    m, total_n = F.col("bad_rate"), F.col("n") + k_host
    return (
        per_host.join(d, ["domain", "suffix"]).withColumn("bad_rate", mean(k_host, F.col("up_domain")))
        .select(
            "host", "domain", "suffix", F.col("n").alias("n_labelled"), "bad_rate",
            F.greatest(F.lit(0.0), m - z * F.sqrt(m * (1 - m) / (total_n + 1))).alias("bad_low"),
        )
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad_rate: float = 0.5, z: float = 1.64) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_low for every page."""
    host, path = host_and_path(F.col("url"))
    rep = reputations(pages, outcomes, z=z).select("host", "bad_rate", "bad_low")
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.coalesce("bad_low", F.lit(0.0)) > max_bad_rate, "block").otherwise("allow")
    return seen.join(rep, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_method).alias("verdict"), "bad_rate", "bad_low",
    )


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """Outcomes of pages from a labels table keyed like the pages: a page is bad
    when its label says low quality or toxic.  A null flag counts as unknown."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))

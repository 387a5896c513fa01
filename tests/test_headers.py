"""Header matching: values carried over from the reference's header tests, plus
the mapping cases the reference does not test (FIXTURES.md §3, §5)."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerfold.functions.text import normalize_header
from ledgerfold.operators import headers as H
from ledgerfold.spec import CAPTIVE_CLIENT, CAPTIVE_KEY, COMMISSION_COMMISSION


def _one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first()["o"]


def test_normalize(spark):
    assert _one(spark, normalize_header, "  Captive Name: Captive Name  ") == "captive name captive name"
    assert _one(spark, normalize_header, "Captive Name: Captive Name #!") == "captive name captive name"
    assert _one(spark, normalize_header, "captiev   Name:  cap   tive name") == "captiev name cap tive name"


def _matches(spark, canonical, actuals):
    hdr = spark.createDataFrame([("f", i, a) for i, a in enumerate(actuals)], H.HEADER_SCHEMA)
    got = H.match_pairs(hdr, [canonical]).filter("matched").select("header").collect()
    return {r.header for r in got}


def test_match_captive(spark):
    good = ["Captive Name: Captive Name", "captive Name: captive name", "Captive Name: Captive Name #!",
            "captiev Name: cap tive name"]
    assert _matches(spark, CAPTIVE_KEY, good + ["Gross Written Premium", ""]) == set(good)


def test_match_client(spark):
    assert _matches(spark, CAPTIVE_CLIENT, ["Captive Name: Client", "captive name: client"]) == {
        "Captive Name: Client", "captive name: client"}


def test_similarity_equals_difflib(spark):
    pairs = [("captive name captive name", "captiev name cap tive name"), ("january commission", "february commission"),
             ("popic fee rlip", "popic fee rlip fof"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", H.similarity_ratio("a", "b").alias("r"))
    for r in df.collect():
        assert abs(r.r - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12


def _mapping(spark, headers, canonical, strategy):
    hdr = spark.createDataFrame([("f", i, h) for i, h in enumerate(headers)], H.HEADER_SCHEMA)
    got = H.resolve_mapping(hdr, canonical, strategy).collect()
    return {r.header: r.canonical for r in got}


def test_mapping_typo_first_column(spark):
    m = _mapping(spark, ["captiev Name: cap tive name #!", "Captive Name: Client"], [CAPTIVE_KEY, CAPTIVE_CLIENT], "first")
    assert m["captiev Name: cap tive name #!"] == CAPTIVE_KEY


def test_mapping_month_gap(spark):
    headers = list(COMMISSION_COMMISSION[1:])  # January missing
    best = _mapping(spark, headers, list(COMMISSION_COMMISSION), "best")
    assert all(best[h] == h for h in headers)
    first = _mapping(spark, headers, list(COMMISSION_COMMISSION), "first")
    assert first["February Commission"] == "January Commission"  # the greedy shift


def test_mapping_swap(spark):
    headers = ["Captive Name: Client", "Captive Name: Captive Name"]
    best = _mapping(spark, headers, [CAPTIVE_KEY, CAPTIVE_CLIENT], "best")
    assert best == {"Captive Name: Client": CAPTIVE_CLIENT, "Captive Name: Captive Name": CAPTIVE_KEY}
    first = _mapping(spark, headers, [CAPTIVE_KEY, CAPTIVE_CLIENT], "first")
    assert first["Captive Name: Client"] == CAPTIVE_KEY  # token rule accepts it first


def test_issues_and_uniquify(spark):
    hdr = spark.createDataFrame(
        [("f", 0, "Taxes"), ("f", 1, ""), ("f", 2, "x"), ("f", 3, "Taxes ↑"), ("f", 4, "None")], H.HEADER_SCHEMA)
    iss = {r.col_idx: r.issue for r in H.header_issues(hdr).collect()}
    assert iss[0] is None
    assert iss[1] == "Omitted nuisance column at index 1: ''"
    assert iss[2] == "Omitted nuisance column at index 2: 'x'"
    assert iss[3] == "Omitted duplicate column at index 3: 'Taxes'"
    assert iss[4].startswith("Omitted nuisance")
    u = {r.col_idx: r.name for r in H.uniquify_headers(
        spark.createDataFrame([("f", 0, "A"), ("f", 1, ""), ("f", 2, "A"), ("f", 3, " "), ("f", 4, "A")], H.HEADER_SCHEMA)).collect()}
    assert u == {0: "A", 1: "column", 2: "A_2", 3: "column_2", 4: "A_3"}


def test_gate_and_type(spark):
    from ledgerfold.spec import CAPTIVE_SPEC, CAPTIVE_TARGETS

    mapped = spark.createDataFrame(
        [("ok", CAPTIVE_KEY)] + [("ok", t) for t in CAPTIVE_TARGETS[:9]]
        + [("few", CAPTIVE_KEY), ("few", "Gross Written Premium")]
        + [("nokey", t) for t in CAPTIVE_TARGETS[:12]], "file string, canonical string")
    v = {r.file: r for r in H.validate_files(mapped, CAPTIVE_SPEC).collect()}
    assert v["ok"].ok and not v["few"].ok and not v["nokey"].ok
    assert v["few"].error == "Upload a valid Salesforce Captive Report file."
    t = {r.file: r.file_type for r in H.detect_type(spark.createDataFrame(
        [("a", "POPIC Fee RLIP"), ("b", "POPIC Fee RAP"), ("c", "POPIC Fee RLIP"), ("c", "POPIC Fee RAP FOF"), ("d", "Taxes")],
        "file string, canonical string")).collect()}
    assert t == {"a": "RLIP-only", "b": "RAP-only", "c": "combined", "d": "combined"}


def test_indexed_matching_equals_all_pairs(spark):
    """Headers of table texts, misspelt names and odd texts against names with and without token rules."""
    import random

    from ledgerfold.operators.header_index import candidates, match_names, numbered_letters
    from ledgerfold.operators.headers import match_pairs
    from ledgerfold.spec import CAPTIVE_SPEC, COMMISSION_SPEC, KEY_RULES

    rng = random.Random(8)
    canonical = list(dict.fromkeys([*CAPTIVE_SPEC.canonical, *COMMISSION_SPEC.canonical]))

    def bent(name):
        i = rng.randrange(len(name))
        return rng.choice([name[:i] + name[i + 1:], name[:i] + "e" + name[i:], name.upper(), "X " + name, name[: max(2, len(name) // 2)], name[::-1]])

    texts = [bent(rng.choice(canonical)) for _ in range(500)] + canonical + ["", "  ", "#", "a", "client", "captiev nme", "1994", None, "STANDARD TIN", "Sales person " * 9]
    headers = spark.createDataFrame([(t,) for t in texts], "header string")
    names = spark.createDataFrame([(c, KEY_RULES.get(c)) for c in canonical], "canonical string, rule string")
    got = {(r.header, r.canonical, round(r.ratio, 9)) for r in match_names(headers, names).collect()}
    want = {(r.header, r.canonical, round(r.ratio, 9)) for r in match_pairs(headers, canonical).filter("matched").collect()}
    assert got == want and len(want) > 300
    assert candidates(headers, names).count() < len(set(texts)) * len(canonical) / 2
    assert candidates(headers.limit(0), names).count() == 0
    assert spark.range(1).select(numbered_letters(F.lit("")).alias("x")).first().x == []


def test_issue_texts_are_quoted_as_python_does(spark):
    texts = ["x", "it's", 'say "a"', "it's \"b\"", "back\\slash", "two\nlines\tand"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.py_repr(F.col("t")).alias("r")).collect()
    assert all(r.r == repr(r.t) for r in got)
    one = spark.createDataFrame([("f", 0, None), ("f", 1, " ")], "file string, col_idx int, header string")
    assert [r.issue[-8:] for r in H.header_issues(one).orderBy("col_idx").collect()][0] == ": 'None'"

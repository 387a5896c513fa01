"""Pseudonyms: formats kept, bijective, equal values linked, checks honoured."""

import re

from ledgerfold.llm.pii import replace_pii


def _luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def _run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r.n) for r in replace_pii(df, key, count_col="n").orderBy("doc_id").collect()]


def test_formats_and_links(spark):
    texts = ["pay 4929348385146306, 4929-3483-8514-6306 and 4952935900253052!", "again 4929348385146306 end", "ip 97.51.17.173.",
             "call +1 (017) 555-7713", "born 2024-02-29 or 01/31/1999", "x.34@mail7.example.com", "111-22-3333"]
    out = [t for t, _ in _run(spark, texts)]
    a, dashed, b = re.findall(r"\d[\d-]{15,}", out[0])
    assert dashed.replace("-", "") == a != "4929348385146306" and b != a and _luhn(a) and _luhn(b)
    assert a in out[1]
    ip = re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+)\.", out[2])
    assert ip and all(int(x) < 256 for x in ip.groups()) and "97.51.17.173" not in out[2]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}", out[3]) and "555-7713" not in out[3]
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d or \d\d/\d\d/\d{4}", out[4]) and "2024-02-29" not in out[4]
    assert "x.34" not in out[5] and "@" in out[5]
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", out[6]) and out[6] != texts[6]


def test_invalid_values_stay(spark):
    texts = ["4929348385146307", "999.1.1.1", "31.02.2020", "1.2.3.4.5", "abc4929348385146306", "no digits", None, ""]
    assert _run(spark, texts) == [(t, 0) for t in texts]


def test_injective_and_keyed(spark):
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1900, 1999, 2024, 2099) for m in range(1, 13) for d in range(1, 29)]
    out = [t for t, _ in _run(spark, [" ".join(days)])][0].split(" ")
    assert len(set(out)) == len(days) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in out)
    assert _run(spark, [days[0]], "k")[0] != _run(spark, [days[0]], "other")[0]
    phones = [f"555-01{i:02d}" for i in range(100)]
    got = _run(spark, [f"212-{p}" for p in phones])
    assert len({t for t, _ in got}) == 100


def test_long_texts_and_other_columns(spark):
    long = "a.b" * 40_000 + " 4929348385146306 " + "9" * 40_000 + " @" * 1000
    df = spark.createDataFrame([(1, long, 5, "s"), (1, long, 5, "s")], "doc_id long, text string, n long, __x string")
    rows = replace_pii(df, "k").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n == 5 and len(rows[0].text) == len(long)
    assert "4929348385146306" not in rows[0].text
    assert replace_pii(df.limit(0), "k").count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = replace_pii(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

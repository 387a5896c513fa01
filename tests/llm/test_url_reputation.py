"""Rules, host parsing and shrinkage."""

import re

from pyspark.sql import functions as F

from ledgerfold.llm import url_reputation as U


def _host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def _rule(host, path):
    fits = [(len(h) + len(p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "https://m.www.example.com/en/", "https://example.com", "ftp://x.net/es/a", "//x.net/fr/", None, "", "http://x.net/fr/z",
        "http://x.org?u=http://b.com/en/", "http://com/", "http://notexample.com/en/", "http://Ünï.net/es", "x://y://z/en", "http://a.net#f/fr/"]


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, URLS[0], "clash")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = U.judge(pages, none).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = _host(URLS[r.page_id])
        rule, action = _rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (action or "allow")
    assert U.judge(pages.limit(0), none).count() == 0


def test_bad_host_is_blocked_and_thin_evidence_is_shrunk(spark):
    pages, out = [], []
    for h in range(40):
        for k in range(50):
            pages.append((len(pages), f"http://h{h}.site{h % 4}.org/a/{k}"))
            out.append((len(out), 1 if h == 0 else int(k % 25 == 0)))
    pages.append((len(pages), "http://thin.site1.org/a"))
    out.append((len(out), 1))
    p = spark.createDataFrame(pages, "page_id long, url string")
    o = spark.createDataFrame(out + [(None, 1), (3, None)], "page_id long, bad int")
    rep = {r.host: r for r in U.reputations(p, o).collect()}
    assert rep["h0.site0.org"].bad_rate > 0.8 and rep["h1.site1.org"].bad_rate < 0.1
    assert rep["thin.site1.org"].bad_rate < 0.9 and rep["thin.site1.org"].bad_low < 0.5
    verdict = {r.host: r.verdict for r in U.judge(p, o).select("host", "verdict").distinct().collect()}
    assert verdict["h0.site0.org"] == "block" and sum(v == "block" for v in verdict.values()) == 1


def test_domain_and_suffix(spark):
    d, s = U.domain_and_suffix(F.col("h"))
    rows = spark.createDataFrame([("a.b.example.com",), ("x.co.uk",), ("a.x.co.uk",), ("com",), ("",)], "h string").select("h", d, s).collect()
    assert [tuple(r) for r in rows] == [("a.b.example.com", "example.com", "com"), ("x.co.uk", "x.co.uk", "co.uk"), ("a.x.co.uk", "x.co.uk", "co.uk"), ("com", "com", "com"), ("", "", "")]


def test_native_plan(spark, sf_small):
    from ledgerfold.llm.queries import QUERIES

    df = QUERIES["op10_url_reputation"](spark, sf_small)
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())
    assert df.count() == spark.read.parquet(f"{sf_small}/pages.parquet").count()

"""Mixture weights, budgets and block permutations."""

import math
from collections import Counter

import pytest

from ledgerfold.llm import mixing as M


def test_exponent_meets_repeat_limit_and_entropy():
    shares = [0.6, 0.3, 0.09, 0.01]
    e = M.bisect_exponent(shares, None, 4.0)
    w = M.tempered(shares, e)
    repeats = [a / b for a, b in zip(w, shares)]
    assert max(repeats) / min(repeats) == pytest.approx(4.0, rel=1e-6)
    e = M.bisect_exponent(shares, 0.9, None)
    assert M.entropy(M.tempered(shares, e)) == pytest.approx(0.9 * math.log(4), rel=1e-6)
    assert M.bisect_exponent([1.0], 0.5, 2.0) == 1.0


def test_budgets_are_realised(spark):
    rows = [(i, "w " * (1 + i % 7), ("big", "mid", "mid", "tiny")[0 if i % 10 < 6 else 1 if i % 10 < 9 else 3]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, plan = M.mix(df, max_repeats=3.0, n_blocks=64)
    got = out.collect()
    tokens, copies = Counter(), Counter()
    for r in got:
        tokens[r.source] += r["__tokens"]
        copies[r.doc_id] += 1
    assert set(copies) == {r[0] for r in rows}, "no document is lost"
    assert max(copies.values()) <= 3
    for s, b in plan.budgets.items():
        assert b - 1e-6 <= tokens[s] <= b + 3 * plan.tokens[s] / 64
    again, _ = M.mix(df, max_repeats=3.0, n_blocks=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    half, plan = M.mix(df, max_repeats=None, budget_tokens=sum(plan.tokens.values()) / 2, n_blocks=64)
    assert 0.5 * 4000 * 0.8 < half.count() < 0.5 * 4000 * 1.2


def test_order_of_an_epoch_is_a_permutation(spark):
    df = spark.createDataFrame([(i, "a b", "s" if i % 9 else "t") for i in range(900)], "doc_id long, text string, source string")
    out, _ = M.mix(df, max_repeats=2.5, n_blocks=16)
    seen = {}
    for r in out.collect():
        seen.setdefault((r.source, r["__epoch"]), set()).add(r["__order"])
    for orders in seen.values():
        assert orders == set(range(1, len(orders) + 1))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "a b", None, "y"), (2, "a b", None, "y"), (3, "", "s", "z"), (4, "c\x0bd\x0ce f\u00a0g", "t", "z")],
                               "doc_id long, text string, source string, __x string")
    out, plan = M.mix(df)
    n = Counter((r.doc_id, r.source, r["__x"]) for r in out.collect())
    assert set(n) == {(1, None, "x"), (2, None, "y"), (3, "s", "z"), (4, "t", "z")} and n[(2, None, "y")] >= 2
    assert plan.tokens == {None: 4, "s": 0, "t": 4}
    assert M.mix(df.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        M.mix(df, max_sources=1)

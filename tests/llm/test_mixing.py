"""Mixing: budgets met to half a document, caps kept, odd sources handled."""

import random

import pytest
from pyspark.sql import functions as F

from flipgraph.llm import mixing as M

TARGET = "mix_id int, source string, target_share double, max_repeats int, size_factor double, tokens string"


def run(spark, docs, targets, rows_per_range=50_000):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, source string, n int, times string, until int")
    t = spark.createDataFrame([(*r, "x") for r in targets], TARGET)
    used = [(r.mix_id, r.doc, r.source, r.tokens, r.times) for r in M.mix(d, t, "doc_id", "source", F.col("n"), rows_per_range).collect()]
    shares = {(r.mix_id, r.source): r for r in M.mix_shares(d, t, "doc_id", "source", F.col("n")).collect()}
    return used, shares


def test_budgets_and_caps(spark):
    rnd = random.Random(2)
    docs = [(i, "big" if i % 3 else "small", rnd.randrange(1, 50)) for i in range(3000)] + [(5000 + i, "tiny", 10) for i in range(4)] + [(6000, None, 70), (6001, "big", None)]
    total = sum(n or 0 for _, _, n in docs)
    targets = [(1, "big", 0.5, 1, 0.4), (1, "small", 0.3, 9, 2.0), (1, "tiny", 0.1, 3, 0.4), (1, "gone", 0.1, 2, 0.4), (2, "small", 1.0, 5, 0.1)]
    for ranges in (50_000, 100):
        used, shares = run(spark, docs, targets, ranges)
        size = {s: sum(n or 0 for _, x, n in docs if x == s) for s in ("big", "small", "tiny")}
        for m, s, share, cap, factor in targets:
            got = sum(t * k for a, _, b, t, k in used if (a, b) == (m, s))
            budget = int(share * factor * total)
            most = cap * size.get(s, 0)
            assert abs(got - min(budget, most)) <= 25
            assert all(1 <= k <= cap for a, _, b, _, k in used if (a, b) == (m, s))
            assert len({k for a, _, b, _, k in used if (a, b) == (m, s)}) <= 2
        assert len({(m, d) for m, d, *_ in used}) == len(used)
        assert shares[1, "gone"].limit == "absent" and shares[1, "tiny"].limit == "cap" and shares[1, "big"].limit is None
        assert sum(shares[1, s].actual_share for s in ("big", "small", "tiny", "gone")) == pytest.approx(1)
        assert not any(s is None for _, _, s, _, _ in used)


def test_order_is_random_but_fixed(spark):
    docs = [(i, "s", 1) for i in range(2000)]
    a, _ = run(spark, docs, [(1, "s", 0.5, 1, 1.0)])
    b, _ = run(spark, docs[::-1], [(1, "s", 0.5, 1, 1.0)], 90)
    ids = {d for _, d, *_ in a}
    assert len(ids) == 1000 and 350 < sum(d < 1000 for d in ids) < 650
    assert len({d for _, d, *_ in b}) == 1000


def test_odd_targets(spark):
    docs = [(1, "s", 5), (2, "s", 5), (2, "s", 5)]
    used, shares = run(spark, docs, [(1, "s", None, None, 1.0), (2, "s", 1.0, None, 5.0), (3, None, 1.0, 1, 1.0), (4, "s", 0.5, 0, 1.0)])
    assert {m for m, *_ in used} == {2} and sum(t * k for m, _, _, t, k in used) == 15
    assert shares[2, "s"].limit == "cap"
    assert run(spark, [], [(1, "s", 1.0, 1, 1.0)])[0] == [] and run(spark, docs, [])[0] == []


def test_real_table(spark, sf):
    for r in M.p7_shares(spark, sf).collect():
        assert r.most_times <= r.max_repeats
        if r.limit is None:
            assert abs(r.used_tokens - r.budget) <= 7000


def test_a_missed_budget_always_has_its_reason(spark, sf):
    for _ in range(4):
        for r in M.p7_shares(spark, sf).collect():
            assert r.limit is not None or abs(r.used_tokens - r.budget) <= 7000, r


def test_documents_without_id_are_spread(spark):
    docs = [(None, "s", 1)] * 400 + [(i, "s", 1) for i in range(10)]
    used, _ = run(spark, docs, [(1, "s", 0.5, 1, 1.0)], 20)
    assert sum(t * k for *_, t, k in used) == 205

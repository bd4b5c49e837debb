"""Top N per group against sorting, for every shape of input."""

import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from flipgraph.llm import topn as T

SCHEMA = "g long, item string, score double, place int, grp string"
VALUES = st.one_of(st.none(), st.just(math.nan), st.sampled_from([0.0, -0.0, 1.0, -1.0, 0.5, math.inf, -math.inf]), st.floats(-3, 3))


def expected(rows, n):
    best = {}
    for g, item, score, *_ in rows:
        if item is None or score is None or math.isnan(score):
            continue
        best.setdefault(g, {})
        best[g][item] = max(best[g].get(item, -math.inf), score + 0.0)
    out = set()
    for g, items in best.items():
        for p, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:n]):
            out.add((g, p + 1, i, s))
    return out


def run(spark, rows, n=3):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    return {(r.g, r.place, r.item, r.score) for r in T.top_n_per_group(df, "g", "item", "score", n).collect()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from([None, "", "a", "b", "ä", "\U0001f600", "￿", "aa"]), VALUES), max_size=40), st.integers(1, 4))
def test_against_sorting(spark, rows, n):
    assert run(spark, rows, n) == expected(rows, n)


def test_hot_group_and_small_buffers(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(1 if i % 3 == 0 else int(rng.integers(2, 300)), f"e{rng.integers(0, 900)}", float(rng.integers(0, 5))) for i in range(6000)]
    monkeypatch.setattr(T, "BUFFER_ROWS", 100)
    assert run(spark, rows) == expected(rows, 3)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None, 1.0), (1, "a", None), (1, "a", math.nan)]) == set()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 10**6)), min_size=1, max_size=60, unique=True), st.integers(1, 5))
def test_cutoffs_leave_exactly_n(pairs, n):
    g, c = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.int64)
    cut = T.bisect_cutoffs(g, c, 5, n)
    for k in range(5):
        mine = c[g == k]
        assert (mine > cut[k]).sum() == min(n, len(mine))


def test_codes_keep_the_order():
    s, i = np.array([1.0, 0.0, -0.0, 1.0]), pa.array(["b", "x", "a", "é"])
    code = T.order_codes(s, i)
    assert code[0] > code[3] > code[2] > code[1]


def test_tables(same_rows):
    for name, sql in T.SQL.items():
        same_rows(T.QUERIES[name], sql)

"""Ranks, scales and quantiles of groups that are split over tasks, against plain computing; order-aware answers."""

import random

import numpy as np
import pytest

from flipgraph.operators import evaluator as E
from flipgraph.operators import quantiles as Q
from flipgraph.operators import ranking as W


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(3)
    rows = [(1, f"e{i:04}", float(rnd.randrange(40))) for i in range(900)] + [(2, "a", 1.0), (2, "b", None), (None, "x", 2.0), (None, "y", 2.0)]
    return rows, spark.createDataFrame([(*r, "clash", 7) for r in rows], "run_id long, element_id string, score double, rn string, _n int").drop("rn", "_n")


def test_ranks_of_a_hot_group(scores):
    rows, df = scores
    got = {(r.run_id, r.element_id): r.rn for r in W.ranked_split(df, ["run_id"]).collect()}
    for run in (1, 2, None):
        order = sorted((x for x in rows if x[0] == run), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        assert [got[run, e] for _, e, _ in order] == list(range(1, len(order) + 1))
    assert W.ranked_split(df.limit(0), ["run_id"]).count() == 0


def test_scales(scores):
    _, df = scores
    got = {(r.run_id, r.element_id): r.s for r in W.minmax_scaled(df.where("run_id IS NOT NULL"), ["run_id"], "score", "s").collect()}
    assert min(v for (k, _), v in got.items() if k == 1) == 0 and max(v for (k, _), v in got.items() if k == 1) == 1 and got[2, "a"] == 1


def test_quantiles(scores):
    rows, df = scores
    got = {r.run_id: r for r in Q.quantiles(df, "score", ["run_id"], {"a": 0.25, "m": 0.5, "z": 1.0}).collect()}
    for run in (1, 2, None):
        v = [x for k, _, x in rows if k == run and x is not None]
        assert [got[run].a, got[run].m, got[run].z] == pytest.approx(np.quantile(v, [0.25, 0.5, 1.0]).tolist())
    v = sorted(x for *_, x in rows if x is not None)
    assert Q.quantiles(df, "score", [], {"m": 0.5}, upper=True).first().m == v[len(v) // 2]
    assert Q.quantiles(df.limit(0), "score", ["run_id"], {"m": 0.5}).count() == 0


def test_inversions(spark):
    perms = [[1], [1, 2, 3], [3, 2, 1], random.Random(1).sample(range(300), 300)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(perms)] + [(9, None)], "i int, p array<int>")
    got = {r.i: r.t for r in df.select("i", W.tau_of("p").alias("t")).collect()}
    long = perms[3]
    pairs = [np.sign(long[b] - long[a]) for a in range(300) for b in range(a + 1, 300)]
    assert got[0] is None and got[9] is None and (got[1], got[2]) == (1, -1) and got[3] == pytest.approx(np.mean(pairs))


def test_order_changes_a_positional_answer(spark):
    a, b = "the brass lantern hangs here", "the brass lantern is kept by Kola"
    rows = [(1, s, c, "Who kept the brass lantern", "Kola") for s, c in (("ab", f"{a}\n{b}"), ("ba", f"{b}\n{a}"))] + [(2, "n", "", None, None)]
    got = {(r.qid, r.state): (r.answer, r.score) for r in E.Positional(bias=0.5).evaluate(spark.createDataFrame(rows, "qid long, state string, context string, question string, reference string")).collect()}
    assert got[1, "ab"] == (a, 0) and got[1, "ba"] == (b, 1) and got[2, "n"][1] == 0

import math
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flipgraph.operators import attribution as T
from flipgraph.plans import attribution as PT
from flipgraph.plans import registry

GAMES = st.integers(2, 4).flatmap(lambda n: st.lists(st.floats(-5, 5, allow_nan=False), min_size=1 << n, max_size=1 << n).map(lambda u: (n, u)))


def table(spark, games):
    return spark.createDataFrame([(q, m, float(x)) for q, u in enumerate(games) for m, x in enumerate(u)], "qid long, mask int, u double")


def any_game(games):
    """A worth function of games that are told apart by their number of elements."""
    by_size = {int(np.log2(len(g))): np.asarray(g, float) for g in games}
    return lambda scores, x: by_size[len(scores)][(np.asarray(x).astype(int) @ (1 << np.arange(len(scores))))]


def members(spark, sizes):
    return spark.createDataFrame([(n, i, 0.1 * i) for n in sizes for i in range(n)], "qid long, i int, score double")


def test_exact_values_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BITS", 3)  # several blocks a question
    rng = np.random.default_rng(3)
    games = [rng.normal(size=1 << n) for n in (1, 2, 3, 4, 5, 6)]
    e, worth = members(spark, (1, 2, 3, 4, 5, 6)), any_game(games)
    shap = {(r.qid, r.i): r.value for r in T.exact_shapley(e, worth).collect()}
    banz = {(r.qid, r.i): r.value for r in T.exact_banzhaf(e, worth).collect()}
    loo = {(r.qid, r.i): r.value for r in T.leave_one_out(e, worth).collect()}
    inter = {(r.qid, r.i, r.j): r.value for r in T.interactions(e, worth).collect()}
    for g in games:
        n, full = int(np.log2(len(g))), len(g) - 1
        want = T.shapley_of_game(dict(enumerate(g)), n)
        assert sum(shap[n, i] for i in range(n)) == pytest.approx(g[full] - g[0])
        for i in range(n):
            assert shap[n, i] == pytest.approx(want[i])
            assert banz[n, i] == pytest.approx(np.mean([g[m | 1 << i] - g[m] for m in range(1 << n) if not m >> i & 1]))
            assert loo[n, i] == pytest.approx(g[full] - g[full ^ 1 << i])
            for j in range(i + 1, n):
                each = [(m.bit_count(), g[m | 1 << i | 1 << j] - g[m | 1 << i] - g[m | 1 << j] + g[m]) for m in range(1 << n) if not m >> i & 1 and not m >> j & 1]
                assert inter[n, i, j] == pytest.approx(sum(x / ((n - 1) * math.comb(n - 2, k)) for k, x in each))
    pairs = {(r.a, r.b) for r in T.hamming_pairs(spark.createDataFrame([(0, 3, m) for m in range(8)], "qid long, n int, mask long")).collect()}
    assert pairs == {(a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b).bit_count() == 1}


@settings(max_examples=30, deadline=None)
@given(GAMES)
def test_full_kernel_fit_is_the_shapley_value(game):
    n, u = game
    g = dict(enumerate(u))
    assert np.allclose(T.kernel_shap(g, n), T.shapley_of_game(g, n), atol=1e-3)


def test_estimators_agree_on_additive_games(spark):
    w = np.array([1.0, -2.0, 0.5])
    game = [float(T.bits(np.array([m]), 3)[0] @ w) for m in range(8)]
    u = table(spark, [game])
    for method in ("tmc", "beta", "wss", "faith", "wss_hybrid"):
        got = [r.value for r in T.estimate(u, method).orderBy("i").collect()]
        assert np.allclose(got, w, atol=0.02), method
    assert np.allclose([r.value for r in T.estimate(u, "fm").orderBy("i").collect()], w, atol=0.2)
    lasso = T.context_cite(dict(enumerate(game)), 3, 0)
    assert np.sign(lasso).tolist() == np.sign(w).tolist()


def test_minimal_combinations(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BITS", 2)
    rng = np.random.default_rng(5)
    games = [rng.random(1 << n) * np.array([m.bit_count() for m in range(1 << n)]) for n in (3, 4, 5)]
    got = {r.qid: r for r in T.minimal_combination(members(spark, (3, 4, 5)), any_game(games)).collect()}
    for g in games:
        n, full = int(np.log2(len(g))), len(g) - 1
        total = lambda m, n=n: round(sum(0.1 * i for i in range(n) if m >> i & 1), 9)
        order = sorted(range(1 << n), key=lambda m: (m.bit_count(), -total(m), m))
        assert got[n].up_mask == next(m for m in order if g[m] >= 0.5 * g[full])
        assert got[n].down_mask == next(m for m in order if g[full ^ m] < 0.5 * g[full])
        assert got[n].up == got[n].up_mask.bit_count()


def test_tables_of_coalitions(spark):
    e = members(spark, (1, 3, 12))
    got = {}
    for r in T.coalitions(e, 4, draws=20).collect():
        got.setdefault(r.qid, set()).add(r.mask)
    assert got[1] == {0, 1} and got[3] == set(range(8)) and {0, 4095} < got[12] and 15 < len(got[12]) <= 22
    kernel = T.kernel_coalitions(e, draws=20, neighbours=True).collect()
    assert {1 << i for i in range(12)} | {4095 ^ 1 << i for i in range(12)} <= {r.mask for r in kernel if r.qid == 12}
    pairs = T.paired_coalitions(e, 5).collect()
    assert all(r.b == r.a | 1 << r.i and not r.a >> r.i & 1 for r in pairs) and {r.qid for r in pairs} == {3, 12}
    with pytest.raises(Exception, match="more than 60 elements"):
        T.coalitions(members(spark, (61,))).count()


def test_best_subset_and_drop(spark):
    rng = np.random.default_rng(8)
    g = rng.random(32)
    e, worth = members(spark, (5,)), any_game([g])
    best = T.best_subset(e, worth).first()
    want = min(combinations(range(5), 2), key=lambda c: (g[31 ^ sum(1 << i for i in c)], c))
    assert best.removed == ",".join(map(str, want))
    top = sorted(sorted((r.value, r.i) for r in T.exact_shapley(e, worth).collect())[-2:], key=lambda x: x[1])
    drop = T.drop_of_best(e, T.exact_shapley(e, worth), worth).first()
    assert drop.removed == ",".join(str(i) for _, i in top) and drop.drop_ == pytest.approx(g[31] - g[31 ^ sum(1 << i for _, i in top)])


def shapley_of_worth(scores):
    """Closed form: its own score, and half of the Shapley value of a maximum of positive scores."""
    low = np.sort(scores)
    steps = np.diff(np.r_[0, low]) / np.arange(len(low), 0, -1)
    return scores + 0.5 * np.array([steps[low <= x].sum() for x in scores])


def test_estimators_take_games_too_large_for_a_table():
    scores = np.linspace(0.1, 1.0, 26)
    want = shapley_of_worth(scores)
    small = T.Drawn(lambda x: PT.worth(scores[:6], x), 6)
    assert np.allclose(T.shapley_of_game({m: small[m] for m in range(64)}, 6), shapley_of_worth(scores[:6]), atol=1e-5)
    for method, run in T.ESTIMATORS.items():
        got = run(T.Drawn(lambda x: PT.worth(scores, x), 26), 26, 7)
        assert got.shape == (26,) and np.isfinite(got).all(), method
        if method in ("tmc", "wss", "wss_hybrid"):
            assert np.allclose(got, want, atol=0.06), method
        assert run(T.Drawn(lambda x: PT.worth(np.ones(70), x), 70), 70, 7).shape == (70,), method


def test_every_question_takes_part(spark, sf):
    n = {r.qid: r.n for r in PT.elements(spark, sf).groupBy("qid").count().withColumnRenamed("count", "n").collect()}
    assert max(n.values()) > T.ALL_UP_TO
    for query in ("att_wss", "att_facile", "att_exact_shapley"):
        got = registry.queries()[query](spark, sf).groupBy("qid").count().collect()
        assert {r.qid: r["count"] for r in got} == n
    assert registry.queries()["att_utilities"](spark, sf).select("qid").distinct().count() == len(n)


def two_additive(n, seed=4):
    rng = np.random.default_rng(seed)
    w, p = rng.normal(size=n), np.triu(rng.normal(size=(n, n)), 1)
    return T.Drawn(lambda x: x @ w + ((x @ p) * x).sum(1), n), w + 0.5 * (p.sum(0) + p.sum(1))


@pytest.mark.parametrize("method", ["facile", "facilehp", "faith", "faith_shapley"])
def test_second_order_fits_meet_second_order_games(method):
    for n in (1, 2, 6, 14):
        game, want = two_additive(n)
        assert np.allclose(T.ESTIMATORS[method](game, n, 3), want, atol=0.05), (method, n)


def test_fits_differ_where_they_must():
    scores = np.linspace(0.1, 1.0, 8)
    game = T.Drawn(lambda x: PT.worth(scores, x), 8)
    banzhaf = np.array([np.mean([game[m | 1 << i] - game[m] for m in range(256) if not m >> i & 1]) for i in range(8)])
    for method in ("facile", "facilehp", "faith_shapley"):
        assert np.abs(T.ESTIMATORS[method](game, 8, 3) - banzhaf).max() > 1e-3, method
    assert np.allclose(T.ESTIMATORS["faith_shapley"](game, 8, 3).sum(), game[255], atol=0.01)  # the whole is shared out


def test_surrogate_of_a_graph():
    triples = [("A", "kept the brass lantern", "B"), ("B", "sells barley", "C"), ("C", "rows a boat", "A")]
    got, bad = T.smile_values(triples, "Who kept the brass lantern?", 1, 60)
    assert not bad and max((e for e in got if e.startswith("R::")), key=got.get) == "R::A->B"
    assert got["E::A"] == pytest.approx((got["R::A->B"] + got["R::C->A"]) / 2)
    assert T.smile_values(triples[:1], "q", 1) == ({"R::A->B": 0.0, "E::A": 0.0, "E::B": 0.0}, True)


def test_surrogates_of_odd_rows(spark):
    kind = "qid long, question string, triples array<struct<src:string,description:string,tgt:string>>"
    rows = [(1, None, None), (2, "q", []), (3, None, [("a", None, "b"), ("a", None, "b")]), (4, "q " * 9000, [("a", "q " * 9000, "b"), ("b", "x", "b")])]
    got = T.smile(spark.createDataFrame(rows, kind)).collect()
    assert {r.qid for r in got} == {3, 4} and all(np.isfinite(r.value) for r in got)

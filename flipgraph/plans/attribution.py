"""Queries of the attribution estimators.

The game of a question: its elements are those of its exact run; a coalition's utility is the sum of its elements'
scores and half of the largest. Every question takes part. Exact values are sums over all coalitions; their SQL twins
use the closed forms that this game has. Tables of coalitions hold all of them up to ten elements and drawn ones above.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipgraph.functions.vectors import jensen_shannon
from flipgraph.operators import attribution as T
from flipgraph.operators import ranking as W
from flipgraph.operators.aggregates import rnd
from flipgraph.plans import aggregates as PA
from flipgraph.plans.catalog import Catalog
from flipgraph.session import cut
from flipgraph.sources import records as R

C = Catalog()
DRAWS = 256

EL = f"""{PA.TWO}, sized AS (SELECT qid, CAST(count(*) AS INT) AS n FROM a GROUP BY 1), el AS (SELECT a.qid, n, element_id, score, CAST(row_number() OVER (PARTITION BY a.qid ORDER BY element_id) - 1 AS INT) AS i FROM a JOIN sized ON sized.qid = a.qid)"""
#: 60 bits of a hash in SQL.
HASH = "CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
GAME = f"""{EL}, masks AS (SELECT qid, n, unnest(range(CAST(pow(2, n) AS BIGINT))) AS mask FROM sized WHERE n <= {T.ALL_UP_TO}
 UNION ALL SELECT DISTINCT qid, n, mask FROM (SELECT qid, n, {HASH.format(x="qid || '|' || t || '|0'")} & ((CAST(1 AS BIGINT) << n) - 1) AS mask FROM (SELECT qid, n, unnest(range(1, {DRAWS + 1})) AS t FROM sized WHERE n > {T.ALL_UP_TO}) UNION ALL SELECT qid, n, unnest([CAST(0 AS BIGINT), (CAST(1 AS BIGINT) << n) - 1]) FROM sized WHERE n > {T.ALL_UP_TO})),
util AS (SELECT m.qid, m.n, m.mask, round(coalesce(sum(el.score) + 0.5e0 * max(el.score), 0.0e0), 12) AS u FROM masks m LEFT JOIN el ON el.qid = m.qid AND ((m.mask >> el.i) & 1) = 1 GROUP BY 1, 2, 3)"""


def elements(s: SparkSession, d: str) -> DataFrame:
    """Numbered elements of each question."""
    a, _b = PA.two_runs(s, d)
    return a.withColumn("i", (F.row_number().over(Window.partitionBy("qid").orderBy("element_id")) - 1).cast("int"))


def utilities(s: SparkSession, d: str) -> DataFrame:
    e = elements(s, d)
    j = T.coalitions(e, draws=DRAWS).join(e.select("qid", "i", "score"), "qid").withColumn("score", F.when(F.expr("(shiftright(mask, i) & 1) = 1"), F.col("score")))
    u = F.coalesce(F.sum("score") + 0.5 * F.max("score"), F.lit(0.0))
    return j.groupBy("qid", "n", "mask").agg(rnd(u, 12).alias("u"))


def worth(scores: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The utilities of ``utilities``, of the coalitions in the rows of ``x``; null scores count as absent."""
    here = ~np.isnan(scores)
    if not here.all():
        scores, x = scores[here], x[:, here]
    if not len(scores):
        return np.zeros(len(x))
    best = np.where(x > 0, scores, -np.inf).max(1)
    return x @ scores + 0.5 * np.where(np.isfinite(best), best, 0.0)


def explained(gap: Column, var: Column) -> Column:
    """R2 of a group; null where there is hardly anything to explain."""
    return F.when(F.sum(var * var) > 1e-12, 1 - F.sum(gap * gap) / F.sum(var * var))


def settled(c: Column) -> Column:
    """8 digits; halves, and what arithmetic puts just below them, away from zero."""
    return F.signum(c) * F.floor(F.abs(c) * 1e8 + 0.501) / 1e8 + 0.0


def settled_sql(x: str) -> str:
    return f"sign({x}) * floor(abs({x}) * 1e8 + 0.501e0) / 1e8 + 0.0e0"


def values(df: DataFrame) -> DataFrame:
    return df.withColumn("value", settled(F.col("value")))


@C.add("gen_masks", f"{GAME} SELECT qid, n, mask FROM masks")
def _(s, d):
    return T.coalitions(elements(s, d), draws=DRAWS)


_ENDS = "SELECT qid, n, unnest([CAST(0 AS BIGINT), (CAST(1 AS BIGINT) << n) - 1]) AS mask FROM sized"


# The sizes' cumulative odds, by n (no correlated windows).
_ODDS = "ns AS (SELECT DISTINCT n FROM sized WHERE n > 1), odds AS (SELECT n, k, sum(1.0e0 / (k * (n - k))) OVER (PARTITION BY n ORDER BY k) AS c, sum(1.0e0 / (k * (n - k))) OVER (PARTITION BY n) AS total FROM (SELECT n, unnest(range(1, n)) AS k FROM ns))"
_KERNEL = f"""{EL}, {_ODDS}, tr AS (SELECT qid, n, unnest(range(1, 33)) AS t FROM sized WHERE n > 1), tk AS (SELECT tr.qid, tr.n, tr.t, min(o.k) AS k FROM tr JOIN odds o ON o.n = tr.n AND o.c > {HASH.format(x="tr.qid || '|' || tr.t || '|0'")} / 1152921504606846976.0e0 * o.total GROUP BY 1, 2, 3),
te AS (SELECT qid, n, t, k, CAST(i AS INT) AS i, row_number() OVER (PARTITION BY qid, t ORDER BY {HASH.format(x="qid || '|' || t || '|' || i || '|0'")}, i) AS rn FROM (SELECT *, unnest(range(n)) AS i FROM tk)),
km AS (SELECT qid, n, CAST(sum(CASE WHEN rn <= k THEN CAST(1 AS BIGINT) << i ELSE 0 END) AS BIGINT) AS mask FROM te GROUP BY qid, n, t UNION ALL {_ENDS})"""


@C.add("gen_masks_kernel", f"{_KERNEL} SELECT DISTINCT qid, n, mask FROM km")
def _(s, d):
    return T.kernel_coalitions(elements(s, d))


@C.add("gen_masks_near", f"{_KERNEL}, one_ AS (SELECT qid, n, unnest(range(n)) AS i FROM sized) SELECT DISTINCT qid, n, mask FROM (SELECT * FROM km UNION ALL SELECT qid, n, CAST(1 AS BIGINT) << CAST(i AS INT) FROM one_ UNION ALL SELECT qid, n, (CAST(1 AS BIGINT) << n) - 1 - (CAST(1 AS BIGINT) << CAST(i AS INT)) FROM one_)")
def _(s, d):
    """The neighbours of the empty and the whole coalition, and draws by kernel."""
    return T.kernel_coalitions(elements(s, d), neighbours=True)


@C.add("gen_pairs", f"""{EL}, {_ODDS}, tr AS (SELECT qid, n, t, CAST({HASH.format(x="qid || '|' || t || '|0|i'")} % n AS INT) AS i FROM (SELECT qid, n, unnest(range(1, 17)) AS t FROM sized WHERE n > 1)), tk AS (SELECT tr.qid, tr.n, tr.t, tr.i, min(o.k) AS k FROM tr JOIN odds o ON o.n = tr.n AND o.c > {HASH.format(x="tr.qid || '|' || tr.t || '|0'")} / 1152921504606846976.0e0 * o.total GROUP BY 1, 2, 3, 4),
 te AS (SELECT *, row_number() OVER (PARTITION BY qid, t ORDER BY {HASH.format(x="qid || '|' || t || '|' || j || '|0'")}, j) AS rn FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS j FROM tk) WHERE j <> i), pa AS (SELECT qid, t, i, CAST(sum(CASE WHEN rn <= k THEN CAST(1 AS BIGINT) << j ELSE 0 END) AS BIGINT) AS a FROM te GROUP BY 1, 2, 3)
 SELECT qid, CAST(t AS INT) AS t, i, a, a | (CAST(1 AS BIGINT) << i) AS b FROM pa""")
def _(s, d):
    return T.paired_coalitions(elements(s, d))


@C.add("att_utilities", f"{GAME} SELECT qid, mask, u FROM util")
def _(s, d):
    return utilities(s, d).select("qid", "mask", "u")


# The largest score of a coalition is a sum of steps: the step to the next score counts once any element from there on
# is in. Each step is a game of its own whose values are known.
_STEPS = f"""{EL}, so AS (SELECT qid, n, i, score, row_number() OVER (PARTITION BY qid ORDER BY score, i) AS r FROM el), st AS (SELECT qid, n, i, score, r, score - coalesce(lag(score) OVER (PARTITION BY qid ORDER BY r), 0.0e0) AS step, n - r + 1 AS m FROM so)"""


@C.add("att_exact_shapley", f"{_STEPS}, v AS (SELECT qid, i, score + 0.5e0 * sum(step / m) OVER (PARTITION BY qid ORDER BY r) AS v FROM st) SELECT qid, i, {settled_sql('v')} AS value FROM v")
def shapley(s, d):
    return values(T.exact_shapley(elements(s, d), worth))


@C.add("att_exact_banzhaf", f"{_STEPS}, v AS (SELECT qid, i, score + 0.5e0 * sum(step / pow(2.0e0, m - 1)) OVER (PARTITION BY qid ORDER BY r) AS v FROM st) SELECT qid, i, {settled_sql('v')} AS value FROM v")
def _(s, d):
    return values(T.exact_banzhaf(elements(s, d), worth))


@C.add("att_loo", f"{EL}, v AS (SELECT x.qid, x.i, any_value(x.score) + 0.5e0 * (greatest(max(y.score), any_value(x.score)) - coalesce(max(y.score), 0.0e0)) AS v, any_value(x.n) AS n, any_value(x.score) AS s FROM el x LEFT JOIN el y ON y.qid = x.qid AND y.i <> x.i GROUP BY 1, 2), w AS (SELECT qid, i, CASE WHEN n = 1 THEN 1.5e0 * s ELSE v END AS v FROM v) SELECT qid, i, {settled_sql('v')} AS value FROM w")
def _(s, d):
    return values(T.leave_one_out(elements(s, d), worth))


@C.add("att_interaction", f"""{_STEPS}, cu AS (SELECT qid, i, r, sum(CASE WHEN m > 1 THEN step / (m - 1) ELSE 0.0e0 END) OVER (PARTITION BY qid ORDER BY r) AS c FROM st), v AS (SELECT x.qid, x.i, y.i AS j, -0.5e0 * CASE WHEN x.r < y.r THEN x.c ELSE y.c END AS v FROM cu x JOIN cu y ON y.qid = x.qid AND x.i < y.i)
 SELECT qid, i, j, {settled_sql('v')} AS value FROM v""")
def _(s, d):
    return values(T.interactions(elements(s, d), worth))


@C.add("join_hamming1", f"{GAME} SELECT x.qid, x.mask AS a, y.mask AS b FROM (SELECT qid, mask, mask | (CAST(1 AS BIGINT) << CAST(i AS INT)) AS b FROM (SELECT *, unnest(range(n)) AS i FROM masks) WHERE ((mask >> CAST(i AS INT)) & 1) = 0) x JOIN masks y ON y.qid = x.qid AND y.mask = x.b")
def _(s, d):
    return T.hamming_pairs(T.coalitions(elements(s, d), draws=DRAWS))


@C.add("att_eval_lds_r2", f"""{_STEPS}, sh AS (SELECT qid, i, {settled_sql('v')} AS value FROM (SELECT qid, i, score + 0.5e0 * sum(step / m) OVER (PARTITION BY qid ORDER BY r) AS v FROM st)), {GAME[len(EL) + 2:]},
 pred AS (SELECT u.qid, u.mask, u.u, round(coalesce(sum(CASE WHEN ((u.mask >> sh.i) & 1) = 1 THEN sh.value END), 0.0e0), 8) AS p FROM util u JOIN sh ON sh.qid = u.qid GROUP BY 1, 2, 3),
 r AS (SELECT qid, rank() OVER (PARTITION BY qid ORDER BY u) + (count(*) OVER (PARTITION BY qid, u) - 1) / 2.0e0 AS x, rank() OVER (PARTITION BY qid ORDER BY p) + (count(*) OVER (PARTITION BY qid, p) - 1) / 2.0e0 AS y FROM pred),
 l AS (SELECT qid, count(*) AS n, sum(x * y) - sum(x) * sum(y) / count(*) AS c, sum(x * x) - sum(x) * sum(x) / count(*) AS vx, sum(y * y) - sum(y) * sum(y) / count(*) AS vy FROM r GROUP BY 1),
 q AS (SELECT qid, CASE WHEN sum((u - m) * (u - m)) > 1e-12 THEN 1 - sum((u - p) * (u - p)) / sum((u - m) * (u - m)) END AS r2 FROM (SELECT *, avg(u) OVER (PARTITION BY qid) AS m FROM pred) GROUP BY 1)
 SELECT qid, n, round(CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN c / sqrt(vx * vy) END, 5) AS lds, round(CASE WHEN abs(r2) < 1e6 THEN r2 END, 4) AS r2 FROM l JOIN q USING (qid)""")
def _(s, d):
    """How well the Shapley values predict the utilities of a table of coalitions: rank correlation and R2 per question."""
    u = utilities(s, d)
    part = F.sum(F.when(F.expr("(shiftright(mask, i) & 1) = 1"), F.col("value")))
    pred = cut(u.join(shapley(s, d), "qid").groupBy("qid", "mask", "u").agg(rnd(F.coalesce(part, F.lit(0.0)), 8).alias("p")), "pred")
    lds = W.spearman(pred, ["qid"], "u", "p").withColumnRenamed("rho", "lds")
    m = pred.withColumn("m", F.avg("u").over(Window.partitionBy("qid")))
    gap, var = F.col("u") - F.col("p"), F.col("u") - F.col("m")
    r2 = m.groupBy("qid").agg(explained(gap, var).alias("r2"))
    return lds.join(r2, "qid").select("qid", "n", "lds", rnd(F.when(F.abs("r2") < 1e6, F.col("r2")), 4).alias("r2"))


@C.add("att_eval_delta_r2", f"""{_STEPS}, sh AS (SELECT qid, i, {settled_sql('v')} AS value FROM (SELECT qid, i, score + 0.5e0 * sum(step / m) OVER (PARTITION BY qid ORDER BY r) AS v FROM st)), {GAME[len(EL) + 2:]},
 hp AS (SELECT x.qid, x.i, y.u - x.u AS gain FROM (SELECT qid, u, CAST(i AS INT) AS i, mask | (CAST(1 AS BIGINT) << CAST(i AS INT)) AS b FROM (SELECT *, unnest(range(n)) AS i FROM util) WHERE ((mask >> CAST(i AS INT)) & 1) = 0) x JOIN util y ON y.qid = x.qid AND y.mask = x.b),
 q AS (SELECT qid, count(*) AS n, CASE WHEN sum((gain - m) * (gain - m)) > 1e-12 THEN 1 - sum((gain - value) * (gain - value)) / sum((gain - m) * (gain - m)) END AS r2 FROM (SELECT hp.qid, gain, value, avg(gain) OVER (PARTITION BY hp.qid) AS m FROM hp JOIN sh ON sh.qid = hp.qid AND sh.i = hp.i) GROUP BY 1)
 SELECT qid, n, round(CASE WHEN abs(r2) < 1e6 THEN r2 END, 4) AS delta_r2 FROM q""")
def _(s, d):
    """How well the Shapley values predict what one element adds, over the pairs of coalitions that differ in it."""
    u = cut(utilities(s, d), "utilities")
    each = u.select("qid", "u", "mask", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).where("(shiftright(mask, i) & 1) = 0").withColumn("mask", F.expr("mask | shiftleft(1L, i)"))
    g = each.join(u.select("qid", "mask", F.col("u").alias("v")), ["qid", "mask"]).select("qid", "i", (F.col("v") - F.col("u")).alias("gain")).join(shapley(s, d), ["qid", "i"])
    g = g.withColumn("m", F.avg("gain").over(Window.partitionBy("qid")))
    gap, var = F.col("gain") - F.col("value"), F.col("gain") - F.col("m")
    return g.groupBy("qid").agg(F.count("*").alias("n"), explained(gap, var).alias("r2")).select("qid", "n", rnd(F.when(F.abs("r2") < 1e6, F.col("r2")), 4).alias("delta_r2"))


_TOP2 = f"""{_STEPS}, sh AS (SELECT qid, i, {settled_sql('v')} AS value FROM (SELECT qid, i, score + 0.5e0 * sum(step / m) OVER (PARTITION BY qid ORDER BY r) AS v FROM st)), rk AS (SELECT el.qid, el.i, el.score, row_number() OVER (PARTITION BY el.qid ORDER BY value DESC, el.i) AS rn FROM el JOIN sh ON sh.qid = el.qid AND sh.i = el.i)"""


@C.add("topk_ablate_drop", f"""{_TOP2}, g AS (SELECT qid, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (rn <= 2) AS removed, sum(score) + 0.5e0 * max(score) AS whole, coalesce(sum(score) FILTER (rn > 2) + 0.5e0 * max(score) FILTER (rn > 2), 0.0e0) AS rest FROM rk GROUP BY 1)
 SELECT qid, removed, {settled_sql('(whole - rest)')} AS drop_ FROM g""")
def _(s, d):
    """What a question's utility loses without its two best elements."""
    return T.drop_of_best(elements(s, d), shapley(s, d), worth).withColumn("drop_", settled(F.col("drop_")))


@C.add("topk_ablate_best", f"""{EL}, pr AS (SELECT x.qid, x.i AS i, y.i AS j FROM el x JOIN el y ON y.qid = x.qid AND (x.i < y.i OR (x.n = 1 AND x.i = y.i))), u AS (SELECT pr.qid, pr.i, pr.j, round(any_value(w.whole) - coalesce(sum(e.score) + 0.5e0 * max(e.score), 0.0e0), 12) AS dr FROM pr JOIN (SELECT qid, sum(score) + 0.5e0 * max(score) AS whole FROM el GROUP BY 1) w ON w.qid = pr.qid LEFT JOIN el e ON e.qid = pr.qid AND e.i <> pr.i AND e.i <> pr.j GROUP BY 1, 2, 3)
 SELECT qid, CASE WHEN i = j THEN CAST(i AS VARCHAR) ELSE i || ',' || j END AS removed, {settled_sql('dr')} AS drop_ FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dr DESC, i, j) AS rn FROM u) WHERE rn = 1""")
def _(s, d):
    """The two elements whose common removal costs most, of all pairs."""
    return T.best_subset(elements(s, d), worth).withColumn("drop_", settled(F.col("drop_")))


@C.add("att_rage_comb", f"""{EL}, w AS (SELECT qid, round(0.5e0 * (sum(score) + 0.5e0 * max(score)), 12) AS need FROM el GROUP BY 1), tp AS (SELECT el.qid, n, row_number() OVER o AS k, sum(score) OVER o AS top, max(score) OVER (PARTITION BY el.qid) AS best, sum(score) OVER (PARTITION BY el.qid) AS total, lead(score) OVER (PARTITION BY el.qid ORDER BY score DESC, i) AS next FROM el WINDOW o AS (PARTITION BY el.qid ORDER BY score DESC, i)),
 h AS (SELECT tp.qid, min(CASE WHEN round(top + 0.5e0 * best, 12) >= need THEN k END) AS up, min(CASE WHEN round(total - top + 0.5e0 * coalesce(next, 0.0e0), 12) < need THEN k END) AS down, any_value(need) AS need FROM tp JOIN w USING (qid) GROUP BY 1)
 SELECT qid, CAST(CASE WHEN need <= 0 THEN 0 ELSE up END AS INT) AS up, CAST(CASE WHEN need > 0 THEN down END AS INT) AS down FROM h WHERE need > 0""")
def _(s, d):
    """Sizes of the least combinations that keep, and whose removal loses, half of a positive utility."""
    e = elements(s, d)
    some = e.groupBy("qid").agg(F.round(0.5 * (F.sum("score") + 0.5 * F.max("score")), 12).alias("need")).where("need > 0").select("qid")
    return T.minimal_combination(e, worth).join(some, "qid", "left_semi").select("qid", "up", "down")


@C.add("att_rage_score")
def _(s, d):
    """Scores by the least combination whose removal flips: 2 for its members, and the element's own score if positive."""
    e = elements(s, d)
    c = T.minimal_combination(e, worth).select("qid", F.col("down_mask").alias("m"))
    flip = F.when(F.expr("(shiftright(coalesce(m, 0L), i) & 1) = 1"), 2.0).otherwise(0.0)
    return e.join(c, "qid").select("qid", "i", rnd(flip + F.greatest("score", F.lit(0.0))).alias("score"))


def _sampled(name: str, method: str, doc: str) -> None:
    def query(s, d):
        return values(T.estimate_games(elements(s, d), worth, method))

    query.__doc__ = doc
    C.add(name)(query)


for _name, _method, _doc in (
    ("att_tmc", "tmc", "Truncated Monte Carlo Shapley values."), ("att_beta", "beta", "Beta-weighted semivalues."), ("att_contextcite", "contextcite", "Lasso surrogate."), ("att_wss", "wss", "KernelSHAP surrogate."),
    ("att_faith", "faith_shapley", "Second-order faithful surrogate by the KernelSHAP weights."), ("att_faith_banzhaf", "faith", "Second-order faithful surrogate of evenly weighed coalitions."), ("att_facile", "facile", "Second-order surrogate of the differences of neighbouring coalitions."), ("att_facilehp", "facilehp", "The same, its shares tuned on left-out differences."), ("att_fm", "fm", "Factorization machine surrogate."), ("att_wss_hybrid", "wss_hybrid", "Shapley values of partly predicted utilities."), ("att_smile_game", "kgsmile", "Kernel-weighted local surrogate of a game."),
):
    _sampled(_name, _method, _doc)


@C.add("att_kgsmile")
def _(s, d):
    """Local surrogate of each record's graph on masks of its triples; drawn masks, so no SQL twin."""
    kept = F.filter("original_subgraph.relations", lambda x: (x["src"] != "") & (x["tgt"] != ""))
    g = R.exp_view(s, d, "question", kept.alias("triples")).withColumnRenamed("exp_id", "qid")
    return values(T.smile(g))


_JSD = """sh_ AS (SELECT qid, list(abs(score) ORDER BY i) AS p FROM el GROUP BY 1), w AS (SELECT e.qid, e.i, list_transform(p, lambda x, k: CASE WHEN k - 1 = e.i THEN 0.0e0 ELSE x END) AS q, p FROM el e JOIN sh_ USING (qid)),
t AS (SELECT qid, i, list_transform(p, lambda x: (x + 1e-10) / (list_sum(p) + 1e-10 * len(p))) AS a, list_transform(q, lambda x: (x + 1e-10) / (list_sum(q) + 1e-10 * len(q))) AS b FROM w)"""


@C.add("att_arc_jsd", f"""{EL}, {_JSD} SELECT qid, i, round((list_sum(list_transform(list_zip(a, b), lambda z: z[1] * ln(z[1] / ((z[1] + z[2]) / 2.0e0)))) + list_sum(list_transform(list_zip(a, b), lambda z: z[2] * ln(z[2] / ((z[1] + z[2]) / 2.0e0))))) / 2.0e0, 8) + 0.0e0 AS value FROM t""")
def _(s, d):
    """Divergence of a question's score distribution once an element is left out."""
    e = elements(s, d)
    p = e.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", F.abs("score").alias("x"))))["x"].alias("p"))
    j = e.select("qid", "i").join(p, "qid")
    q = F.transform("p", lambda x, k: F.when(k == F.col("i"), F.lit(0.0)).otherwise(x))
    return j.select("qid", "i", (rnd(jensen_shannon(F.col("p"), q), 8) + 0.0).alias("value"))

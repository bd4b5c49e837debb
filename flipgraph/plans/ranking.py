"""Queries of the ranking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.operators import aggregates as A
from flipgraph.operators import ranking as W
from flipgraph.plans import aggregates as PA
from flipgraph.plans.catalog import Catalog
from flipgraph.sources import records as R
from flipgraph.sources.tables import table

C = Catalog()
SCO = R.with_views("sco")
EXP = R.with_views("exp")
_RN = f"{SCO}, rn AS (SELECT run_id, exp_id, method, perm_id, element_id, score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC, element_id) AS INT) AS rn FROM sco)"


@C.add("win_rank_desc", f"{_RN} SELECT run_id, element_id, rn FROM rn")
def _(s, d):
    return W.ranked_split(R.sco_view(s, d), ["run_id"]).select("run_id", "element_id", "rn")


@C.add("win_rank_abs", f"{SCO} SELECT run_id, element_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY abs(score) DESC, element_id) AS INT) AS rn FROM sco")
def _(s, d):
    return W.ranked_split(R.sco_view(s, d), ["run_id"], F.desc(F.abs("score"))).select("run_id", "element_id", "rn")


# Rankings of one explanation by two methods, as in the infiltration query.
def two_ranked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = PA.two_runs(s, d)
    return W.ranked(a, ["qid"]), W.ranked(b, ["qid"])


_AB = f"""{PA.TWO}, ra AS (SELECT qid, element_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, element_id) AS rn FROM a), rb AS (SELECT qid, element_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, element_id) AS rn FROM b)"""
_TAU = """both_ AS (SELECT qid, element_id, ra.rn AS x, rb.rn AS y FROM ra JOIN rb USING (qid, element_id)), sh AS (SELECT qid, count(*) AS shared FROM both_ GROUP BY 1),
ta AS (SELECT p.qid, avg(sign((p.x - q.x) * (p.y - q.y))) AS tau FROM both_ p JOIN both_ q ON q.qid = p.qid AND p.element_id < q.element_id GROUP BY 1)"""


@C.add("win_kendall_overlap", f"{_AB}, {_TAU} SELECT qid, shared, round(tau, 6) AS tau FROM sh LEFT JOIN ta USING (qid)")
def _(s, d):
    a, b = two_ranked(s, d)
    return W.kendall(a, b, ["qid"])


# Rankings of one explanation and method under two permutations.
def perm_ranked(s: SparkSession, d: str) -> DataFrame:
    sco = R.sco_view(s, d).where("perm_id IS NOT NULL AND exp_id IS NOT NULL")
    one = sco.groupBy("exp_id", "method", "perm_id").agg(F.min("run_id").alias("run_id"))
    return W.ranked(sco.join(one, ["exp_id", "method", "perm_id", "run_id"]), ["exp_id", "method", "perm_id"])


_PERM = f"""{SCO}, onep AS (SELECT exp_id, method, perm_id, min(run_id) AS run_id FROM sco WHERE perm_id IS NOT NULL GROUP BY 1, 2, 3),
pr AS (SELECT exp_id, method, perm_id, element_id, score, row_number() OVER (PARTITION BY exp_id, method, perm_id ORDER BY score DESC, element_id) AS rn FROM sco JOIN onep USING (exp_id, method, perm_id, run_id)),
pp AS (SELECT a.exp_id, a.method, a.perm_id AS perm_a, b.perm_id AS perm_b, a.element_id, a.rn AS x, b.rn AS y FROM pr a JOIN pr b ON a.exp_id = b.exp_id AND a.method = b.method AND a.perm_id < b.perm_id AND a.element_id = b.element_id)"""


def perm_pairs(s: SparkSession, d: str) -> DataFrame:
    """exp_id, method, perm_a, perm_b, element_id, ra, rb for each pair of an explanation's permutations."""
    p = perm_ranked(s, d)
    a = p.select("exp_id", "method", F.col("perm_id").alias("perm_a"), "element_id", F.col("rn").alias("ra"))
    b = p.select("exp_id", "method", F.col("perm_id").alias("perm_b"), "element_id", F.col("rn").alias("rb"))
    return a.join(b, ["exp_id", "method", "element_id"]).where("perm_a < perm_b")


_BY = ["exp_id", "method", "perm_a", "perm_b"]


def perm_taus(s: SparkSession, d: str) -> DataFrame:
    j = perm_pairs(s, d)
    return W.kendall(j.withColumnRenamed("ra", "rn"), j.withColumnRenamed("rb", "rn"), _BY)


_PTAU = f"""{_PERM}, sh AS (SELECT exp_id, method, perm_a, perm_b, count(*) AS shared FROM pp GROUP BY 1, 2, 3, 4), ta AS (SELECT p.exp_id, p.method, p.perm_a, p.perm_b, avg(sign((p.x - q.x) * (p.y - q.y))) AS tau
 FROM pp p JOIN pp q USING (exp_id, method, perm_a, perm_b) WHERE p.element_id < q.element_id GROUP BY 1, 2, 3, 4), taus AS (SELECT exp_id, method, perm_a, perm_b, shared, round(tau, 6) AS tau FROM sh LEFT JOIN ta USING (exp_id, method, perm_a, perm_b))"""


@C.add("win_kendall_pair", f"{_PTAU} SELECT * FROM taus")
def _(s, d):
    return perm_taus(s, d)


@C.add("agg_tau_level", f"{_PTAU} SELECT perm_b AS level, round(avg(tau), 6) AS mean_tau, round(stddev_pop(tau), 6) AS std_tau, count(tau) AS n FROM taus WHERE perm_a = 0 GROUP BY 1")
def _(s, d):
    return A.tau_levels(perm_taus(s, d).where("perm_a = 0").withColumnRenamed("perm_b", "level"), "level")


_STABLE = "max(coalesce(x = y AND x = 1, false)) AS same_first, sum(CAST(coalesce(x <= 3, false) <> coalesce(y <= 3, false) AS INT)) = 0 AS same_topk, count(*) FILTER (x = y) AS same_places, min(coalesce(x = y, false)) AS same_ranking"


@C.add("win_topk_stable", f"{_AB}, j AS (SELECT qid, ra.rn AS x, rb.rn AS y FROM ra FULL JOIN rb USING (qid, element_id)) SELECT qid, count(*) AS n, {_STABLE} FROM j GROUP BY qid")
def _(s, d):
    a, b = two_ranked(s, d)
    return W.topk_agreement(a, b, ["qid"], 3)


@C.add("agg_perm_summary", f"""{_PTAU}, st AS (SELECT exp_id, method, perm_a, perm_b, count(*) AS n, {_STABLE} FROM pp GROUP BY 1, 2, 3, 4)
 SELECT method, count(*) AS pairs, round(avg(tau), 6) AS avg_tau, round(min(tau), 6) AS min_tau, round(100.0e0 * avg(CAST(same_first AS INT)), 6) AS pct_first, round(100.0e0 * avg(CAST(same_topk AS INT)), 6) AS pct_topk,
 round(100.0e0 * avg(CAST(same_ranking AS INT)), 6) AS pct_exact, round(avg(same_places / n), 6) AS places FROM st JOIN taus USING (exp_id, method, perm_a, perm_b) GROUP BY method""")
def _(s, d):
    j = perm_pairs(s, d)
    st = W.topk_agreement(j.withColumnRenamed("ra", "rn"), j.withColumnRenamed("rb", "rn"), _BY, 3)
    pct = [A.rnd(100.0 * F.avg(F.col(c).cast("int"))).alias(n) for c, n in (("same_first", "pct_first"), ("same_topk", "pct_topk"), ("same_ranking", "pct_exact"))]
    return st.join(perm_taus(s, d), _BY).groupBy("method").agg(F.count("*").alias("pairs"), A.rnd(F.avg("tau")).alias("avg_tau"), A.rnd(F.min("tau")).alias("min_tau"), *pct, A.rnd(F.avg(F.col("same_places") / F.col("n"))).alias("places"))


# The stored ranking of a delivery against the score order: an index permutation.
_IDX = f"""{SCO}, att AS (SELECT DISTINCT ON (attr_id) * FROM attributions WHERE attr_id IS NOT NULL), st AS (SELECT attr_id, element_id, pos FROM (SELECT attr_id, unnest(ranking) AS element_id, unnest(range(len(ranking))) AS pos FROM att)),
sc AS (SELECT attr_id, element_id, row_number() OVER (PARTITION BY attr_id ORDER BY score DESC, element_id) AS idx FROM (SELECT attr_id, unnest(map_keys(shapley_scores)) AS element_id, unnest(map_values(shapley_scores)) + 0.0e0 AS score FROM att) WHERE score IS NOT NULL AND NOT isnan(score)),
pm AS (SELECT attr_id, pos, idx FROM st JOIN sc USING (attr_id, element_id))"""


@C.add("win_kendall_identity", f"""{_IDX}, n AS (SELECT attr_id, count(*) AS n FROM pm GROUP BY 1), ta AS (SELECT p.attr_id, avg(sign(q.idx - p.idx)) AS tau FROM pm p JOIN pm q ON q.attr_id = p.attr_id AND p.pos < q.pos GROUP BY 1)
 SELECT attr_id, n, round(coalesce(tau, 1.0e0), 6) AS tau FROM n LEFT JOIN ta USING (attr_id)""")
def _(s, d):
    """How far a stored ranking is from the order of its scores."""
    att = R.once(table(s, d, "attributions"), "attr_id", "ranking", "shapley_scores")
    stored = att.select("attr_id", F.posexplode("ranking").alias("pos", "element_id"))
    scores = att.select("attr_id", F.explode("shapley_scores").alias("element_id", "score")).where("score IS NOT NULL AND NOT isnan(score)").withColumn("score", F.col("score") + 0.0)
    perm = stored.join(W.ranked(scores, ["attr_id"], name="idx"), ["attr_id", "element_id"]).select("attr_id", "pos", "idx")
    return W.identity_tau(perm, ["attr_id"])


_NOISY = f"{_RN}, z AS (SELECT run_id, rn, element_id LIKE 'R::%' AS is_noise FROM rn)"


def noisy(s: SparkSession, d: str) -> DataFrame:
    return W.ranked_split(R.sco_view(s, d), ["run_id"]).withColumn("is_noise", F.col("element_id").startswith("R::"))


@C.add("win_best_noise_rank", f"{_NOISY} SELECT run_id, count(*) AS n, min(rn) FILTER (is_noise) AS rank_from_1, CAST(coalesce(min(rn) FILTER (is_noise) - 1, count(*)) AS BIGINT) AS rank_from_0 FROM z GROUP BY 1")
def _(s, d):
    return W.best_noise_rank(noisy(s, d), ["run_id"])


@C.add("win_noise_in_topk", f"""{_NOISY}, g AS (SELECT run_id, CAST(least(count(*), 3) AS BIGINT) AS k_eff, count(*) FILTER (is_noise AND rn <= 3) AS in_topk, count(*) FILTER (is_noise) AS n_noise FROM z GROUP BY 1)
 SELECT run_id, k_eff, in_topk, n_noise, round(coalesce(in_topk / nullif(n_noise, 0), 0.0e0), 6) AS of_noise, round(coalesce(in_topk / nullif(k_eff, 0), 0.0e0), 6) AS of_places FROM g""")
def _(s, d):
    return W.noise_in_topk(noisy(s, d), ["run_id"], 3)


@C.add("win_dedupe_latest", f"{EXP} SELECT mode, question, exp_id, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY mode, question ORDER BY recorded_at DESC NULLS LAST, exp_id) AS rn FROM exp) WHERE rn = 1")
def _(s, d):
    return W.latest(R.exp_view(s, d, "mode", "question", "recorded_at"), ["mode", "question"], "recorded_at", "exp_id").select("mode", "question", "exp_id", "recorded_at")


@C.add("win_dedupe_mincost", f"{EXP} SELECT question, exp_id, cost FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY cost ASC NULLS LAST, exp_id) AS rn FROM exp WHERE found) WHERE rn = 1")
def _(s, d):
    return W.cheapest(R.exp_view(s, d, "question", "cost", "found").where("found"), ["question"], "cost", "exp_id").select("question", "exp_id", "cost")


@C.add("win_minmax_scale", f"{SCO}, w AS (SELECT run_id, element_id, score, min(score) OVER (PARTITION BY run_id) AS lo, max(score) OVER (PARTITION BY run_id) AS hi FROM sco) SELECT run_id, element_id, round(CASE WHEN hi = lo THEN 1.0e0 ELSE (score - lo) / (hi - lo) END, 6) AS scaled FROM w")
def _(s, d):
    return W.minmax_scaled(R.sco_view(s, d), ["run_id"], "score", "scaled").select("run_id", "element_id", A.rnd(F.col("scaled")).alias("scaled"))


@C.add("win_maxnorm", f"{SCO}, w AS (SELECT run_id, element_id, score, max(score) OVER (PARTITION BY run_id) AS hi FROM sco) SELECT run_id, element_id, round(CASE WHEN hi = 0 THEN score ELSE score / hi END, 6) AS scaled FROM w")
def _(s, d):
    return W.max_scaled(R.sco_view(s, d), ["run_id"], "score", "scaled").select("run_id", "element_id", A.rnd(F.col("scaled")).alias("scaled"))


@C.add("win_scale_pair", f"""{PA.TWO}, u AS (SELECT qid, element_id, 'a' AS side, score FROM a UNION ALL SELECT qid, element_id, 'b', score FROM b), w AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM u)
 SELECT qid, element_id, side, round(CASE WHEN hi = lo THEN 0.0e0 ELSE (score - lo) / (hi - lo) END, 6) AS scaled FROM w""")
def _(s, d):
    a, b = PA.two_runs(s, d)
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    return W.minmax_scaled(both, ["qid"], "score", "scaled", 0.0).select("qid", "element_id", "side", A.rnd(F.col("scaled")).alias("scaled"))


# Attribution (b) against reference (a) on the shared elements.
_PAIRED = f"{PA.TWO}, p AS (SELECT qid, element_id, a.score AS ref, b.score AS att FROM a JOIN b USING (qid, element_id))"


def paired(s: SparkSession, d: str) -> DataFrame:
    a, b = PA.two_runs(s, d)
    return a.withColumnRenamed("score", "ref").join(b.withColumnRenamed("score", "att"), ["qid", "element_id"])


@C.add("win_ndcg", f"""{_PAIRED}, g AS (SELECT qid, element_id, greatest(ref, 0.0e0) AS rel, att, row_number() OVER (PARTITION BY qid ORDER BY att DESC, element_id) AS p, row_number() OVER (PARTITION BY qid ORDER BY greatest(ref, 0.0e0) DESC, element_id) AS i,
 avg(greatest(ref, 0.0e0)) OVER (PARTITION BY qid, att) AS shared FROM p), x AS (SELECT qid, count(*) AS n, sum(CASE WHEN p <= 3 THEN shared / log2(p + 1.0e0) ELSE 0.0e0 END) AS dcg, sum(CASE WHEN i <= 3 THEN rel / log2(i + 1.0e0) ELSE 0.0e0 END) AS idcg FROM g GROUP BY 1)
 SELECT qid, n, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0e0 END, 6) AS ndcg FROM x""")
def _(s, d):
    rows = paired(s, d).select("qid", "element_id", F.greatest("ref", F.lit(0.0)).alias("relevance"), F.col("att").alias("score"))
    return W.ndcg(rows, ["qid"], 3)


_GOLD = f"{_PAIRED}, g AS (SELECT qid, element_id, att AS score, ref > 0 AS is_gold FROM p), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, element_id) AS rn FROM g)"


def gold(s: SparkSession, d: str) -> DataFrame:
    return paired(s, d).select("qid", "element_id", F.col("att").alias("score"), (F.col("ref") > 0).alias("is_gold"))


@C.add("win_ap", f"""{_GOLD}, c AS (SELECT *, sum(CAST(is_gold AS INT)) OVER (PARTITION BY qid ORDER BY rn) AS tp FROM rk) SELECT qid, count(*) FILTER (is_gold) AS n_gold, round(avg(tp / rn) FILTER (is_gold), 6) AS ap FROM c GROUP BY 1""")
def _(s, d):
    return W.average_precision(gold(s, d), ["qid"])


@C.add("win_recall_k", f"""{_GOLD}, c AS (SELECT *, CAST(sum(CAST(is_gold AS INT)) OVER (PARTITION BY qid) AS BIGINT) AS ng FROM rk) SELECT qid, max(ng) AS n_gold, round(count(*) FILTER (is_gold AND rn <= 3) / nullif(max(ng), 0), 6) AS recall,
 round(count(*) FILTER (is_gold AND rn <= ng) / nullif(max(ng), 0), 6) AS r_precision FROM c GROUP BY 1""")
def _(s, d):
    return W.recall_at(gold(s, d), ["qid"], 3)


_PAIRS = f"{PA.TWO}, pr AS (SELECT x.qid, x.element_id AS e1, y.element_id AS e2, round(x.score * y.score, 9) AS value, x.element_id LIKE 'E::%' AND y.element_id LIKE 'R::' || substr(x.element_id, 4) || '->%' AS wanted FROM a x JOIN a y ON y.qid = x.qid AND x.element_id < y.element_id)"


def element_pairs(s: SparkSession, d: str) -> DataFrame:
    """Products of the scores of two elements of one explanation, as interaction values; wanted: an entity with its relation."""
    a, _b = PA.two_runs(s, d)
    x = a.select("qid", F.col("element_id").alias("e1"), F.col("score").alias("s1"))
    y = a.select("qid", F.col("element_id").alias("e2"), F.col("score").alias("s2"))
    wanted = F.col("e1").startswith("E::") & F.startswith("e2", F.concat(F.lit("R::"), F.expr("substring(e1, 4)"), F.lit("->")))
    return x.join(y, "qid").where("e1 < e2").select("qid", "e1", "e2", F.round(F.col("s1") * F.col("s2"), 9).alias("value"), wanted.alias("wanted"))


@C.add("win_pair_recovery", f"""{_PAIRS}, w AS (SELECT *, max(value) OVER (PARTITION BY qid) AS hi, min(value) OVER (PARTITION BY qid) AS lo FROM pr) SELECT qid, max(CAST(value = hi AS INT)) AS is_max, max(CAST(value = lo AS INT)) AS is_min FROM w WHERE wanted GROUP BY 1""")
def _(s, d):
    return W.pair_recovery(element_pairs(s, d), ["qid"], F.col("wanted"))


@C.add("win_rr_k", f"""{_PAIRS}, t AS (SELECT qid, wanted, row_number() OVER (PARTITION BY qid ORDER BY value DESC, e1, e2) AS rn FROM pr) SELECT qid, count(*) FILTER (wanted) AS n_wanted, round(count(*) FILTER (wanted AND rn <= 5) / nullif(count(*) FILTER (wanted), 0), 6) AS recovered FROM t GROUP BY 1""")
def _(s, d):
    from pyspark.sql import Window

    t = element_pairs(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("value"), "e1", "e2")))
    n = A.count_if(F.col("wanted"))
    return t.groupBy("qid").agg(n.alias("n_wanted"), A.rnd(A.count_if(F.col("wanted") & (F.col("rn") <= 5)) / F.nullif(n, F.lit(0))).alias("recovered"))


_SPEAR = """ra_ AS (SELECT qid, rank() OVER (PARTITION BY qid ORDER BY ref) + (count(*) OVER (PARTITION BY qid, ref) - 1) / 2.0e0 AS x, rank() OVER (PARTITION BY qid ORDER BY att) + (count(*) OVER (PARTITION BY qid, att) - 1) / 2.0e0 AS y FROM p),
v AS (SELECT qid, count(*) AS n, sum(x * y) - sum(x) * sum(y) / count(*) AS c, sum(x * x) - sum(x) * sum(x) / count(*) AS vx, sum(y * y) - sum(y) * sum(y) / count(*) AS vy FROM ra_ GROUP BY 1)"""


@C.add("win_spearman_lds", f"{_PAIRED}, {_SPEAR} SELECT qid, n, round(CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN c / sqrt(vx * vy) END, 5) AS rho FROM v")
def _(s, d):
    return W.spearman(paired(s, d), ["qid"], "ref", "att")


@C.add("agg_surrogate_summary", f"""{_PAIRED}, {_SPEAR}, m AS (SELECT qid, 1 - sum((ref - att) * (ref - att)) / nullif(sum(ref * ref) - sum(ref) * sum(ref) / count(*), 0) AS r2 FROM p GROUP BY 1),
 l AS (SELECT qid, CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN c / sqrt(vx * vy) END AS rho FROM v) SELECT count(*) AS n, round(avg(rho), 4) AS lds_mean, round(stddev_pop(rho), 4) AS lds_std, round(avg(CASE WHEN abs(r2) < 1e9 THEN r2 END), 4) AS r2_mean FROM l JOIN m USING (qid)""")
def _(s, d):
    """Mean fit of the attributions of one method to another's, over questions where it is defined."""
    p = paired(s, d)
    var = F.sum(F.col("ref") * F.col("ref")) - F.sum("ref") * F.sum("ref") / F.count("*")
    gap = F.col("ref") - F.col("att")
    r2 = p.groupBy("qid").agg((1 - F.sum(gap * gap) / F.nullif(var, F.lit(0.0))).alias("r2"))
    rho = W.spearman(p, ["qid"], "ref", "att")
    return rho.join(r2, "qid").agg(F.count("*").alias("n"), A.rnd(F.avg("rho"), 4).alias("lds_mean"), A.rnd(F.stddev_pop("rho"), 4).alias("lds_std"), A.rnd(F.avg(F.when(F.abs("r2") < 1e9, F.col("r2"))), 4).alias("r2_mean"))


@C.add("topk_attrib", f"{_RN} SELECT run_id, element_id, score, rn FROM rn WHERE rn <= 5")
def _(s, d):
    return W.ranked(R.sco_view(s, d), ["run_id"]).where("rn <= 5").select("run_id", "element_id", "score", "rn")


@C.add("topk_most_common", f"{R.with_views('sco')} SELECT element_id, count(*) AS n FROM sco GROUP BY 1 ORDER BY n DESC, element_id LIMIT 20")
def _(s, d):
    """The 20 elements that are scored most often (a top-k report)."""
    return A.top_counts(R.sco_view(s, d), "element_id", 20)


@C.add("flt_positive", f"{SCO} SELECT run_id, element_id, score FROM sco WHERE score > 0.0")
def _(s, d):
    return R.sco_view(s, d).where("score > 0").select("run_id", "element_id", "score")

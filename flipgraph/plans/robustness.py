"""Queries of robustness: contexts are permuted or given foreign nodes, answered and explained again.

The answering model is a lexical stub that prefers lines near the beginning, so that order matters: it answers with the
line that shares most with the question, less a tenth for each line before it. Explanations are games over the entities
of a record: a coalition is worth the best of its members' overlaps with the original answer, weakened alike by the
members before it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.operators import attribution as T
from flipgraph.operators import evaluator as E
from flipgraph.operators import generators as N
from flipgraph.operators import graph as G
from flipgraph.operators import ranking as W
from flipgraph.operators import search as S
from flipgraph.operators.aggregates import count_if, rnd
from flipgraph.plans import attribution as PT
from flipgraph.plans import context as PC
from flipgraph.plans import search as PS
from flipgraph.plans.catalog import Catalog
from flipgraph.session import cut
from flipgraph.sources import records as R

C = Catalog()
K = "exp_id"
TOKS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
#: Noise levels in percent, as entities and as shares.
LEVELS = (20, 50)


def overlap_sql(a: str, b: str) -> str:
    a, b = TOKS.format(x=a), TOKS.format(x=b)
    return f"coalesce(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0e0 END, 0.0e0)"


def enough_sql(context: str, reference: str) -> str:
    r, c = TOKS.format(x=reference), TOKS.format(x=context)
    return f"CAST(coalesce(len({r}) > 0 AND len(list_intersect({r}, {c})) >= 0.5 * len({r}), false) AS INT)"


# ---- Counterfactuals under permuted contexts


def object_lines(s: SparkSession, d: str) -> DataFrame:
    """exp_id, idx, line: entities and then relations of the perturbed graphs of found records, a line each."""
    flat = lambda *parts: F.translate(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)), "\n", " ")
    e = F.transform("perturbed_subgraph.entities", lambda x: flat(x["name"], x["description"]))
    r = F.transform("perturbed_subgraph.relations", lambda x: flat(x["src"], x["tgt"], x["description"]))
    none = F.array().cast("array<string>")
    rows = R.exp_view(s, d, "found", F.concat(F.coalesce(e, none), F.coalesce(r, none)).alias("lines")).where("found")
    return rows.select(K, F.posexplode("lines").alias("idx", "line"))


_LINES = f"""{R.with_views('exp')}, ls AS (SELECT exp_id, list_concat(coalesce(list_transform(perturbed_subgraph.entities, lambda x: replace(coalesce(x.name, '') || ' ' || coalesce(x.description, ''), chr(10), ' ')), []),
 coalesce(list_transform(perturbed_subgraph.relations, lambda x: replace(coalesce(x.src, '') || ' ' || coalesce(x.tgt, '') || ' ' || coalesce(x.description, ''), chr(10), ' ')), [])) AS ls FROM exp WHERE found),
li AS (SELECT exp_id, CAST(unnest(range(len(ls))) AS INT) AS idx, unnest(ls) AS line FROM ls), pm AS (SELECT exp_id, idx, line, unnest(range(1, 6)) AS perm_id FROM li),
pp AS (SELECT exp_id, perm_id, idx, line, row_number() OVER (PARTITION BY exp_id, perm_id ORDER BY md5(exp_id || '|' || perm_id || '|' || idx || '|11'), idx) - 1 AS pos FROM pm),
an AS (SELECT pp.exp_id, pp.perm_id, arg_min(line, (-({overlap_sql('line', 'x.question')} / (1.0e0 + 0.1e0 * pos)), pos)) AS answer FROM pp JOIN exp x ON x.exp_id = pp.exp_id GROUP BY 1, 2),
fl AS (SELECT an.exp_id, perm_id, 1 - {enough_sql('answer', 'x.answers.original')} AS flipped FROM an JOIN exp x ON x.exp_id = an.exp_id),
st AS (SELECT exp_id, count(*) AS num_permutations, CAST(sum(flipped) AS BIGINT) AS num_flipped, round(sum(flipped) / count(*), 4) AS flip_stability, sum(flipped) = count(*) AS all_flip FROM fl GROUP BY 1)"""


@C.add("ev_perm_cfe", f"{_LINES} SELECT * FROM st")
def perm_cfe(s, d):
    """Five random orders of each perturbed graph's objects, answered again: how many still flip the original answer."""
    lines = object_lines(s, d)
    p = N.object_permutations(lines, K, "line", 5, 11)
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    states = p.groupBy(K, "perm_id").agg(context.alias("context")).join(R.exp_view(s, d, "question", F.col("answers.original").alias("reference")), K)
    asked = states.select(F.col(K).alias("qid"), F.col("perm_id").alias("state"), "context", "question", "reference")
    flipped = 1 - F.col("score")
    got = E.Positional().evaluate(asked).groupBy(F.col("qid").alias(K)).agg(F.count("*").alias("num_permutations"), F.sum(flipped).alias("num_flipped"))
    return got.select(K, "num_permutations", "num_flipped", rnd(F.col("num_flipped") / F.col("num_permutations"), 4).alias("flip_stability"), (F.col("num_flipped") == F.col("num_permutations")).alias("all_flip"))


@C.add("ev_perm_cfe_summary", f"{_LINES} SELECT count(*) AS cases, round(avg(flip_stability), 4) AS avg_flip_stability, round(100.0e0 * count(*) FILTER (all_flip) / count(*), 2) AS pct_all FROM st")
def _(s, d):
    return perm_cfe(s, d).agg(F.count("*").alias("cases"), rnd(F.avg("flip_stability"), 4).alias("avg_flip_stability"), rnd(100.0 * count_if(F.col("all_flip")) / F.count("*"), 2).alias("pct_all"))


# ---- Explanations by method. Elements: (qid, i, score), i the place in the context.


def explained(elements: DataFrame, method: str) -> DataFrame:
    """(qid, i, value) of each element by a method: shap, span (left out), rage (least combination) or smile (surrogate)."""
    e = elements.select("qid", "i", "score")
    if method == "shap":
        return PT.values(T.exact_shapley(e, T.positional))
    if method == "span":
        return PT.values(T.leave_one_out(e, T.positional))
    if method == "smile":
        return PT.values(T.estimate_games(e, T.positional, "kgsmile"))
    c = T.minimal_combination(e, T.positional).select("qid", F.coalesce("down_mask", F.lit(0)).alias("m"))
    member = F.expr("(shiftright(m, i) & 1) = 1")
    return PT.values(e.join(c, "qid").select("qid", "i", (F.when(member, 2.0).otherwise(0.0) + F.greatest("score", F.lit(0.0))).alias("value")))


def explained_sql(method: str) -> str:
    """CTE ``va`` (qid, i, value) over ``el`` (qid, n, i, score)."""
    if method == "span":
        return f"""va AS (SELECT qid, i, {PT.settled_sql('(whole - rest)')} AS value FROM (SELECT x.qid, x.i, any_value(w.whole) AS whole, coalesce(max(y.score / (1.0e0 + 0.1e0 * (y.i - CAST(y.i > x.i AS INT)))), 0.0e0) AS rest FROM el x JOIN (SELECT qid, max(score / (1.0e0 + 0.1e0 * i)) AS whole FROM el GROUP BY 1) w ON w.qid = x.qid LEFT JOIN el y ON y.qid = x.qid AND y.i <> x.i GROUP BY 1, 2))"""
    game = "mk AS (SELECT qid, n, unnest(range(CAST(pow(2, n) AS BIGINT))) AS mask FROM (SELECT DISTINCT qid, n FROM el)), ut AS (SELECT m.qid, m.n, m.mask, coalesce(max(el.score / (1.0e0 + 0.1e0 * bit_count(m.mask & ((CAST(1 AS BIGINT) << el.i) - 1)))), 0.0e0) AS u, coalesce(sum(el.score), 0.0e0) AS total FROM mk m LEFT JOIN el ON el.qid = m.qid AND ((m.mask >> el.i) & 1) = 1 GROUP BY 1, 2, 3)"
    if method == "shap":
        weight = "CAST(factorial(CAST(bit_count(x.mask) AS INT)) AS DOUBLE) * CAST(factorial(x.n - CAST(bit_count(x.mask) AS INT) - 1) AS DOUBLE) / CAST(factorial(x.n) AS DOUBLE)"
        return f"{game}, va AS (SELECT qid, i, {PT.settled_sql('v')} AS value FROM (SELECT x.qid, x.i, sum({weight} * (y.u - x.u)) AS v FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS i FROM ut) x JOIN ut y ON y.qid = x.qid AND y.mask = x.mask | (CAST(1 AS BIGINT) << x.i) WHERE ((x.mask >> x.i) & 1) = 0 GROUP BY 1, 2))"
    return f"""{game}, wh AS (SELECT qid, round(0.5e0 * max(u) FILTER (mask = (CAST(1 AS BIGINT) << n) - 1), 12) AS need FROM ut GROUP BY 1), dn AS (SELECT r.qid, arg_min(r.mask, (bit_count(r.mask), -round(r.total, 12), r.mask)) AS m FROM ut r JOIN ut k ON k.qid = r.qid AND k.mask = ((CAST(1 AS BIGINT) << r.n) - 1) - r.mask JOIN wh ON wh.qid = r.qid WHERE round(k.u, 12) < need GROUP BY 1),
 va AS (SELECT el.qid, el.i, {PT.settled_sql('(CASE WHEN ((coalesce(m, 0) >> el.i) & 1) = 1 THEN 2.0e0 ELSE 0.0e0 END + greatest(el.score, 0.0e0))')} AS value FROM el LEFT JOIN dn ON dn.qid = el.qid)"""


def scored_entities(s: SparkSession, d: str) -> DataFrame:
    """exp_id, idx, name, score: the entities of each record and their overlap with the original answer."""
    o = R.exp_view(s, d, F.col("answers.original").alias("o"))
    return R.ent_view(s, d).join(o, K).select(K, F.col("pos").alias("idx"), F.coalesce("name", F.lit("")).alias("name"), text.token_jaccard(F.coalesce("description", F.lit("")), F.coalesce("o", F.lit(""))).alias("score"))


_SCORED = f"{R.with_views('ent')}, se AS (SELECT e.exp_id, e.pos AS idx, {overlap_sql('''coalesce(e.description, '')''', '''coalesce(x.answers.original, '')''')} AS score FROM ent e JOIN exp x ON x.exp_id = e.exp_id)"
_ORDERS = f"""{_SCORED}, od AS (SELECT exp_id, 0 AS perm_id, idx, score, idx AS i FROM se UNION ALL SELECT exp_id, perm_id, idx, score, row_number() OVER (PARTITION BY exp_id, perm_id ORDER BY md5(exp_id || '|' || perm_id || '|' || idx || '|12'), idx) - 1 FROM (SELECT *, unnest([1, 2]) AS perm_id FROM se)),
el AS (SELECT exp_id * 10 + perm_id AS qid, CAST(count(*) OVER (PARTITION BY exp_id, perm_id) AS INT) AS n, CAST(i AS INT) AS i, score, exp_id, perm_id, idx FROM od)"""


def orders(s: SparkSession, d: str) -> DataFrame:
    """qid, i, score, exp_id, perm_id, idx: the entities in their own order (0) and in two random ones."""
    e = scored_entities(s, d).select(K, "idx", "score")
    own = e.select(K, F.lit(0).alias("perm_id"), F.col("idx").alias("pos"), "idx", "score")
    p = own.unionByName(N.object_permutations(e, K, "score", 2, 12))
    return p.select((F.col(K) * 10 + F.col("perm_id")).alias("qid"), F.col("pos").alias("i"), "score", K, "perm_id", "idx")


def perm_summary(s: SparkSession, d: str, method: str) -> DataFrame:
    o = cut(orders(s, d), "orders")
    ranked = W.ranked(explained(o, method).join(o.select("qid", "i", K, "perm_id", "idx"), ["qid", "i"]).select(K, "perm_id", F.col("idx").alias("element_id"), F.col("value").alias("score")), [K, "perm_id"])
    r = cut(ranked, "ranked")
    other = r.where("perm_id > 0")
    own = r.where("perm_id = 0").select(K, "element_id", "rn").join(other.select(K, "perm_id").distinct(), K)
    by = [K, "perm_id"]
    j = W.kendall(own, other, by).join(W.topk_agreement(own, other, by, 3), by)
    pct = [rnd(100.0 * F.avg(F.col(c).cast("int")), 4).alias(n) for c, n in (("same_first", "pct_first"), ("same_topk", "pct_topk"), ("same_ranking", "pct_exact"))]
    return j.agg(F.count("*").alias("pairs"), rnd(F.avg("tau"), 5).alias("avg_tau"), rnd(F.min("tau"), 5).alias("min_tau"), *pct)


def _perm(name: str, method: str, sql: bool, doc: str) -> None:
    twin = f"""{_ORDERS}, {explained_sql(method)}, rk AS (SELECT exp_id, perm_id, idx, row_number() OVER (PARTITION BY exp_id, perm_id ORDER BY value DESC, idx) AS rn FROM va JOIN el USING (qid, i)),
 pr AS (SELECT b.exp_id, b.perm_id, b.idx, a.rn AS x, b.rn AS y FROM rk a JOIN rk b ON b.exp_id = a.exp_id AND b.idx = a.idx WHERE a.perm_id = 0 AND b.perm_id > 0), ta AS (SELECT p.exp_id, p.perm_id, round(avg(sign((p.x - q.x) * (p.y - q.y))), 6) AS tau FROM pr p JOIN pr q ON q.exp_id = p.exp_id AND q.perm_id = p.perm_id AND p.idx < q.idx GROUP BY 1, 2),
 tk AS (SELECT exp_id, perm_id, max(CAST(x = y AND x = 1 AS INT)) AS f, CAST(sum(CAST((x <= 3) <> (y <= 3) AS INT)) = 0 AS INT) AS k, min(CAST(x = y AS INT)) AS e FROM pr GROUP BY 1, 2)
 SELECT count(*) AS pairs, round(avg(tau), 5) AS avg_tau, round(min(tau), 5) AS min_tau, round(100.0e0 * avg(f), 4) AS pct_first, round(100.0e0 * avg(k), 4) AS pct_topk, round(100.0e0 * avg(e), 4) AS pct_exact FROM tk LEFT JOIN ta USING (exp_id, perm_id)"""

    def query(s, d):
        return perm_summary(s, d, method)

    query.__doc__ = doc
    C.add(name, twin if sql else None)(query)


for _name, _method, _sql, _doc in (
    ("ev_perm_shap", "shap", True, "Shapley values of permuted contexts against those of the given order."),
    ("ev_perm_span", "span", True, "Left-out entities of permuted contexts against those of the given order."),
    ("ev_perm_rage", "rage", True, "Least combinations of permuted contexts against those of the given order."),
    ("ev_perm_smile", "smile", False, "Local surrogates of permuted contexts against those of the given order (drawn masks: no SQL twin)."),
):
    _perm(_name, _method, _sql, _doc)


# ---- Foreign nodes


def foreign(s: SparkSession, d: str) -> DataFrame:
    """exp_id, level, name, anchor: nodes of a record's knowledge graph that its context does not hold, tied to random nodes of it."""
    nodes, kg = cut(R.cgn_view(s, d), "nodes"), cut(R.kgn_view(s, d), "kg")
    return G.union_all([N.noise_nodes(nodes, kg, K, level / 100, level).withColumn("level", F.lit(level)) for level in LEVELS])


def foreign_sql() -> str:
    return ", ".join(PC.noise_sql(level / 100, level, f"_{level}") for level in LEVELS) + ", fo AS (" + " UNION ALL ".join(f"SELECT exp_id, {level} AS level, name, anchor FROM noise_{level}" for level in LEVELS) + ")"


def noisy_entities(s: SparkSession, d: str) -> DataFrame:
    """qid, i, score, exp_id, level, is_noise: a record's entities and, behind them, its foreign nodes by name, at each level.

    A foreign node's overlap with the original answer is that of its name.
    """
    f = cut(foreign(s, d), "foreign")
    levels = F.explode(F.array(*map(F.lit, LEVELS))).alias("level")
    own = scored_entities(s, d).select(K, levels, F.lit(False).alias("is_noise"), F.col("idx").cast("long").alias("key"), F.lit("").alias("name"), "score")
    o = R.exp_view(s, d, F.col("answers.original").alias("o"))
    new = f.join(o, K).select(K, "level", F.lit(True).alias("is_noise"), F.lit(0).cast("long").alias("key"), "name", text.token_jaccard("name", F.coalesce("o", F.lit(""))).alias("score"))
    from pyspark.sql import Window

    both = own.unionByName(new).withColumn("i", F.row_number().over(Window.partitionBy(K, "level").orderBy("is_noise", "key", "name")) - 1)
    return both.select((F.col(K) * 100 + F.col("level")).alias("qid"), "i", "score", K, "level", "is_noise")


_NOISY = f"""{R.with_views('ent', 'kgn', 'cgn')}, {foreign_sql()}, se AS (SELECT e.exp_id, e.pos AS idx, {overlap_sql('''coalesce(e.description, '')''', '''coalesce(x.answers.original, '')''')} AS score FROM ent e JOIN exp x ON x.exp_id = e.exp_id),
bo AS (SELECT exp_id, level, false AS is_noise, idx AS key, '' AS name, score FROM se, (SELECT unnest([{', '.join(map(str, LEVELS))}]) AS level) UNION ALL SELECT fo.exp_id, level, true, 0, fo.name, {overlap_sql('fo.name', '''coalesce(x.answers.original, '')''')} FROM fo JOIN exp x ON x.exp_id = fo.exp_id),
el AS (SELECT exp_id * 100 + level AS qid, CAST(count(*) OVER (PARTITION BY exp_id, level) AS INT) AS n, CAST(row_number() OVER (PARTITION BY exp_id, level ORDER BY is_noise, key, name) - 1 AS INT) AS i, score, exp_id, level, is_noise FROM bo)"""


def noisy_units(s: SparkSession, d: str) -> DataFrame:
    """As ``noisy_entities`` of texts: the sentences of a record with a foreign one at a random place; level 0."""
    u = N.insert_unit(PC.noise_units(s, d, False), K, "u", "noise", 3).join(R.exp_view(s, d, F.col("answers.original").alias("o")), K)
    each = u.select(K, "at", "o", F.posexplode("noisy").alias("i", "unit"))
    return each.select(F.col(K).alias("qid"), "i", text.token_jaccard("unit", F.coalesce("o", F.lit(""))).alias("score"), K, F.lit(0).alias("level"), (F.col("i") == F.col("at")).alias("is_noise"))


_UNITS = f"""{PC._INS}, p AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, '.'), lambda z: regexp_replace(z, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda z: z <> '')[1], '') AS noise FROM documents), ny AS (SELECT exp_id, place, list_concat(list_concat(u[1:place], [noise]), u[place + 1:]) AS u FROM x JOIN p ON p.doc_id = x.exp_id % (SELECT count(*) FROM documents) + 1),
un2 AS (SELECT exp_id, place, len(u) AS n, CAST(unnest(range(len(u))) AS INT) AS i, unnest(u) AS unit FROM ny), el AS (SELECT un2.exp_id AS qid, CAST(n AS INT) AS n, i, {overlap_sql('unit', '''coalesce(e.answers.original, '')''')} AS score, un2.exp_id, 0 AS level, i = place AS is_noise FROM un2 JOIN exp e ON e.exp_id = un2.exp_id)"""


def noise_summary(elements: DataFrame, method: str) -> DataFrame:
    """Per level: how often foreign elements reach the three best of an explanation, their share of it and their best place."""
    e = cut(elements, "noisy")
    rows = W.ranked(explained(e, method).join(e.select("qid", "i", "level", "is_noise"), ["qid", "i"]).select("qid", "level", "is_noise", F.col("i").alias("element_id"), F.col("value").alias("score")), ["qid"])
    mass = lambda c: F.sum(F.when(c, F.abs("score")).otherwise(0.0))
    z = F.col("is_noise")
    g = rows.groupBy("level", "qid").agg(count_if(z & (F.col("rn") <= 3)).alias("hit"), count_if(z).alias("n_noise"), F.min(F.when(z, F.col("rn"))).alias("first"), (mass(z) / F.nullif(mass(F.lit(True)), F.lit(0.0))).alias("mass"))
    return g.groupBy("level").agg(F.count("*").alias("runs"), F.sum("n_noise").alias("n_noise"), count_if(F.col("hit") > 0).alias("hit_runs"), rnd(F.avg("first"), 5).alias("mean_first"), rnd(F.avg(F.coalesce("mass", F.lit(0.0))), 5).alias("mean_mass"))


def _noise(name: str, method: str, units: bool, sql: bool, doc: str) -> None:
    twin = f"""{_UNITS if units else _NOISY}, {explained_sql(method)}, rk AS (SELECT qid, level, is_noise, value, row_number() OVER (PARTITION BY qid ORDER BY value DESC, i) AS rn FROM va JOIN el USING (qid, i)),
 g AS (SELECT level, qid, count(*) FILTER (is_noise AND rn <= 3) AS hit, count(*) FILTER (is_noise) AS n_noise, min(rn) FILTER (is_noise) AS first, sum(CASE WHEN is_noise THEN abs(value) ELSE 0.0e0 END) / nullif(sum(abs(value)), 0.0e0) AS mass FROM rk GROUP BY 1, 2)
 SELECT level, count(*) AS runs, CAST(sum(n_noise) AS BIGINT) AS n_noise, count(*) FILTER (hit > 0) AS hit_runs, round(avg(first), 5) AS mean_first, round(avg(coalesce(mass, 0.0e0)), 5) AS mean_mass FROM g GROUP BY 1"""

    def query(s, d):
        return noise_summary(noisy_units(s, d) if units else noisy_entities(s, d), method)

    query.__doc__ = doc
    C.add(name, twin if sql else None)(query)


for _name, _method, _units, _sql, _doc in (
    ("ev_noise_shap", "shap", False, True, "Foreign nodes among the Shapley values of noisy graphs."),
    ("ev_noise_text", "shap", True, True, "A foreign sentence among the Shapley values of texts."),
    ("ev_noise_span", "span", True, True, "A foreign sentence among the importances of left-out sentences."),
    ("ev_noise_rage", "rage", False, True, "Foreign nodes in the least combinations of noisy graphs."),
    ("ev_noise_smile", "smile", False, False, "Foreign nodes among the weights of local surrogates (drawn masks: no SQL twin)."),
):
    _noise(_name, _method, _units, _sql, _doc)


@C.add("ev_noise")
def _(s, d):
    """Foreign nodes are injected and the question is answered again; where the answer holds, the noisy graph is searched.

    Per level: questions, those whose answer the noise changes, those with a find, and finds without a foreign node.
    """
    f = cut(foreign(s, d), "foreign")
    q = PS.questions(s, d, ("ft",), "original")
    new = f.groupBy(K, "level").agg(F.collect_list("name").alias("noise"), F.collect_list(F.struct(F.col("anchor").alias("src"), F.col("name").alias("tgt"), F.lit("").alias("keywords"), F.lit("").alias("description"), F.lit(0.0).alias("weight"))).alias("links"))
    kind = q.schema["relations"].dataType.simpleString()
    rows = q.join(new, K).select(K, "level", "noise", F.concat(F.coalesce("entities", F.array().cast("array<string>")), "noise").alias("entities"), F.concat(F.coalesce("relations", F.array().cast(kind)), F.col("links").cast(kind)).alias("relations"), "sims", "needs")
    # The stub's judge needs the nodes that the answer names; foreign nodes take none away, so the answer changes only if it needs nothing.
    rows = cut(rows.withColumn("robust", F.coalesce(F.size("needs") > 0, F.lit(False))), "noisy")
    ok = rows.where("robust").withColumn("case", F.col(K) * 100 + F.col("level"))
    got = S.search_all(ok.select(F.col("case").alias(K), "entities", "relations", "sims", "needs"), partial(S.best_first, ops=PS.DELETE, hit=0, max_cost=PS.COST, max_calls=PS.CALLS))
    touched = F.expr("exists(noise, x -> contains(edits, concat('\"', x, '\"')))")
    j = ok.join(got.select(F.col(K).alias("case"), "found", F.to_json("ops").alias("edits")), "case").withColumn("clean", F.col("found") & ~F.coalesce(touched, F.lit(False)))
    return rows.join(j.select(K, "level", "found", "clean"), [K, "level"], "left").groupBy("level").agg(F.count("*").alias("n"), count_if(~F.col("robust")).alias("changed"), count_if(F.coalesce("found", F.lit(False))).alias("found"), count_if(F.coalesce("clean", F.lit(False))).alias("resistant"))

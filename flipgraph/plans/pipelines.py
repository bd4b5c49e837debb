"""Queries of the evaluation pipelines: correctness, sufficiency, noise and permutation robustness per method."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flipgraph.functions import ids, text
from flipgraph.operators import aggregates as A
from flipgraph.operators import evaluator as E
from flipgraph.operators import generators as N
from flipgraph.operators import graph as G
from flipgraph.operators import ranking as W
from flipgraph.plans import aggregates as PA
from flipgraph.plans import context as PC
from flipgraph.plans import graph as PG
from flipgraph.plans.catalog import Catalog
from flipgraph.sources import records as R

C = Catalog()
K = "exp_id"
_TOKS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def enough_sql(context: str, reference: str) -> str:
    r, c = _TOKS.format(x=reference), _TOKS.format(x=context)
    return f"CAST(coalesce(len({r}) > 0 AND len(list_intersect({r}, {c})) >= 0.5 * len({r}), false) AS INT)"


# ---- Correctness against supporting facts


@C.add("ev_edit_correctness", f"{PA._FLAG} SELECT {PA.DIRECTION_SQL} AS direction, count(*) AS n, round(avg(precision), 4) AS precision, round(avg(n_flagged), 4) AS flagged, round(avg(CAST(tp > 0 AS INT)), 4) AS hit FROM prec GROUP BY 1")
def _(s, d):
    """Precision of the edited elements of found explanations, by direction."""
    p = PA.set_precision(s, d).join(PA.flagged(s, d).select(K, "mode").distinct(), K)
    return p.groupBy(PA.direction().alias("direction")).agg(F.count("*").alias("n"), A.rnd(F.avg("precision"), 4).alias("precision"), A.rnd(F.avg("n_flagged"), 4).alias("flagged"), A.rnd(F.avg((F.col("tp") > 0).cast("int")), 4).alias("hit"))


_SPANS = f"""{R.with_views('exp')}, {PA.FACTS}, sp AS (SELECT exp_id, mode, list_filter(list_transform(string_split(answers.original, '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> '') AS u FROM exp WHERE answers.original IS NOT NULL), spans AS (SELECT exp_id, mode, CAST(unnest(range(len(u))) AS INT) AS pos, unnest(u) AS span FROM sp),
 rel AS (SELECT s.exp_id, s.mode, s.pos, coalesce(max(CASE WHEN len({_TOKS.format(x='span')}) > 0 AND len({_TOKS.format(x='unit')}) > 0 THEN len(list_intersect({_TOKS.format(x='span')}, {_TOKS.format(x='unit')})) / len(list_distinct(list_concat({_TOKS.format(x='span')}, {_TOKS.format(x='unit')}))) ELSE 0.0e0 END), 0.0e0) >= 0.4 AS relevant FROM spans s LEFT JOIN facts f ON f.exp_id = s.exp_id GROUP BY 1, 2, 3)"""


@C.add("ev_span_correctness", f"{_SPANS} SELECT {PA.DIRECTION_SQL} AS direction, count(*) AS n, count(*) FILTER (relevant) AS relevant FROM rel GROUP BY 1")
def _(s, d):
    """Sentences of an answer that overlap a supporting fact, by token sets."""
    sp = R.exp_view(s, d, "mode", F.col("answers.original").alias("o")).where("o IS NOT NULL").select(K, "mode", F.posexplode(text.sentences_by_dot(F.col("o"))).alias("pos", "span"))
    best = F.coalesce(F.max(text.token_jaccard(F.col("span"), F.col("unit"))), F.lit(0.0))
    rel = sp.join(PA.facts(s, d), K, "left").groupBy(K, "mode", "pos").agg((best >= 0.4).alias("relevant"))
    return rel.groupBy(PA.direction().alias("direction")).agg(F.count("*").alias("n"), A.count_if(F.col("relevant")).alias("relevant"))


@C.add("ev_relevance_judge", f"{PA.ELEMENTS}, g AS (SELECT exp_id, coalesce(answers.ground_truth, '') AS g FROM exp) SELECT ht.exp_id, ht.element_id, {enough_sql('g.g', 'h')} AS relevant FROM ht JOIN g ON g.exp_id = ht.exp_id")
def _(s, d):
    """The judge variant: an element counts if the lexical judge finds its name in the facts as a whole."""
    g = R.exp_view(s, d, F.coalesce("answers.ground_truth", F.lit("")).alias("g"))
    e = PA.subgraph_elements(s, d).join(g, K)
    return e.select(K, "element_id", E.lexical_score(F.col("g"), ids.head(F.col("element_id"))).alias("relevant"))


# ---- Sufficiency: what an explanation holds, as the only context


_SMILE = f"""{R.with_views('exp', 'sco')}, rk AS (SELECT exp_id, run_id, method, element_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, element_id) AS rn FROM sco WHERE score > 0), cx AS (SELECT exp_id, run_id, method, string_agg(element_id, ' ') AS c FROM rk WHERE rn <= 3 GROUP BY 1, 2, 3)"""


@C.add("ev_sufficiency_smile", f"{_SMILE} SELECT cx.method, count(*) AS n, CAST(sum({enough_sql('c', 'x.answers.original')}) AS BIGINT) AS sufficient FROM cx JOIN exp x ON x.exp_id = cx.exp_id GROUP BY 1")
def _(s, d):
    """The three best positive elements of an attribution as context."""
    top = W.ranked(R.sco_view(s, d).where("score > 0"), ["run_id"]).where("rn <= 3").groupBy(K, "run_id", "method").agg(F.array_join(F.collect_list("element_id"), " ").alias("c"))
    j = top.join(R.exp_view(s, d, F.col("answers.original").alias("o")), K)
    return j.groupBy("method").agg(F.count("*").alias("n"), F.sum(E.lexical_score(F.col("c"), F.col("o"))).alias("sufficient"))


_TEXT = f"""WITH si AS ({PC.C.sql['att_span_removal']}), x AS (SELECT DISTINCT ON (exp_id) exp_id, mode, answers FROM explanations WHERE exp_id IS NOT NULL), u AS (SELECT exp_id, mode, answers.original AS o, list_filter(list_transform(string_split(answers.ground_truth, '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> '') AS u FROM x),
 best AS (SELECT exp_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY importance DESC, pos) AS rn FROM si) WHERE rn = 1)"""


@C.add("ev_sufficiency_text", f"{_TEXT} SELECT mode, count(*) AS n, CAST(sum({enough_sql('u.u[b.pos + 1]', 'u.o')}) AS BIGINT) AS sufficient FROM best b JOIN u ON u.exp_id = b.exp_id GROUP BY 1")
def _(s, d):
    """The most important unit of a text as context."""
    best = W.ranked(PC.span_importance(s, d), [K], F.desc("importance"), "pos").where("rn = 1").select(K, "pos")
    u = PC.units(s, d).join(R.exp_view(s, d, "mode", F.col("answers.original").alias("o")), K)
    j = best.join(u, K).withColumn("c", F.get("u", F.col("pos")))
    return j.groupBy("mode").agg(F.count("*").alias("n"), F.sum(E.lexical_score(F.col("c"), F.col("o"))).alias("sufficient"))


@C.add("win_cumulative_trapz", f"{R.with_views('noi')}, p AS (SELECT noise_level AS x, avg(CAST(noise.noise_robust AS INT)) AS y FROM noi GROUP BY 1), l AS (SELECT x, (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2.0e0 AS part FROM p) SELECT x AS noise_level, round(coalesce(sum(part) OVER (ORDER BY x), 0.0e0), 6) AS area FROM l")
def _(s, d):
    """Area so far under the robust share over the noise level."""
    w = Window.orderBy("noise_level")  # one row per level
    p = R.noise_view(s, d, "noise_level", F.col("noise.noise_robust").cast("int").alias("r")).groupBy("noise_level").agg(F.avg("r").alias("y"))
    part = (F.col("noise_level") - F.lag("noise_level").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2.0
    return p.withColumn("part", part).select("noise_level", A.rnd(F.coalesce(F.sum("part").over(w), F.lit(0.0))).alias("area"))


# ---- Replacements, and what else edits and estimators offer


@C.add("g_replace_node", f"{PG._FIRST}, g AS (SELECT exp_id, node FROM f WHERE op = 'delete_node') SELECT c.exp_id, CASE WHEN c.name = g.node THEN 'NEW' ELSE c.name END AS name FROM cgn c JOIN g ON g.exp_id = c.exp_id")
def _(s, d):
    """The first deleted node of each record under a new name, its edges kept."""
    nodes, _e = PG.cg(s, d, False)
    g = PG.first_ops(s, d, "delete_node").select(K, "node")
    return nodes.join(g, K).select(K, F.when(F.col("name") == F.col("node"), "NEW").otherwise(F.col("name")).alias("name"))


@C.add("g_replace_edge", f"{PG._FIRST}, g AS (SELECT exp_id, src, dst FROM f WHERE op = 'delete_edge') SELECT c.exp_id, c.src, c.tgt, CASE WHEN c.src = g.src AND c.tgt = g.dst THEN 'NEW' ELSE c.description END AS description FROM cge c JOIN g ON g.exp_id = c.exp_id")
def _(s, d):
    """The first deleted edge of each record with a new description."""
    _n, edges = PG.cg(s, d, False)
    g = PG.first_ops(s, d, "delete_edge").select(K, F.col("src").alias("s"), F.col("dst").alias("t"))
    hit = (F.col("src") == F.col("s")) & (F.col("tgt") == F.col("t"))
    return edges.join(g, K).select(K, "src", "tgt", F.when(hit, "NEW").otherwise(F.col("description")).alias("description"))


@C.add("gen_perm_triples", f"{R.with_views('rel')}, p AS (SELECT exp_id, pos, unnest([1, 2]) AS perm_id FROM rel) SELECT exp_id, CAST(perm_id AS INT) AS perm_id, CAST(row_number() OVER (PARTITION BY exp_id, perm_id ORDER BY md5(exp_id || '|' || perm_id || '|' || pos || '|5'), pos) - 1 AS INT) AS pos, pos AS idx FROM p")
def _(s, d):
    r = R.rel_view(s, d).select(K, F.col("pos").alias("idx"), F.lit(0).alias("item"))
    return N.object_permutations(r, K, "item", 2, 5).drop("item")


@C.add("g_psp_incumbent", f"{PG._PROBE} SELECT exp_id, count(*) AS pivots, count(*) FILTER (flipped) AS hits, min(cost) FILTER (flipped) AS bound FROM probed GROUP BY 1")
def _(s, d):
    """Pivots, hits and the cost bound that the cheapest hit gives to a search."""
    p = PG.probed(s, d)
    return p.groupBy(K).agg(F.count("*").alias("pivots"), A.count_if(F.col("flipped")).alias("hits"), F.min(F.when(F.col("flipped"), F.col("cost"))).alias("bound"))


@C.add("set_union_graph", f"{R.with_views('cgn', 'ops')} SELECT exp_id, name FROM cgn UNION SELECT exp_id, node FROM ops WHERE op = 'add_node' AND node <> ''")
def _(s, d):
    return G.with_nodes(R.cgn_view(s, d), R.ops_view(s, d).where("op = 'add_node' AND node <> ''").select(K, F.col("node").alias("name")), K)

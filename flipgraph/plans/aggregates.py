"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.operators import aggregates as A
from flipgraph.plans.catalog import Catalog
from flipgraph.sources import records as R
from flipgraph.sources.tables import table

C = Catalog()
EXP = R.with_views("exp")
OPS = R.with_views("exp", "ops")
SCO = R.with_views("sco")
NOI = R.with_views("noi")
CGN = R.with_views("cgn")
_FOUND = "(found AND num_operations > 0)"
#: T->F or F->T by mode (fixed values of the data model).
DIRECTION_SQL = "CASE mode WHEN 'ft' THEN 'T->F' WHEN 'ff' THEN 'F->T' WHEN 'tf' THEN 'F->T' END"


def direction(mode: str = "mode"):
    return F.when(F.col(mode) == "ft", "T->F").when(F.col(mode).isin("ff", "tf"), "F->T")


def scored_cases(s: SparkSession, d: str) -> DataFrame:
    """(id, llm_score, rag_score, case): the mode's letters say whether each answer was right."""
    e = R.exp_view(s, d, "mode").where("mode IS NOT NULL")
    return e.select(F.col("exp_id").alias("id"), (F.substring("mode", 1, 1) == "t").cast("int").alias("llm_score"), (F.substring("mode", 2, 1) == "t").cast("int").alias("rag_score"), F.col("mode").alias("case"))


CASES = f"{EXP}, cases AS (SELECT exp_id AS id, CAST(substr(mode, 1, 1) = 't' AS INT) AS llm_score, CAST(substr(mode, 2, 1) = 't' AS INT) AS rag_score, mode AS \"case\" FROM exp WHERE mode IS NOT NULL)"


@C.add("agg_accuracy", f"{CASES} SELECT count(*) AS n, round(avg(rag_score), 6) AS accuracy FROM cases")
def _(s, d):
    return A.accuracy(scored_cases(s, d).select(F.col("rag_score").alias("score")))


@C.add("agg_cases", f"""{CASES} SELECT count(*) AS n, count(*) FILTER ("case" = 'tt') AS n_tt, count(*) FILTER ("case" = 'tf') AS n_tf, count(*) FILTER ("case" = 'ft') AS n_ft,
 count(*) FILTER ("case" = 'ff') AS n_ff, round(avg(llm_score), 6) AS llm_accuracy, round(avg(rag_score), 6) AS rag_accuracy FROM cases""")
def _(s, d):
    return A.case_counts(scored_cases(s, d))


@C.add("agg_success", f"""{EXP} SELECT mode, count(*) AS total, count(*) FILTER {_FOUND} AS found, count(*) - count(*) FILTER {_FOUND} AS not_found,
 round(100.0e0 * count(*) FILTER {_FOUND} / count(*), 6) AS pct_found FROM exp GROUP BY mode""")
def _(s, d):
    return A.success(R.exp_view(s, d, "mode", "found", "num_operations"), "mode")


@C.add("agg_failure_reason", f"""{EXP} SELECT CASE WHEN llm_calls >= 200 THEN 'llm_budget' WHEN cost >= 10 THEN 'cost' ELSE 'unknown' END AS reason, count(*) AS n
 FROM exp WHERE NOT coalesce({_FOUND}, false) GROUP BY 1""")
def _(s, d):
    return A.failure_reasons(R.exp_view(s, d, "found", "num_operations", "llm_calls", "cost"))


@C.add("agg_op_stats", f"""{EXP} SELECT count(*) AS n, round(avg(num_operations), 6) AS avg_ops, min(num_operations) AS min_ops, max(num_operations) AS max_ops,
 round(avg(cost), 6) AS avg_cost, min(cost) AS min_cost, max(cost) AS max_cost FROM exp WHERE found""")
def _(s, d):
    return A.op_stats(R.exp_view(s, d, "found", "num_operations", "cost"))


_OPERANDS = f"{OPS}, operands AS (SELECT exp_id, op, operand FROM (SELECT exp_id, op, unnest([node, src, dst]) AS operand FROM ops WHERE found) WHERE operand <> '')"


@C.add("agg_op_top", f"{_OPERANDS} SELECT operand, count(*) AS n FROM operands GROUP BY 1 ORDER BY n DESC, operand LIMIT 10")
def _(s, d):
    """The ten elements that edits touch most (a top-k report)."""
    return A.top_counts(A.op_operands(R.ops_view(s, d).where("found")), "operand", 10)


_BUCKET = "least(greatest(floor(v / 0.2e0), 0), 4)"


@C.add("agg_similarity", f"""{EXP}, v AS (SELECT answers.similarity AS v FROM exp WHERE found AND answers.similarity IS NOT NULL), l AS (SELECT list_sort(list(v)) AS l FROM v)
 SELECT count(*) AS n, round(avg(v), 6) AS mean, (SELECT l[len(l) // 2 + 1] FROM l) AS upper_median, min(v) AS min, max(v) AS max,
 {', '.join(f'count(*) FILTER ({_BUCKET} = {i}) AS bucket_{i}' for i in range(5))} FROM v""")
def _(s, d):
    return A.similarity_stats(R.exp_view(s, d, "found", F.col("answers.similarity").alias("similarity")).where("found"))


@C.add("agg_llm_calls", f"""{EXP} SELECT found, count(*) AS n, round(avg(llm_calls), 6) AS avg_calls, min(llm_calls) AS min_calls, max(llm_calls) AS max_calls,
 CAST(sum(llm_calls) AS BIGINT) AS total_calls FROM exp GROUP BY found""")
def _(s, d):
    return A.call_stats(R.exp_view(s, d, "found", "llm_calls"))


_SIZES = f"{EXP}, g AS (SELECT len(original_subgraph.entities) AS nodes, len(original_subgraph.relations) AS edges FROM exp WHERE original_subgraph IS NOT NULL)"


@C.add("agg_graph_size", f"""{_SIZES} SELECT count(*) AS n, {', '.join(f'round(avg({x}), 6) AS avg_{k}, CAST(min({x}) AS INT) AS min_{k}, CAST(max({x}) AS INT) AS max_{k}' for k, x in (('nodes', 'nodes'), ('edges', 'edges'), ('context', 'nodes + edges')))} FROM g""")
def _(s, d):
    g = R.exp_view(s, d, F.size("original_subgraph.entities").alias("nodes"), F.size("original_subgraph.relations").alias("edges"))
    return A.graph_sizes(g)


@C.add("agg_optype", f"{OPS} SELECT op, count(*) AS n FROM ops WHERE found GROUP BY op")
def _(s, d):
    return A.op_types(R.ops_view(s, d))


@C.add("agg_add_pct", f"{OPS} SELECT mode, count(*) AS n, round(100.0e0 * count(*) FILTER (op LIKE 'add%') / count(*), 6) AS pct_additions FROM ops WHERE found GROUP BY mode")
def _(s, d):
    return A.addition_share(R.ops_view(s, d).where("found"), "mode")


@C.add("agg_node_freq", f"{_OPERANDS} SELECT operand, count(*) AS n FROM operands WHERE op LIKE 'delete%' GROUP BY 1 ORDER BY n DESC, operand LIMIT 20")
def _(s, d):
    """The 20 nodes that deletions touch most (a top-k report)."""
    return A.top_counts(A.op_operands(R.ops_view(s, d).where("found"), "deletions"), "operand", 20)


@C.add("agg_cell", f"""{EXP} SELECT kg_id, mode, count(*) AS n, count(*) FILTER (found) AS n_found, round(count(*) FILTER (found) / count(*), 6) AS success_rate, round(avg(cost) FILTER (found), 6) AS mean_cost,
 round(median(cost) FILTER (found), 6) AS median_cost, round(avg(num_operations) FILTER (found), 6) AS mean_ops, round(avg(llm_calls), 6) AS mean_calls, round(median(llm_calls), 6) AS median_calls FROM exp GROUP BY kg_id, mode""")
def _(s, d):
    return A.cells(R.exp_view(s, d, "kg_id", "mode", "found", "cost", "num_operations", "llm_calls"), "kg_id", "mode")


@C.add("agg_avg_metrics", f"{EXP} SELECT kg_id, round(avg(timings.total_seconds), 6) AS avg_seconds, round(avg(num_operations) FILTER (found), 6) AS avg_ops FROM exp GROUP BY kg_id")
def _(s, d):
    return A.benchmark_averages(R.exp_view(s, d, "kg_id", "found", "num_operations", F.col("timings.total_seconds").alias("total_seconds")), "kg_id")


@C.add("agg_time_totals", f"""{EXP} SELECT mode, count(*) AS n, round(sum(timings.total_seconds), 3) AS sum_seconds, round(avg(timings.total_seconds), 6) AS avg_seconds,
 CAST(sum(llm_calls) AS BIGINT) AS sum_calls, round(avg(llm_calls), 6) AS avg_calls FROM exp GROUP BY mode""")
def _(s, d):
    return A.time_totals(R.exp_view(s, d, "mode", "llm_calls", F.col("timings.total_seconds").alias("total_seconds")), "mode")


@C.add("agg_shap_buckets", f"""{EXP}, b AS (SELECT unnest(['retrieval', 'algorithm', 'llm']) AS bucket, unnest([timings.retrieval_seconds, timings.algorithm_seconds, timings.llm_seconds]) AS seconds, llm_calls AS calls FROM exp WHERE timings IS NOT NULL)
 SELECT bucket, count(*) AS n, round(sum(seconds), 3) AS sum_seconds, round(avg(seconds), 6) AS avg_seconds, CAST(sum(calls) AS BIGINT) AS sum_calls, round(avg(calls), 6) AS avg_calls FROM b GROUP BY GROUPING SETS ((bucket), ())""")
def _(s, d):
    t = R.exp_view(s, d, "timings", "llm_calls").where("timings IS NOT NULL")
    parts = F.array(*(F.struct(F.lit(k).alias("bucket"), F.col(f"timings.{k}_seconds").alias("seconds")) for k in ("retrieval", "algorithm", "llm")))
    return A.time_buckets(t.select(F.col("llm_calls").alias("calls"), F.inline(parts)))


# Supporting facts of a record: the sentences of its ground truth. Gold elements: those the facts name.
def facts(s: SparkSession, d: str) -> DataFrame:
    return R.exp_view(s, d, F.col("answers.ground_truth").alias("g")).select("exp_id", F.posexplode(text.sentences_by_dot(F.col("g"))).alias("unit_pos", "unit"))


def subgraph_elements(s: SparkSession, d: str) -> DataFrame:
    e = R.ent_view(s, d).where("name <> ''").select("exp_id", F.concat(F.lit("E::"), "name").alias("element_id"))
    r = R.cge_view(s, d).select("exp_id", F.concat(F.lit("R::"), "src", F.lit("->"), "tgt").alias("element_id"))
    return e.unionByName(r).distinct()


FACTS = """sents AS (SELECT exp_id, list_filter(list_transform(string_split(answers.ground_truth, '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> '') AS u FROM exp),
facts AS (SELECT exp_id, CAST(unnest(range(len(u))) AS INT) AS unit_pos, unnest(u) AS unit FROM sents)"""


def norm_sql(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ')"


def contains_sql(hay: str, needle: str) -> str:
    n = norm_sql(needle)
    return f"coalesce({n} <> '' AND contains({norm_sql(hay)}, {n}), false)"


HEAD = "CASE WHEN element_id LIKE 'R::%' THEN regexp_extract(element_id, '^R::(.*?)->', 1, 's') ELSE substr(element_id, 4) END"
TAIL = "CASE WHEN element_id LIKE 'R::%' THEN regexp_extract(element_id, '^R::.*?->(.*)$', 1, 's') END"
ELEMENTS = R.with_views("ent", "cge") + f""",
{FACTS}, elements AS (SELECT DISTINCT exp_id, element_id FROM (SELECT exp_id, 'E::' || name AS element_id FROM ent WHERE name <> '' UNION ALL SELECT exp_id, 'R::' || src || '->' || tgt FROM cge)),
ht AS (SELECT exp_id, element_id, {HEAD} AS h, {TAIL} AS t FROM elements)"""
RELEVANT = f"""{ELEMENTS}, relevant AS (SELECT ht.exp_id, element_id, coalesce(bool_or({contains_sql('unit', 'h')}), false) AND (coalesce(bool_or({contains_sql('unit', 't')}), false) OR bool_or(t IS NULL)) AS relevant
 FROM ht LEFT JOIN facts ON facts.exp_id = ht.exp_id GROUP BY 1, 2)"""


@C.add("ev_relevance", f"{RELEVANT} SELECT exp_id, element_id, relevant FROM relevant")
def relevance(s, d):
    return A.relevant_elements(subgraph_elements(s, d), facts(s, d))


@C.add("agg_fact_coverage", f"""{RELEVANT}, cov AS (SELECT facts.exp_id, unit_pos, bool_or(coalesce({contains_sql('unit', 'h')} AND (t IS NULL OR {contains_sql('unit', 't')}), false)) AS covered FROM facts LEFT JOIN ht ON ht.exp_id = facts.exp_id GROUP BY 1, 2)
 SELECT r.exp_id, r.n_elements, r.n_gold_elements, coalesce(c.n_facts_total, 0) AS n_facts_total, coalesce(c.n_facts_covered, 0) AS n_facts_covered
 FROM (SELECT exp_id, count(*) AS n_elements, count(*) FILTER (relevant) AS n_gold_elements FROM relevant GROUP BY 1) r LEFT JOIN (SELECT exp_id, count(*) AS n_facts_total, count(*) FILTER (covered) AS n_facts_covered FROM cov GROUP BY 1) c ON c.exp_id = r.exp_id""")
def _(s, d):
    return A.fact_coverage(subgraph_elements(s, d), facts(s, d))


def flagged(s: SparkSession, d: str) -> DataFrame:
    return R.ids_of_ops(R.ops_view(s, d).where("found")).where("element_id IS NOT NULL").select("exp_id", "mode", "element_id").distinct()


_FLAG = f"""{RELEVANT}, {R.CTE['ops']}, flagged AS (SELECT DISTINCT exp_id, mode, element_id FROM (SELECT exp_id, mode, coalesce('E::' || node, 'R::' || src || '->' || dst) AS element_id FROM ops WHERE found) WHERE element_id IS NOT NULL),
gold AS (SELECT exp_id, element_id FROM relevant WHERE relevant),
prec AS (SELECT f.exp_id, f.mode, count(g.element_id) AS tp, count(*) - count(g.element_id) AS fp, count(*) AS n_flagged, round(count(g.element_id) / count(*), 6) AS precision FROM flagged f LEFT JOIN gold g ON g.exp_id = f.exp_id AND g.element_id = f.element_id GROUP BY 1, 2)"""


@C.add("agg_setprecision", f"{_FLAG} SELECT exp_id, tp, fp, n_flagged, precision FROM prec")
def set_precision(s, d):
    return A.set_precision(flagged(s, d), relevance(s, d).where("relevant"), "exp_id")


@C.add("agg_correctness_block", f"""{_FLAG} SELECT direction, count(*) AS n, round(avg(precision), 4) AS macro_precision, round(sum(tp) / sum(n_flagged), 4) AS micro_precision, round(avg(CAST(tp > 0 AS INT)), 4) AS hit_rate
 FROM (SELECT {DIRECTION_SQL} AS direction, * FROM prec) GROUP BY GROUPING SETS ((direction), ())""")
def _(s, d):
    return A.correctness_block(set_precision(s, d).join(flagged(s, d).select("exp_id", "mode").distinct(), "exp_id").withColumn("direction", direction()))


_RANKED = R.with_views("exp", "sco") + f""",
{FACTS}, elements AS (SELECT DISTINCT exp_id, element_id FROM sco), ht AS (SELECT exp_id, element_id, {HEAD} AS h, {TAIL} AS t FROM elements),
relevant AS (SELECT ht.exp_id, element_id, coalesce(bool_or({contains_sql('unit', 'h')}), false) AND (coalesce(bool_or({contains_sql('unit', 't')}), false) OR bool_or(t IS NULL)) AS relevant FROM ht LEFT JOIN facts ON facts.exp_id = ht.exp_id GROUP BY 1, 2),
ranked AS (SELECT run_id, method, element_id, score, relevant AS is_gold FROM sco JOIN relevant USING (exp_id, element_id))"""


def ranked_gold(s: SparkSession, d: str) -> DataFrame:
    sco = R.sco_view(s, d).where("exp_id IS NOT NULL")
    rel = A.relevant_elements(sco, facts(s, d)).withColumnRenamed("relevant", "is_gold")
    return sco.join(rel, ["exp_id", "element_id"]).select("run_id", "method", "element_id", "score", "is_gold")


_PAK = f"""{_RANKED}, rn AS (SELECT run_id, is_gold, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, element_id) AS rn FROM ranked WHERE score > 0),
ks AS (SELECT DISTINCT run_id, CAST(k AS INT) AS k FROM ranked, (VALUES (1), (2), (3), (5)) v(k)),
pak AS (SELECT ks.run_id, ks.k, count(rn.run_id) AS n, count(*) FILTER (is_gold) AS tp FROM ks LEFT JOIN rn ON rn.run_id = ks.run_id AND rn.rn <= ks.k GROUP BY 1, 2)"""


@C.add("agg_prec_at_k", f"{_PAK} SELECT run_id, k, n, tp, round(tp / nullif(n, 0), 6) AS precision, CAST(tp > 0 AS INT) AS hit FROM pak")
def _(s, d):
    return A.precision_at_k(ranked_gold(s, d), (1, 2, 3, 5), "run_id")


@C.add("ev_attribution", f"""{_PAK}, m AS (SELECT DISTINCT run_id, method FROM ranked) SELECT method, k, count(*) AS runs, round(avg(tp / nullif(n, 0)), 4) AS precision, round(avg(CAST(tp > 0 AS INT)), 4) AS hit
 FROM pak JOIN m USING (run_id) GROUP BY 1, 2""")
def _(s, d):
    """Precision of ranked methods against the supporting facts, per method and cutoff."""
    r = ranked_gold(s, d)
    at = A.precision_at_k(r, (1, 2, 3, 5), "run_id").join(r.select("run_id", "method").distinct(), "run_id")
    p = F.col("tp") / F.nullif(F.col("n"), F.lit(0))
    return at.groupBy("method", "k").agg(F.count(F.lit(1)).alias("runs"), A.rnd(F.avg(p), 4).alias("precision"), A.rnd(F.avg("hit"), 4).alias("hit"))


@C.add("agg_flip_stability", f"{NOI} SELECT exp_id, count(*) AS n, count(*) FILTER (NOT noise.noise_robust) AS flipped, round(count(*) FILTER (NOT noise.noise_robust) / count(*), 6) AS stability FROM noi GROUP BY exp_id")
def stability(s, d):
    runs = R.noise_view(s, d, "exp_id", F.col("noise.noise_robust").alias("robust"))
    return A.flip_stability(runs, "exp_id", ~F.col("robust"))


@C.add("agg_flip_buckets", f"""{NOI}, st AS (SELECT exp_id, count(*) AS n, count(*) FILTER (NOT noise.noise_robust) AS flipped, round(count(*) FILTER (NOT noise.noise_robust) / count(*), 6) AS stability FROM noi GROUP BY exp_id)
 SELECT count(*) AS cases, count(*) FILTER (flipped = n) AS perfect, count(*) FILTER (flipped > 0 AND flipped < n) AS partial, count(*) FILTER (flipped = 0) AS zero, round(avg(stability), 6) AS avg_stability, round(100.0e0 * count(*) FILTER (flipped = n) / count(*), 6) AS pct_all FROM st""")
def _(s, d):
    return A.flip_buckets(stability(s, d))


_RESIST = "len(noise.noise_nodes_in_counterfactual) = 0"


@C.add("agg_noise_rate", f"{NOI} SELECT mode, noise_level, count(*) AS total, count(*) FILTER ({_RESIST}) AS resistant, round(count(*) FILTER ({_RESIST}) / count(*), 6) AS rate FROM noi WHERE found GROUP BY 1, 2")
def _(s, d):
    return A.noise_rate(R.noise_view(s, d, "mode", "noise_level", "found", F.col("noise.noise_nodes_in_counterfactual").alias("noise_nodes")).where("found"), "mode", "noise_level")


def mass_sql(part: str, name: str) -> str:
    return f"round(coalesce(sum(CASE WHEN is_noise THEN {part} ELSE 0.0e0 END) / nullif(sum({part}), 0.0e0), 0.0e0), 6) AS {name}"


@C.add("agg_noise_mass", f"""{SCO}, z AS (SELECT run_id, score, element_id LIKE 'R::%' AS is_noise FROM sco) SELECT run_id, {mass_sql('abs(score)', 'abs_share')}, {mass_sql('greatest(score, 0.0e0)', 'positive_share')},
 round(avg(score) FILTER (is_noise), 6) AS mean_noise, round(max(score) FILTER (is_noise), 6) AS max_noise, round(avg(score) FILTER (NOT is_noise), 6) AS mean_original, round(max(score) FILTER (NOT is_noise), 6) AS max_original FROM z GROUP BY run_id""")
def _(s, d):
    """Here the relations of an explanation take the part of the injected elements."""
    return A.noise_mass(R.sco_view(s, d).withColumn("is_noise", F.col("element_id").startswith("R::")), "run_id")


@C.add("agg_noise_level", f"""{NOI}, r AS (SELECT noise_level, noise.noise_robust AS b, noise.num_ops AS o FROM noi) SELECT noise_level, count(*) AS n, count(b) AS n_judged, count(*) FILTER (b) AS n_robust, round(100.0e0 * count(*) FILTER (b) / nullif(count(b), 0), 6) AS pct_noise_robust,
 round(avg(o), 6) AS avg_ops, round(avg(o) FILTER (b), 6) AS avg_ops_robust, round(avg(o) FILTER (NOT b), 6) AS avg_ops_fragile FROM r GROUP BY noise_level""")
def _(s, d):
    return A.noise_levels(R.noise_view(s, d, "noise_level", "noise").select("noise_level", "noise.noise_robust", "noise.num_ops"))


_LEAK = f"""{NOI}, r AS (SELECT noise_level, list_filter(list_transform(operations, lambda o: CASE WHEN json_extract_string(o, '$[0]') LIKE '%node' THEN json_extract_string(o, '$[1]') END), lambda x: x IS NOT NULL) AS cf,
 list_filter(list_transform(noise.ops, lambda o: CASE WHEN json_extract_string(o, '$[0]') = 'add_node' THEN json_extract_string(o, '$[1]') END), lambda x: x IS NOT NULL) AS z FROM noi WHERE found),
e AS (SELECT noise_level, len(list_distinct(list_intersect(cf, z))) AS leaked, len(list_distinct(cf)) AS n_cf, len(list_distinct(z)) AS n_noise FROM r)"""


@C.add("agg_noise_leak", f"""{_LEAK} SELECT noise_level, count(*) AS n, CAST(sum(leaked) AS BIGINT) AS leaked, round(avg(leaked / nullif(n_noise, 0)), 6) AS recall, round(avg(leaked / nullif(n_cf, 0)), 6) AS contamination FROM e GROUP BY 1""")
def _(s, d):
    def names(ops: str, kind: str):
        return F.array_compact(F.transform(ops, lambda o: F.when(F.get_json_object(o, "$[0]").rlike(kind), F.get_json_object(o, "$[1]"))))

    runs = R.noise_view(s, d, "noise_level", "found", "operations", F.col("noise.ops").alias("z")).where("found")
    return A.noise_leak(runs.select("noise_level", names("operations", "node$").alias("cf"), names("z", "^add_node$").alias("noise")))


def two_runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores of each explanation by two methods; a question has one run per method, the lowest run id of permutation 0."""
    sco = R.sco_view(s, d).where("exp_id IS NOT NULL")
    runs = sco.where("perm_id = 0").groupBy("exp_id", "method").agg(F.min("run_id").alias("run_id"))
    one = sco.join(runs, ["exp_id", "method", "run_id"]).select(F.col("exp_id").alias("qid"), "method", "element_id", "score")
    return one.where("method = 'exact_shapley'").drop("method"), one.where("method = 'tmc_shapley'").drop("method")


TWO = f"""{SCO}, one_run AS (SELECT exp_id, method, min(run_id) AS run_id FROM sco WHERE perm_id = 0 GROUP BY 1, 2), one AS (SELECT exp_id AS qid, method, element_id, score FROM sco JOIN one_run USING (exp_id, method, run_id)),
a AS (SELECT qid, element_id, score FROM one WHERE method = 'exact_shapley'), b AS (SELECT qid, element_id, score FROM one WHERE method = 'tmc_shapley')"""


@C.add("agg_infiltration", f"""{TWO}, t AS (SELECT qid, element_id, row_number() OVER (PARTITION BY qid ORDER BY abs(score) DESC, element_id) AS rn FROM b),
f AS (SELECT qid, min(rn) AS first FROM t WHERE rn <= 5 AND NOT EXISTS (SELECT 1 FROM a WHERE a.qid = t.qid AND a.element_id = t.element_id) GROUP BY 1),
q AS (SELECT DISTINCT qid FROM b WHERE qid IN (SELECT qid FROM a)) SELECT CAST(k AS INT) AS k, count(*) AS n, round(avg(CAST(coalesce(first <= k, false) AS INT)), 6) AS infiltrated FROM q LEFT JOIN f USING (qid), (VALUES (3), (5)) v(k) GROUP BY 1""")
def _(s, d):
    return A.infiltration(*two_runs(s, d))


@C.add("agg_auc_trapz", f"""{NOI}, p AS (SELECT mode, noise_level AS x, avg(CAST(noise.noise_robust AS INT)) AS y FROM noi GROUP BY 1, 2), l AS (SELECT mode, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2.0e0 AS part FROM p WHERE y IS NOT NULL WINDOW w AS (PARTITION BY mode ORDER BY x))
 SELECT mode, round(coalesce(sum(part), 0.0e0), 6) AS auc, count(*) AS points FROM l GROUP BY mode""")
def _(s, d):
    p = R.noise_view(s, d, "mode", "noise_level", F.col("noise.noise_robust").cast("int").alias("r")).groupBy("mode", "noise_level").agg(F.avg("r").alias("y"))
    return A.auc_trapezoid(p, "noise_level", "y", "mode")


@C.add("agg_degenerate", f"""{SCO} SELECT run_id, count(DISTINCT score) FILTER (element_id LIKE 'E::%') AS entity_values, count(DISTINCT score) FILTER (element_id LIKE 'R::%') AS relation_values,
 count(DISTINCT score) FILTER (element_id LIKE 'E::%') <= 1 AND count(DISTINCT score) FILTER (element_id LIKE 'R::%') <= 1 AS degenerate FROM sco GROUP BY run_id""")
def _(s, d):
    return A.degenerate(R.sco_view(s, d), "run_id")


@C.add("agg_perm_spread", f"""{SCO} SELECT exp_id, method, element_id, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max, round(max(score) - min(score), 6) AS range FROM sco GROUP BY 1, 2, 3""")
def _(s, d):
    return A.permutation_spread(R.sco_view(s, d), "exp_id", "method")


_RANKINGS = f"{SCO}, rankings AS (SELECT exp_id AS qid, list(element_id ORDER BY score DESC, element_id) AS ranking FROM sco WHERE exp_id IS NOT NULL GROUP BY exp_id, run_id)"


def rankings(s: SparkSession, d: str) -> DataFrame:
    """The ranking of each run over one explanation, whose elements are few; runs over whole graphs have no question."""
    sco = R.sco_view(s, d).where("exp_id IS NOT NULL")
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "element_id")))
    return sco.groupBy(F.col("exp_id").alias("qid"), "run_id").agg(pairs["element_id"].alias("ranking"))


_KEYS = " UNION ALL ".join([f"SELECT qid, {k} AS k, array_to_string(list_sort(ranking[1:{k}]), chr(31)) AS key FROM rankings" for k in (1, 3, 5)] + ["SELECT qid, 0 AS k, array_to_string(ranking, chr(31)) AS key FROM rankings"])


@C.add("agg_modal", f"{_RANKINGS}, g AS (SELECT qid, k, key, count(*) AS c FROM ({_KEYS}) GROUP BY 1, 2, 3) SELECT qid, k, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, max(c) AS modal FROM g GROUP BY 1, 2")
def _(s, d):
    return A.modal_rankings(rankings(s, d))


def typed_nodes(s: SparkSession, d: str) -> DataFrame:
    """The entities of found records with their clean type and whether an edit touches them."""
    e = R.ent_view(s, d).where("name <> ''").select("exp_id", "name", F.lower(F.trim(F.coalesce("type", F.lit("")))).alias("type")).distinct()
    touched = A.op_operands(R.ops_view(s, d).where("found")).select("exp_id", F.col("operand").alias("name")).distinct().withColumn("m", F.lit(True))
    return e.join(touched, ["exp_id", "name"], "left").select("exp_id", "name", "type", F.coalesce("m", F.lit(False)).alias("modified"))


_TYPED = _OPERANDS + ",\n" + R.CTE["ent"] + """, tn AS (SELECT e.exp_id, e.name, e.type, o.name IS NOT NULL AS modified FROM (SELECT DISTINCT exp_id, name, lower(trim(coalesce(type, ''))) AS type FROM ent WHERE name <> '') e
 LEFT JOIN (SELECT DISTINCT exp_id, operand AS name FROM operands) o ON o.exp_id = e.exp_id AND o.name = e.name)"""


@C.add("agg_type_enrich_ratio", f"""{_TYPED}, k AS (SELECT lower(trim(coalesce(entity_type, ''))) AS type FROM kg_nodes), a AS (SELECT type, count(*) AS n_modified FROM tn WHERE modified GROUP BY 1), b AS (SELECT type, count(*) AS n_graph FROM k GROUP BY 1),
 j AS (SELECT type, coalesce(n_modified, 0) AS n_modified, coalesce(n_graph, 0) AS n_graph, (SELECT count(*) FROM tn WHERE modified) AS am, (SELECT count(*) FROM k) AS ag FROM a FULL JOIN b USING (type))
 SELECT type, n_modified, n_graph, round(100.0e0 * n_modified / am, 6) AS pct_modified, round(100.0e0 * n_graph / ag, 6) AS pct_graph, CASE WHEN n_graph = 0 THEN CAST('inf' AS DOUBLE) ELSE round((100.0e0 * n_modified / am) / (100.0e0 * n_graph / ag), 6) END AS ratio FROM j""")
def _(s, d):
    k = table(s, d, "kg_nodes").select(F.lower(F.trim(F.coalesce("entity_type", F.lit("")))).alias("type"))
    return A.enrichment_ratio(typed_nodes(s, d).where("modified").select("type"), k)


@C.add("agg_type_lift", f"""{_TYPED}, e AS (SELECT type, count(*) FILTER (modified) AS n_mod, count(*) FILTER (NOT modified) AS n_bg FROM tn GROUP BY 1), t AS (SELECT greatest(count(*) FILTER (modified), 1) AS am, greatest(count(*) FILTER (NOT modified), 1) AS ab FROM tn)
 SELECT type, n_mod, n_bg, round(log2(greatest(n_mod / am, 1e-9) / greatest(n_bg / ab, 1e-9)), 5) AS lift FROM e, t""")
def _(s, d):
    return A.type_lift(typed_nodes(s, d))


_DEG = R.with_views("exp", "ops", "cgn") + """, deg AS (SELECT n.exp_id, n.name, count(e.v) AS degree FROM cgn n LEFT JOIN (SELECT exp_id, src AS v FROM cge UNION ALL SELECT exp_id, tgt FROM cge) e ON e.exp_id = n.exp_id AND e.v = n.name GROUP BY 1, 2),
operands AS (SELECT DISTINCT exp_id, operand FROM (SELECT exp_id, unnest([node, src, dst]) AS operand FROM ops WHERE found) WHERE operand <> ''),
dm AS (SELECT d.exp_id, d.name, d.degree, o.operand IS NOT NULL AS modified FROM deg d LEFT JOIN operands o ON o.exp_id = d.exp_id AND o.operand = d.name)"""


def degrees(s: SparkSession, d: str) -> DataFrame:
    """exp_id, name, degree in the context graph, a self-loop twice, and whether an edit touches the node."""
    ends = R.cge_view(s, d).select("exp_id", F.explode(F.array("src", "tgt")).alias("name")).groupBy("exp_id", "name").agg(F.count(F.lit(1)).alias("degree"))
    touched = A.op_operands(R.ops_view(s, d).where("found")).select("exp_id", F.col("operand").alias("name")).distinct().withColumn("m", F.lit(True))
    n = R.cgn_view(s, d).select("exp_id", "name").join(ends, ["exp_id", "name"], "left").join(touched, ["exp_id", "name"], "left")
    return n.select("exp_id", "name", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("m", F.lit(False)).alias("modified"))


@C.add("agg_feature_split", f"{_DEG} SELECT modified, count(degree) AS n, round(avg(degree), 6) AS mean, round(stddev_samp(degree), 6) AS std, min(degree) AS min, round(quantile_cont(degree, 0.25), 6) AS q25, round(quantile_cont(degree, 0.5), 6) AS q50, round(quantile_cont(degree, 0.75), 6) AS q75, max(degree) AS max FROM dm GROUP BY modified")
def _(s, d):
    return A.describe(degrees(s, d), "degree", "modified")


@C.add("agg_auc_ks", f"""{_DEG}, per AS (SELECT degree AS x, count(*) FILTER (modified) AS p, count(*) FILTER (NOT modified) AS q FROM dm GROUP BY 1), run AS (SELECT *, sum(p) OVER (ORDER BY x) AS cp, sum(q) OVER (ORDER BY x) AS cq, sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM per)
 SELECT CAST(max(tp) AS BIGINT) AS n_pos, CAST(max(tq) AS BIGINT) AS n_neg, round(sum(p * (cq - q + q / 2.0e0)) / (max(tp) * max(tq)), 6) AS auc, round(max(abs(cp / tp - cq / tq)), 6) AS ks FROM run""")
def _(s, d):
    return A.auc_and_ks(degrees(s, d).select(F.col("degree").alias("x"), F.col("modified").alias("positive")))


@C.add("agg_centrality_compare", f"""{_DEG}, ab AS (SELECT exp_id, avg(degree) FILTER (modified) AS ma, avg(degree) FILTER (NOT modified) AS mb, max(degree) FILTER (modified) AS xa, max(degree) FILTER (NOT modified) AS xb FROM dm GROUP BY 1)
 SELECT count(*) AS n, round(avg(ma), 6) AS mean_a, round(avg(mb), 6) AS mean_b, round(avg(xa), 6) AS max_a, round(avg(xb), 6) AS max_b, count(*) FILTER (ma - mb > 1e-6) AS a_wins, count(*) FILTER (ma - mb < -1e-6) AS b_wins, count(*) FILTER (abs(ma - mb) <= 1e-6) AS ties FROM ab WHERE ma IS NOT NULL AND mb IS NOT NULL""")
def _(s, d):
    return A.centrality_compare(degrees(s, d).select(F.col("exp_id").alias("qid"), F.when(F.col("modified"), "a").otherwise("b").alias("side"), F.col("degree").alias("value")))


@C.add("agg_op_composition", f"""{OPS} SELECT mode, count(*) AS n, {', '.join(f"round(count(*) FILTER (op = '{k}') / count(*), 6) AS {k}" for k in ('delete_node', 'delete_edge', 'add_node', 'add_edge'))} FROM ops WHERE found GROUP BY mode""")
def _(s, d):
    return A.op_composition(R.ops_view(s, d).where("found"), "mode")


@C.add("agg_zipf", f"""{OPS}, e AS (SELECT DISTINCT exp_id, coalesce('E::' || node, 'R::' || src || '->' || dst) AS element_id FROM ops WHERE found), c AS (SELECT element_id, count(*) AS freq FROM e WHERE element_id IS NOT NULL GROUP BY 1)
 SELECT element_id, freq, CAST(row_number() OVER (ORDER BY freq DESC, element_id) AS INT) AS rank FROM c ORDER BY rank LIMIT 50""")
def _(s, d):
    """The 50 most modified elements (a top-k report)."""
    return A.zipf(flagged(s, d).select("exp_id", "element_id"), 50)


_KGDEG = R.with_views("kgn", "kge") + """, kdeg AS (SELECT n.kg_id, n.name, n.type, count(e.v) AS degree FROM kgn n LEFT JOIN (SELECT kg_id, src AS v FROM kge UNION ALL SELECT kg_id, tgt FROM kge) e ON e.kg_id = n.kg_id AND e.v = n.name GROUP BY 1, 2, 3)"""


def kg_degrees(s: SparkSession, d: str) -> DataFrame:
    ends = R.kge_view(s, d).select("kg_id", F.explode(F.array("src", "tgt")).alias("name")).groupBy("kg_id", "name").agg(F.count(F.lit(1)).alias("degree"))
    return R.kgn_view(s, d).join(ends, ["kg_id", "name"], "left").select("kg_id", "name", "type", F.coalesce("degree", F.lit(0)).alias("degree"))


@C.add("agg_degree_dist", f"{_KGDEG} SELECT kg_id, degree, count(*) AS n FROM kdeg GROUP BY 1, 2")
def _(s, d):
    return kg_degrees(s, d).groupBy("kg_id", "degree").agg(F.count(F.lit(1)).alias("n"))


@C.add("agg_describe", f"{_KGDEG} SELECT kg_id, count(degree) AS n, round(avg(degree), 6) AS mean, round(stddev_samp(degree), 6) AS std, min(degree) AS min, round(quantile_cont(degree, 0.25), 6) AS q25, round(quantile_cont(degree, 0.5), 6) AS q50, round(quantile_cont(degree, 0.75), 6) AS q75, max(degree) AS max FROM kdeg GROUP BY 1")
def _(s, d):
    return A.describe(kg_degrees(s, d), "degree", "kg_id")


@C.add("agg_degree_freq", f"""{_KGDEG}, {R.CTE['ops']}, f AS (SELECT kg_id, operand AS name, count(*) AS freq FROM (SELECT kg_id, unnest([node, src, dst]) AS operand FROM ops WHERE found) WHERE operand <> '' GROUP BY 1, 2)
 SELECT degree, count(*) AS n, round(avg(coalesce(freq, 0)), 6) AS mean_freq FROM kdeg LEFT JOIN f USING (kg_id, name) GROUP BY degree""")
def _(s, d):
    freq = A.op_operands(R.ops_view(s, d).where("found")).groupBy("kg_id", F.col("operand").alias("name")).agg(F.count(F.lit(1)).alias("freq"))
    return kg_degrees(s, d).join(freq, ["kg_id", "name"], "left").groupBy("degree").agg(F.count(F.lit(1)).alias("n"), A.rnd(F.avg(F.coalesce("freq", F.lit(0)))).alias("mean_freq"))


@C.add("agg_log_hist", f"""{_KGDEG}, e AS (SELECT min(degree) AS lo, max(degree) AS hi, count(*) AS n FROM kdeg WHERE degree > 0) SELECT CAST(least(CASE WHEN hi > lo THEN floor(ln(degree / lo) / (ln(hi / lo) / 7) + 1e-9) ELSE 0 END, 6) AS INT) AS bin, count(*) AS n, round(100.0e0 * count(*) / max(e.n), 6) AS pct FROM kdeg, e WHERE degree > 0 GROUP BY 1""")
def _(s, d):
    return A.log_histogram(kg_degrees(s, d), "degree", 7)


@C.add("agg_ops_by_size", f"""{EXP}, g AS (SELECT len(original_subgraph.entities) + len(original_subgraph.relations) AS size, num_operations FROM exp WHERE found AND original_subgraph IS NOT NULL), e AS (SELECT min(size) AS lo, max(size) + 1 AS hi FROM g)
 SELECT CAST(floor((size - lo) * 10 / (hi - lo)) AS INT) + 1 AS bin, count(*) AS n, round(avg(num_operations), 6) AS mean FROM g, e GROUP BY 1""")
def _(s, d):
    size = F.size("original_subgraph.entities") + F.size("original_subgraph.relations")
    g = R.exp_view(s, d, "found", "num_operations", size.alias("size")).where("found")
    return A.by_size_bins(g, "size", "num_operations")


_IMPACT = R.with_views("exp", "ops", "cgn") + """, del AS (SELECT DISTINCT exp_id, node FROM ops WHERE found AND op = 'delete_node'), dele AS (SELECT DISTINCT exp_id, src, dst FROM ops WHERE found AND op = 'delete_edge'),
en AS (SELECT exp_id, count(*) AS n_nodes FROM cgn GROUP BY 1), ee AS (SELECT exp_id, count(*) AS n_edges FROM cge GROUP BY 1),
hn AS (SELECT c.exp_id, count(*) AS h FROM cgn c JOIN del ON del.exp_id = c.exp_id AND del.node = c.name GROUP BY 1),
he AS (SELECT c.exp_id, count(*) AS h FROM cge c WHERE EXISTS (SELECT 1 FROM del WHERE del.exp_id = c.exp_id AND del.node IN (c.src, c.tgt)) OR EXISTS (SELECT 1 FROM dele WHERE dele.exp_id = c.exp_id AND dele.src = c.src AND dele.dst = c.tgt) GROUP BY 1)"""


@C.add("agg_impact_pct", f"""{_IMPACT} SELECT exp_id, n_nodes + coalesce(n_edges, 0) AS size, coalesce(hn.h, 0) + coalesce(he.h, 0) AS hit, round(100.0e0 * (coalesce(hn.h, 0) + coalesce(he.h, 0)) / (n_nodes + coalesce(n_edges, 0)), 6) AS pct
 FROM en LEFT JOIN ee USING (exp_id) LEFT JOIN hn USING (exp_id) LEFT JOIN he USING (exp_id)""")
def _(s, d):
    """Share of the context graph that deletions take away: deleted nodes, their edges and deleted edges."""
    ops = R.ops_view(s, d).where("found")
    gone = ops.where("op = 'delete_node'").select("exp_id", F.col("node").alias("name")).distinct()
    cut = ops.where("op = 'delete_edge'").select("exp_id", "src", F.col("dst").alias("tgt")).distinct()
    nodes, edges = R.cgn_view(s, d), R.cge_view(s, d)
    hit_e = edges.select("exp_id", "src", "tgt", F.explode(F.array("src", "tgt")).alias("name")).join(gone, ["exp_id", "name"], "left_semi").select("exp_id", "src", "tgt")
    hit_e = hit_e.unionByName(edges.join(cut, ["exp_id", "src", "tgt"], "left_semi").select("exp_id", "src", "tgt")).distinct().groupBy("exp_id").agg(F.count(F.lit(1)).alias("he"))
    hit_n = nodes.join(gone, ["exp_id", "name"], "left_semi").groupBy("exp_id").agg(F.count(F.lit(1)).alias("hn"))
    n = nodes.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n_edges")), "exp_id", "left")
    j = n.join(hit_n, "exp_id", "left").join(hit_e, "exp_id", "left").fillna(0, ["n_edges", "hn", "he"])
    size, hit = F.col("n_nodes") + F.col("n_edges"), F.col("hn") + F.col("he")
    return j.select("exp_id", size.alias("size"), hit.alias("hit"), A.rnd(100.0 * hit / size).alias("pct"))


@C.add("agg_jaccard_runs", f"""{EXP}, n AS (SELECT DISTINCT exp_id FROM noise_runs WHERE found), a AS (SELECT exp_id FROM exp WHERE found) SELECT count(*) FILTER (a.exp_id IS NOT NULL AND n.exp_id IS NOT NULL) AS "both", count(*) FILTER (n.exp_id IS NULL) AS only_a, count(*) FILTER (a.exp_id IS NULL) AS only_b,
 round(coalesce(count(*) FILTER (a.exp_id IS NOT NULL AND n.exp_id IS NOT NULL) / nullif(count(*), 0), 0.0e0), 6) AS jaccard FROM a FULL JOIN n ON n.exp_id = a.exp_id""")
def _(s, d):
    return A.jaccard_of_runs(R.exp_view(s, d, "found").where("found"), table(s, d, "noise_runs").where("found"), "exp_id")


@C.add("agg_context_regress", f"""{EXP}, g AS (SELECT CAST(len(original_subgraph.entities) + len(original_subgraph.relations) AS DOUBLE) AS x, timings.total_seconds AS y FROM exp WHERE original_subgraph IS NOT NULL) SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM g""")
def _(s, d):
    size = F.size("original_subgraph.entities") + F.size("original_subgraph.relations")
    return A.regression(R.exp_view(s, d, size.alias("size"), F.col("timings.total_seconds").alias("t")), "size", "t")


@C.add("agg_cost_gap", f"""{TWO}, t AS (SELECT qid, sum(CASE WHEN rn <= 3 THEN 1 END) AS attributed FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, element_id) AS rn FROM a) GROUP BY 1), x AS (SELECT DISTINCT ON (exp_id) exp_id, cost, found FROM explanations),
 j AS (SELECT CAST(attributed AS DOUBLE) AS p, CASE WHEN found THEN cost END AS q FROM t JOIN x ON x.exp_id = t.qid)
 SELECT count(p - q) AS n, count(*) - count(p - q) AS skipped, round(avg(p - q), 6) AS mean_gap, round(median(p - q), 6) AS median_gap, round(avg(abs(p - q)), 6) AS mean_abs_gap, round(avg(p / nullif(q, 0)), 6) AS mean_ratio FROM j""")
def _(s, d):
    """Number of the three best attributed elements against the cost of the found edits."""
    from pyspark.sql import Window

    a, _b = two_runs(s, d)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "element_id")
    top = a.withColumn("rn", F.row_number().over(w)).groupBy("qid").agg(F.sum(F.when(F.col("rn") <= 3, 1)).alias("attributed"))
    x = R.exp_view(s, d, "cost", "found").select(F.col("exp_id").alias("qid"), F.when(F.col("found"), F.col("cost")).alias("actual"))
    return A.cost_gap(top.join(x, "qid"))

"""Queries of filters, projections, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipgraph.functions import ids, text, vectors
from flipgraph.operators import generators as N
from flipgraph.operators.aggregates import op_operands, rnd
from flipgraph.operators.attribution import beta_weight, kernel_weight
from flipgraph.plans import aggregates as PA
from flipgraph.plans.catalog import Catalog
from flipgraph.plans.graph import DOT
from flipgraph.sources import records as R
from flipgraph.sources.tables import table

C = Catalog()
EXP, OPS, NOI, SCO = R.with_views("exp"), R.with_views("ops"), R.with_views("noi"), R.with_views("sco")

# ---- Filters


@C.add("flt_found", f"{EXP} SELECT exp_id, cost FROM exp WHERE found AND num_operations > 0")
def _(s, d):
    return R.exp_view(s, d, "found", "num_operations", "cost").where("found AND num_operations > 0").select("exp_id", "cost")


@C.add("flt_case", f"{EXP} SELECT exp_id, mode FROM exp WHERE mode IN ('ft', 'ff')")
def _(s, d):
    return R.exp_view(s, d, "mode").where("mode IN ('ft', 'ff')")


@C.add("flt_qset", f"{EXP} SELECT exp_id, question FROM exp WHERE question IN (SELECT question FROM noise_runs)")
def _(s, d):
    return R.exp_view(s, d, "question").join(table(s, d, "noise_runs").select("question").distinct(), "question", "left_semi").select("exp_id", "question")


_CLEAN = "length(trim(t)) BETWEEN 30 AND 1000 AND length(regexp_replace(trim(t), '[^\\p{L}]', '', 'g')) >= 10 AND NOT regexp_matches(trim(t), '^[a-f0-9\\-]{20,}$')" + "".join(f" AND NOT contains(t, '{m}')" for m in text.UNIT_MARKS)


@C.add("flt_textclean", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT doc_id, count(*) AS n FROM l WHERE {_CLEAN} GROUP BY 1")
def _(s, d):
    each = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return each.where(text.clean_unit(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@C.add("lim_rows", f"{EXP} SELECT exp_id, question FROM exp ORDER BY exp_id LIMIT 100")
def _(s, d):
    """The first 100 records in the order of their ids (a limit is the feature)."""
    return R.exp_view(s, d, "question").orderBy("exp_id").limit(100)


@C.add("smp_pct", f"{EXP}, f AS (SELECT exp_id, row_number() OVER (ORDER BY md5(exp_id || '|7'), exp_id) AS rn, count(*) OVER () AS n FROM exp WHERE found) SELECT exp_id FROM f WHERE rn <= round_even(n * 30 / 100.0e0, 0)")
def _(s, d):
    """30 percent of the found records, by a seeded hash (a sampling operator)."""
    return N.sampled_percent(R.exp_view(s, d, "found").where("found").select("exp_id"), "exp_id", 30, 7)


# ---- Projections


@C.add("prj_ops_ids", f"{OPS} SELECT exp_id, min(seq) AS seq, element_id FROM (SELECT exp_id, seq, coalesce('E::' || node, 'R::' || src || '->' || dst) AS element_id FROM ops) WHERE element_id IS NOT NULL GROUP BY 1, 3")
def _(s, d):
    return R.ids_of_ops(R.ops_view(s, d)).where("element_id IS NOT NULL").groupBy("exp_id", "element_id").agg(F.min("seq").alias("seq"))


@C.add("prj_subgraph_ids", f"""{R.with_views('ent', 'rel')} SELECT exp_id, element_id, arg_max(description, pos) AS description FROM (SELECT exp_id, 'E::' || name AS element_id, coalesce(description, '') AS description, pos FROM ent
 UNION ALL SELECT exp_id, 'R::' || src || '->' || tgt, coalesce(description, ''), pos FROM rel) WHERE element_id IS NOT NULL GROUP BY 1, 2""")
def subgraph_ids(s, d):
    """Ids of a subgraph's elements with their description, the later of equal ids."""
    e = R.ent_view(s, d).select("exp_id", ids.entity_id(F.col("name")).alias("element_id"), "description", "pos")
    r = R.rel_view(s, d).select("exp_id", ids.relation_id(F.col("src"), F.col("tgt")).alias("element_id"), "description", "pos")
    return e.unionByName(r).where("element_id IS NOT NULL").groupBy("exp_id", "element_id").agg(F.max_by(F.coalesce("description", F.lit("")), "pos").alias("description"))


@C.add("prj_op_operands", f"{OPS} SELECT exp_id, seq, op, operand FROM (SELECT exp_id, seq, op, unnest([node, src, dst]) AS operand FROM ops WHERE op LIKE 'delete%') WHERE operand <> ''")
def _(s, d):
    return op_operands(R.ops_view(s, d), "deletions").select("exp_id", "seq", "op", "operand")


@C.add("prj_split_ops", f"{OPS} SELECT operand, is_add, count(DISTINCT exp_id) AS n_records, count(*) AS n FROM (SELECT exp_id, op LIKE 'add%' AS is_add, unnest([node, src, dst]) AS operand FROM ops) WHERE operand <> '' GROUP BY 1, 2")
def _(s, d):
    return op_operands(R.ops_view(s, d)).groupBy("operand", F.col("op").startswith("add").alias("is_add")).agg(F.count_distinct("exp_id").alias("n_records"), F.count("*").alias("n"))


@C.add("prj_describe", f"""{OPS} SELECT exp_id, seq, CASE op WHEN 'delete_node' THEN 'Delete node ' || node WHEN 'add_node' THEN 'Add node ' || node WHEN 'delete_edge' THEN 'Delete edge ' || src || ' -> ' || dst WHEN 'add_edge' THEN 'Add edge ' || src || ' -> ' || dst END AS description FROM ops""")
def _(s, d):
    verb = F.initcap(F.replace("op", F.lit("_"), F.lit(" ")))
    what = F.coalesce("node", F.concat("src", F.lit(" -> "), "dst"))
    return R.ops_view(s, d).select("exp_id", "seq", F.concat(F.substring(verb, 1, 1), F.lower(F.expr("substring(initcap(replace(op, '_', ' ')), 2)")), F.lit(" "), what).alias("description"))


# Names of ablation cells (fixed patterns).
_CELLS = ["ft_no_psp", "ft_psp_k5", "tf_add_adm1_none", "tf_add_adm2_tier_w0.5", "ff_add_adm3_blend_a0.25", "other"]
_CELL = r"^(ft|tf|ff)_(?:(no_psp)|(psp)_k(\d+)|add_adm([123])_(none|tier|blend)(?:_[wa]([\d.]+))?)$"


@C.add("prj_cell_name", f"""{EXP}, c AS (SELECT exp_id, ['{"', '".join(_CELLS)}'][CAST(exp_id % 6 AS INT) + 1] AS cell FROM exp), m AS (SELECT exp_id, cell, regexp_extract(cell, '{_CELL}', ['phase', 'a', 'b', 'k', 'adm', 'm', 'h']) AS r FROM c)
 SELECT exp_id, cell, nullif(r.phase, '') AS phase, nullif(concat(r.a, r.b, r.m), '') AS method, TRY_CAST(nullif(r.adm, '') AS INT) AS adm, TRY_CAST(nullif(concat(r.k, r.h), '') AS DOUBLE) AS value FROM m""")
def _(s, d):
    """Phase, method, cost model and hyperparameter of an ablation cell's name; nulls for other names."""
    cell = F.element_at(F.array(*map(F.lit, _CELLS)), (F.col("exp_id") % 6 + 1).cast("int"))
    g = lambda i: F.regexp_extract("cell", _CELL, i)
    some = lambda c: F.nullif(c, F.lit(""))
    return R.exp_view(s, d).select("exp_id", cell.alias("cell")).select("exp_id", "cell", some(g(1)).alias("phase"), some(F.concat(g(2), g(3), g(6))).alias("method"), some(g(5)).cast("int").alias("adm"), some(F.concat(g(4), g(7))).cast("double").alias("value"))


@C.add("prj_direction", f"{EXP} SELECT exp_id, mode, {PA.DIRECTION_SQL} AS direction FROM exp")
def _(s, d):
    return R.exp_view(s, d, "mode").withColumn("direction", PA.direction())


# ---- Joins


def two_score_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = PA.scored_cases(s, d)
    return c.select("id", F.col("llm_score").alias("score")), c.select("id", F.col("rag_score").alias("score"))


def compare_runs(llm: DataFrame, rag: DataFrame, key: str) -> DataFrame:
    """Cases of two runs over the same questions; those that one run lacks are left out."""
    letter = lambda c: F.when(F.col(c) == 1, "t").otherwise("f")
    j = llm.withColumnRenamed("score", "llm_score").join(rag.withColumnRenamed("score", "rag_score"), key)
    return j.select(key, "llm_score", "rag_score", F.concat(letter("llm_score"), letter("rag_score")).alias("case"))


@C.add("join_llm_rag", f"""{PA.CASES} SELECT id, llm_score, rag_score, CASE WHEN llm_score = 1 THEN 't' ELSE 'f' END || CASE WHEN rag_score = 1 THEN 't' ELSE 'f' END AS "case" FROM cases""")
def _(s, d):
    return compare_runs(*two_score_tables(s, d), "id")


@C.add("join_llm_rag_q", f"""{EXP}, a AS (SELECT question, arg_min(CAST(substr(mode, 1, 1) = 't' AS INT), exp_id) AS llm_score FROM exp WHERE question IS NOT NULL AND mode IS NOT NULL GROUP BY 1), b AS (SELECT question, arg_min(CAST(found AS INT), noise_id) AS rag_score FROM noise_runs WHERE question IS NOT NULL GROUP BY 1)
 SELECT question, llm_score, rag_score, CASE WHEN llm_score = 1 THEN 't' ELSE 'f' END || CASE WHEN rag_score = 1 THEN 't' ELSE 'f' END AS "case" FROM a JOIN b USING (question)""")
def _(s, d):
    """The same by question, each question's first row."""
    a = R.exp_view(s, d, "question", "mode").where("question IS NOT NULL AND mode IS NOT NULL").groupBy("question").agg(F.min_by((F.substring("mode", 1, 1) == "t").cast("int"), "exp_id").alias("score"))
    b = table(s, d, "noise_runs").where("question IS NOT NULL").groupBy("question").agg(F.min_by(F.col("found").cast("int"), "noise_id").alias("score"))
    return compare_runs(a, b, "question")


@C.add("join_resolve_id", f"""{EXP}, f AS (SELECT exp_id, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS q FROM exp), byq AS (SELECT q, min(exp_id) AS exp_id FROM f WHERE q IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT ON (noise_id) noise_id, CASE WHEN noise_id % 2 = 0 THEN exp_id END AS key, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS q FROM noise_runs)
 SELECT noise_id, coalesce(f.exp_id, byq.exp_id) AS resolved FROM n LEFT JOIN f ON f.exp_id = n.key LEFT JOIN byq ON byq.q = n.q""")
def _(s, d):
    """The record of a run by its key, else by its question; here every other run has lost its key."""
    f = R.exp_view(s, d, "question").select("exp_id", text.norm_question(F.col("question")).alias("q"))
    by_q = f.where("q IS NOT NULL").groupBy("q").agg(F.min("exp_id").alias("by_q"))
    n = R.noise_view(s, d, "exp_id", "question").select("noise_id", F.when(F.col("noise_id") % 2 == 0, F.col("exp_id")).alias("exp_id"), text.norm_question(F.col("question")).alias("q"))
    j = n.join(f.select("exp_id", F.col("exp_id").alias("by_key")), "exp_id", "left").join(by_q, "q", "left")
    return j.select("noise_id", F.coalesce("by_key", "by_q").alias("resolved"))


_KGDESC = "kd AS (SELECT kg_id, name, arg_max(description, (valid_from, description)) AS description FROM kg_nodes WHERE description <> '' GROUP BY 1, 2)"


@C.add("join_desc_provider", f"{R.with_views('ent')}, {_KGDESC} SELECT exp_id, pos, e.name, coalesce(nullif(e.description, ''), kd.description, '') AS description FROM ent e LEFT JOIN kd ON kd.kg_id = e.kg_id AND kd.name = e.name")
def _(s, d):
    """An entity's own description, else its node's latest, else none."""
    kd = table(s, d, "kg_nodes").where("description <> ''").groupBy("kg_id", "name").agg(F.max_by("description", F.struct("valid_from", "description")).alias("kd"))
    e = R.ent_view(s, d).join(kd, ["kg_id", "name"], "left")
    return e.select("exp_id", "pos", "name", F.coalesce(F.nullif("description", F.lit("")), "kd", F.lit("")).alias("description"))


@C.add("join_edge_either_dir", f"{R.with_views('cge', 'ops')}, o AS (SELECT exp_id, seq, src, dst FROM ops WHERE op LIKE '%edge') SELECT o.exp_id, o.seq, coalesce(a.description, b.description) AS description FROM o LEFT JOIN cge a ON a.exp_id = o.exp_id AND a.src = o.src AND a.tgt = o.dst LEFT JOIN cge b ON b.exp_id = o.exp_id AND b.src = o.dst AND b.tgt = o.src")
def _(s, d):
    """The description of an edited edge, in either direction."""
    e = R.cge_view(s, d).select("exp_id", "src", F.col("tgt").alias("dst"), "description")
    o = R.ops_view(s, d).where("op LIKE '%edge'").select("exp_id", "seq", "src", "dst")
    back = e.select("exp_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("description").alias("back"))
    j = o.join(e, ["exp_id", "src", "dst"], "left").join(back, ["exp_id", "src", "dst"], "left")
    return j.select("exp_id", "seq", F.coalesce("description", "back").alias("description"))


@C.add("join_merge_shap", f"""{R.with_views('exp', 'sco')}, sc AS (SELECT exp_id, count(DISTINCT run_id) AS runs, count(*) AS scores FROM sco GROUP BY 1), nr AS (SELECT exp_id, count(DISTINCT noise_id) AS noise_runs FROM noise_runs GROUP BY 1)
 SELECT exp.exp_id, exp.mode, coalesce(runs, 0) AS runs, coalesce(scores, 0) AS scores, coalesce(noise_runs, 0) AS noise_runs FROM exp LEFT JOIN sc USING (exp_id) LEFT JOIN nr USING (exp_id)""")
def _(s, d):
    """Records with what attributions and noise runs exist for them; none counts as 0."""
    sc = R.sco_view(s, d).groupBy("exp_id").agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("scores"))
    nr = table(s, d, "noise_runs").groupBy("exp_id").agg(F.count_distinct("noise_id").alias("noise_runs"))
    return R.exp_view(s, d, "mode").join(sc, "exp_id", "left").join(nr, "exp_id", "left").fillna(0, ["runs", "scores", "noise_runs"])


@C.add("join_metadata", f"{R.with_views('ops', 'ent')}, f AS (SELECT exp_id, name, arg_min(coalesce(type, ''), pos) AS type FROM ent GROUP BY 1, 2) SELECT o.exp_id, o.seq, o.node, f.type FROM ops o JOIN f ON f.exp_id = o.exp_id AND f.name = o.node")
def _(s, d):
    """Type of an edited node from its first entity; edits of unknown nodes are dropped."""
    f = R.ent_view(s, d).groupBy("exp_id", F.col("name").alias("node")).agg(F.min_by(F.coalesce("type", F.lit("")), "pos").alias("type"))
    return R.ops_view(s, d).join(f, ["exp_id", "node"]).select("exp_id", "seq", "node", "type")


@C.add("join_whitelist", f"{NOI}, w AS (SELECT DISTINCT exp_id, noise_level FROM noi WHERE found AND noise.noise_robust) SELECT n.noise_id, n.exp_id, n.noise_level FROM noi n WHERE EXISTS (SELECT 1 FROM w WHERE w.exp_id = n.exp_id AND w.noise_level = n.noise_level)")
def _(s, d):
    n = R.noise_view(s, d, "exp_id", "noise_level", "found", F.col("noise.noise_robust").alias("robust"))
    w = n.where("found AND robust").select("exp_id", "noise_level").distinct()
    return n.join(w, ["exp_id", "noise_level"], "left_semi").select("noise_id", "exp_id", "noise_level")


@C.add("join_missing_nodes", f"{R.with_views('ops', 'kgn')}, o AS (SELECT DISTINCT kg_id, operand FROM (SELECT kg_id, unnest([node, src, dst]) AS operand FROM ops) WHERE operand <> '') SELECT o.kg_id, o.operand, k.name IS NOT NULL AS in_graph FROM o LEFT JOIN kgn k ON k.kg_id = o.kg_id AND k.name = o.operand")
def _(s, d):
    o = op_operands(R.ops_view(s, d)).select("kg_id", "operand").distinct()
    k = R.kgn_view(s, d).select("kg_id", F.col("name").alias("operand"), F.lit(True).alias("k"))
    return o.join(k, ["kg_id", "operand"], "left").select("kg_id", "operand", F.col("k").isNotNull().alias("in_graph"))


_NEWNODES = f"""{NOI}, b AS (SELECT DISTINCT noise_id, name FROM (SELECT noise_id, unnest(original_subgraph.entities).name AS name FROM noi) WHERE name IS NOT NULL), z AS (SELECT DISTINCT noise_id, name FROM (SELECT noise_id, unnest(noisy_subgraph.entities).name AS name FROM noi) WHERE name IS NOT NULL)"""


def noise_names(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = R.noise_view(s, d, F.col("original_subgraph.entities.name").alias("b"), F.col("noisy_subgraph.entities.name").alias("z"))
    return tuple(n.select("noise_id", F.explode(c).alias("name")).where("name IS NOT NULL").distinct() for c in ("b", "z"))


@C.add("join_noise_flag", f"{_NEWNODES} SELECT z.noise_id, z.name, b.name IS NULL AS is_noise FROM z LEFT JOIN b USING (noise_id, name)")
def _(s, d):
    b, z = noise_names(s, d)
    return z.join(b.withColumn("known", F.lit(True)), ["noise_id", "name"], "left").select("noise_id", "name", F.col("known").isNull().alias("is_noise"))


@C.add("set_except_noise", f"{_NEWNODES} SELECT noise_id, name FROM z EXCEPT SELECT noise_id, name FROM b")
def _(s, d):
    b, z = noise_names(s, d)
    return z.exceptAll(b)


@C.add("set_intersect_q", f"{SCO} SELECT exp_id FROM sco WHERE method = 'exact_shapley' INTERSECT SELECT exp_id FROM sco WHERE method = 'tmc_shapley'")
def _(s, d):
    sco = R.sco_view(s, d).select("exp_id", "method")
    return sco.where("method = 'exact_shapley'").select("exp_id").intersect(sco.where("method = 'tmc_shapley'").select("exp_id"))


@C.add("set_union_counts", f"{OPS} SELECT operand, count(*) AS n FROM (SELECT unnest([node, src, dst]) AS operand FROM ops WHERE mode = 'ft' UNION ALL SELECT unnest([node, src, dst]) FROM ops WHERE mode IN ('ff', 'tf')) WHERE operand <> '' GROUP BY 1")
def _(s, d):
    o = R.ops_view(s, d)
    both = op_operands(o.where("mode = 'ft'")).select("operand").unionByName(op_operands(o.where("mode IN ('ff', 'tf')")).select("operand"))
    return both.groupBy("operand").agg(F.count("*").alias("n"))


@C.add("join_units_any", f"{PA.RELEVANT} SELECT exp_id, count(*) FILTER (relevant) AS n FROM relevant GROUP BY 1")
def _(s, d):
    return PA.relevance(s, d).groupBy("exp_id").agg(F.count(F.when(F.col("relevant"), 1)).alias("n"))


# ---- Scalar functions, over the answers of all records


def answers(s: SparkSession, d: str) -> DataFrame:
    return R.exp_view(s, d, "question", F.col("answers.ground_truth").alias("g"), F.col("answers.original").alias("o"), F.col("answers.perturbed").alias("p"))


ANS = f"{EXP}, ans AS (SELECT exp_id, question, answers.ground_truth AS g, answers.original AS o, answers.perturbed AS p FROM exp)"


def function(name: str, sql: str, make) -> None:
    def query(s, d):
        return answers(s, d).select("exp_id", make().alias("value"))

    query.__doc__ = f"The function {name} over all records."
    C.add(name, f"{ANS} SELECT exp_id, {sql} AS value FROM ans")(query)


_N = PA.norm_sql
_TOK = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
_JAC = f"CASE WHEN len({_TOK.format(x='g')}) > 0 AND len({_TOK.format(x='o')}) > 0 THEN round(len(list_intersect({_TOK.format(x='g')}, {_TOK.format(x='o')})) / len(list_distinct(list_concat({_TOK.format(x='g')}, {_TOK.format(x='o')}))), 6) ELSE 0.0e0 END"
function("fn_norm", f"CASE WHEN g IS NOT NULL THEN {_N('g')} END", lambda: text.norm(F.col("g")))
function("fn_contains", PA.contains_sql("g", "o"), lambda: text.norm_contains(F.col("g"), F.col("o")))
function("fn_jaccard", _JAC, lambda: rnd(text.token_jaccard(F.col("g"), F.col("o"))))
function("fn_answer_sim", _JAC.replace("lower(g)", "lower(p)"), lambda: rnd(text.token_jaccard(F.col("p"), F.col("o"))))
function("fn_normq", "trim(regexp_replace(lower(question), '\\s+', ' ', 'g'))", lambda: text.norm_question(F.col("question")))
function("fn_sent_dot", "array_to_string(list_filter(list_transform(string_split(g, '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> ''), '|')", lambda: F.array_join(text.sentences_by_dot(F.col("g")), "|"))
function("fn_words", "len(list_filter(regexp_split_to_array(g, '[\\s\\pZ]+'), lambda x: x <> ''))", lambda: F.when(F.col("g").isNotNull(), F.size(text.words(F.col("g"))).cast("long")))
function("fn_rejoin", "CASE WHEN len(list_filter(list_transform(string_split(g, '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> '')) > 0 THEN array_to_string(list_filter(list_transform(string_split(g, '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> ''), '. ') || '.' ELSE '' END", lambda: text.rejoin_sentences(text.sentences_by_dot(F.col("g"))))
function("fn_score_parse", "coalesce(CAST(contains(o, '1') AS INT), 0)", lambda: text.judged_one(F.col("o")))
function("fn_esc", "replace(replace(replace(replace(replace(o, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')", lambda: text.escape_html(F.col("o")))
function("fn_para", "array_to_string(list_filter(list_transform(string_split(g, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> ''), '|')", lambda: F.array_join(text.paragraphs(F.col("g")), "|"))
function("fn_safe_div", "round(length(o) / nullif(length(p), 0), 6)", lambda: rnd(F.try_divide(F.length("o").cast("double"), F.length("p").cast("double"))))
function("fn_shapkernel", "round(CASE (exp_id % 5) " + " ".join(f"WHEN {k} THEN {kernel_weight(5, k)!r}e0" if "." not in repr(kernel_weight(5, k)) else f"WHEN {k} THEN CAST('{kernel_weight(5, k)!r}' AS DOUBLE)" for k in range(5)) + " END, 6)",
         lambda: rnd(F.expr("CASE WHEN exp_id % 5 = 0 THEN 1000.0D ELSE 4.0D / ((factorial(5) / (factorial(exp_id % 5) * factorial(5 - exp_id % 5))) * (exp_id % 5) * (5 - exp_id % 5)) END")))


@C.add("fn_sent_regex")
def _(s, d):
    """Sentences by punctuation and a capital; DuckDB has no look-around for a twin."""
    return answers(s, d).select("exp_id", F.array_join(text.sentences_by_case(F.col("g")), "|").alias("value"))


@C.add("fn_beta_pdf")
def _(s, d):
    """Beta(4, 1) density at k of 5, from the same function as the estimator."""
    values = F.array(*(F.lit(beta_weight(5, k, 4, 1)) for k in range(5)))
    return R.exp_view(s, d).select("exp_id", rnd(F.element_at(values, (F.col("exp_id") % 5 + 1).cast("int"))).alias("value"))


@C.add("fn_parse_id", f"{R.with_views('sco')} SELECT DISTINCT element_id, CASE WHEN element_id LIKE 'E::%' THEN 'entity' WHEN element_id LIKE 'R::%' THEN 'relation' END AS kind, {PA.HEAD} AS head, {PA.TAIL} AS tail FROM sco")
def _(s, d):
    e = F.col("element_id")
    return R.sco_view(s, d).select("element_id").distinct().select("element_id", ids.kind(e).alias("kind"), ids.head(e).alias("head"), ids.tail(e).alias("tail"))


@C.add("fn_edge_id_undirected", f"{R.with_views('cge')} SELECT exp_id, src, tgt, 'R::' || least(src, tgt) || '->' || greatest(src, tgt) AS element_id FROM cge")
def _(s, d):
    return R.cge_view(s, d).select("exp_id", "src", "tgt", ids.undirected_id(F.col("src"), F.col("tgt")).alias("element_id"))


@C.add("fn_utility", f"{EXP} SELECT exp_id, round(ln(p), 6) AS log_prob, round(ln(p / (1 - p)), 6) AS logit, round(-ln(p), 6) AS log_perplexity FROM (SELECT exp_id, least(greatest(answers.similarity, 1e-6), 1 - 1e-6) AS p FROM exp WHERE answers.similarity IS NOT NULL)")
def _(s, d):
    """Utilities of an answer's probability, for which its similarity stands in."""
    p = F.col("p")
    rows = R.exp_view(s, d, F.col("answers.similarity").alias("x")).where("x IS NOT NULL").withColumn("p", F.least(F.greatest("x", F.lit(1e-6)), F.lit(1 - 1e-6)))
    return rows.select("exp_id", rnd(F.ln(p)).alias("log_prob"), rnd(F.ln(p / (1 - p))).alias("logit"), rnd(-F.ln(p)).alias("log_perplexity"))


# ---- Vector functions, each vector against the next one


def vector_pairs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


_VP = "WITH v AS (SELECT x.vec_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_D = DOT.format(a="a", b="b")
_COS = f"({_D} / (sqrt({DOT.format(a='a', b='a')}) * sqrt({DOT.format(a='b', b='b')})))"


@C.add("fn_dot", f"{_VP} SELECT vec_id, round({_D}, 6) AS value FROM v")
def _(s, d):
    return vector_pairs(s, d).select("vec_id", rnd(vectors.dot(F.col("a"), F.col("b"))).alias("value"))


@C.add("fn_cos", f"{_VP} SELECT vec_id, round({_COS}, 6) AS value FROM v")
def _(s, d):
    return vector_pairs(s, d).select("vec_id", rnd(vectors.cosine(F.col("a"), F.col("b"))).alias("value"))


@C.add("fn_kernel", f"{_VP} SELECT vec_id, round(exp(-({_COS} * {_COS}) / 0.0625e0), 5) AS value FROM v")
def _(s, d):
    return vector_pairs(s, d).select("vec_id", rnd(vectors.kernel(vectors.cosine(F.col("a"), F.col("b"))), 5).alias("value"))


@C.add("fn_wasserstein", f"{_VP}, w AS (SELECT vec_id, list_sort(a) AS a, list_sort(b) AS b FROM v) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE)))) / 64, 6) AS value FROM w")
def _(s, d):
    return vector_pairs(s, d).select("vec_id", rnd(vectors.wasserstein(F.col("a"), F.col("b"))).alias("value"))


@C.add("fn_jsd", f"""{_VP}, w AS (SELECT vec_id, list_transform(a, lambda x: abs(CAST(x AS DOUBLE))) AS p, list_transform(b, lambda x: abs(CAST(x AS DOUBLE))) AS q FROM v), t AS (SELECT vec_id, list_transform(p, lambda x: (x + 1e-10) / (list_sum(p) + 64 * 1e-10)) AS p, list_transform(q, lambda x: (x + 1e-10) / (list_sum(q) + 64 * 1e-10)) AS q FROM w)
 SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (p[i] * ln(p[i] / ((p[i] + q[i]) / 2)) + q[i] * ln(q[i] / ((p[i] + q[i]) / 2))) / 2)), 6) AS value FROM t""")
def _(s, d):
    v = vector_pairs(s, d)
    size = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")))
    return v.select("vec_id", rnd(vectors.jensen_shannon(size("a"), size("b"))).alias("value"))

"""Queries of context parsing, rendering and of the input generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.operators import context as X
from flipgraph.operators import generators as N
from flipgraph.plans import aggregates as PA
from flipgraph.plans import attribution as PT
from flipgraph.plans.catalog import Catalog
from flipgraph.sources import records as R
from flipgraph.sources.tables import table

C = Catalog()
EXP = R.with_views("exp")

LINES = f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS pos FROM documents WHERE text IS NOT NULL),
heads AS (SELECT *, lower(trim(coalesce(nullif(regexp_extract(trim(line), '{X.DASHED}', 1), ''), nullif(regexp_extract(trim(line), '{X.NAMED}', 1), '')))) AS header FROM raw),
parts AS (SELECT doc_id, pos, line, header, count(header) OVER w AS part, coalesce(last_value(header IGNORE NULLS) OVER w, 'header') AS section FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sl AS (SELECT doc_id, section, part, pos, line FROM parts WHERE header IS NULL)"""


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


@C.add("ctx_sections", f"{LINES}, b AS (SELECT doc_id, section, part, string_agg(line, chr(10) ORDER BY pos) AS body FROM sl GROUP BY 1, 2, 3) SELECT doc_id, section, arg_max(body, part) AS body FROM b GROUP BY 1, 2")
def _(s, d):
    return X.sections(docs(s, d), "doc_id")


def last_sql(names: tuple[str, str]) -> str:
    a, b = names
    return f"ls AS (SELECT doc_id, pos, line FROM (SELECT *, max((section = '{a}', part)) OVER (PARTITION BY doc_id) AS best, (section = '{a}', part) AS o FROM sl WHERE section IN ('{a}', '{b}')) WHERE o = best)"


_LS = f"{LINES}, {last_sql(('entity', 'entities'))}"
_JL = "jl AS (SELECT doc_id, pos, j FROM (SELECT doc_id, pos, regexp_replace(trim(line), '^`+', '') AS j FROM ls) WHERE starts_with(j, '{') AND json_valid(j))"
_PL = """pl AS (SELECT doc_id, pos, list_transform(string_split(regexp_replace(trim(line), '^\\(|\\)$', '', 'g'), '<|>'), lambda p: regexp_replace(trim(p), '^"+|"+$', '', 'g')) AS p FROM ls WHERE starts_with(trim(line), '('))"""


@C.add("ctx_jsonlines", f"{_LS}, {_JL} SELECT doc_id, pos, json_extract_string(j, '$.entity') AS entity FROM jl")
def _(s, d):
    j = X.json_lines(X.last_section_lines(docs(s, d), "doc_id", ("entity", "entities")))
    return j.select("doc_id", "pos", F.get_json_object("json", "$.entity").alias("entity"))


@C.add("ctx_pipe", f"{_LS}, {_PL} SELECT doc_id, pos, len(p) AS n_parts, p[1] AS kind, p[2] AS name FROM pl")
def _(s, d):
    p = X.pipe_lines(X.last_section_lines(docs(s, d), "doc_id", ("entity", "entities")))
    return p.select("doc_id", "pos", F.size("parts").cast("long").alias("n_parts"), F.get("parts", F.lit(0)).alias("kind"), F.get("parts", F.lit(1)).alias("name"))


@C.add("ctx_parse", f"""{_LS}, {_JL}, {_PL}, g AS (SELECT * FROM (SELECT *, first_value(json_extract_string(j, '$.entity') IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY pos) AS ok FROM jl) WHERE ok)
 SELECT doc_id, pos, coalesce(json_extract_string(j, '$.entity'), '') AS name, coalesce(json_extract_string(j, '$.type'), '') AS type, coalesce(json_extract_string(j, '$.description'), '') AS description, coalesce(TRY_CAST(json_extract_string(j, '$.rank') AS DOUBLE), 0.0e0) AS rank FROM g
 UNION ALL SELECT doc_id, pos, coalesce(p[1 + o], ''), coalesce(p[2 + o], ''), coalesce(p[3 + o], ''), coalesce(TRY_CAST(p[4 + o] AS DOUBLE), 0.0e0) FROM (SELECT *, CASE WHEN lower(p[1]) = 'entity' THEN 1 ELSE 0 END AS o FROM pl) WHERE doc_id NOT IN (SELECT doc_id FROM g)""")
def _(s, d):
    return X.parse_entities(docs(s, d), "doc_id")


def placed(parsed: DataFrame, key: str) -> DataFrame:
    """Parsed lines numbered from 0 instead of by their line."""
    from pyspark.sql import Window

    return parsed.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)


@C.add("ctx_relations", f"{R.with_views('rel')}, f AS (SELECT exp_id FROM rel WHERE pos = 0 AND coalesce(src, '') <> '') SELECT exp_id, pos, coalesce(src, '') AS src, coalesce(tgt, '') AS tgt, coalesce(description, '') AS description FROM rel WHERE exp_id IN (SELECT exp_id FROM f)")
def _(s, d):
    """The relations of each record's rendered context, parsed again. A section whose first line names no source gives none."""
    return placed(X.parse_relations(rendered(s, d), "exp_id", "context"), "exp_id").select("exp_id", "pos", "src", "tgt", "description")


@C.add("ctx_entities", f"{R.with_views('ent')} SELECT exp_id, pos, coalesce(name, '') AS name, coalesce(type, '') AS type, coalesce(description, '') AS description FROM ent")
def _(s, d):
    """The entities of each record's rendered context, parsed again."""
    return placed(X.parse_entities(rendered(s, d), "exp_id", "context"), "exp_id").select("exp_id", "pos", "name", "type", "description")


@C.add("ctx_document_relations")
def _(s, d):
    """Relations in the texts of the documents, of which few or none may have such a section."""
    return X.parse_relations(docs(s, d), "doc_id")


@C.add("ctx_chunks", f"{LINES} SELECT doc_id, count(*) AS n FROM sl WHERE section = 'header' AND trim(line) <> '' GROUP BY 1")
def _(s, d):
    """Text lines outside of the graph sections."""
    return X.section_lines(docs(s, d), "doc_id").where("section = 'header' AND trim(line) <> ''").groupBy("doc_id").agg(F.count("*").alias("n"))


@C.add("ctx_graph", f"{R.with_views('cgn')} SELECT n.exp_id, n.name, NOT EXISTS (SELECT 1 FROM ent e WHERE e.exp_id = n.exp_id AND e.name = n.name) AS implicit FROM cgn n")
def _(s, d):
    """Nodes of each context graph; those that no entity names are implicit."""
    named = R.ent_view(s, d).select("exp_id", "name").distinct().withColumn("named", F.lit(True))
    return R.cgn_view(s, d).join(named, ["exp_id", "name"], "left").select("exp_id", "name", F.col("named").isNull().alias("implicit"))


@C.add("ctx_subgraph", f"{R.with_views('ent', 'rel')} SELECT exp_id, n_entities, coalesce(n_relations, 0) AS n_relations, names FROM (SELECT exp_id, count(*) AS n_entities, string_agg(coalesce(name, ''), '|' ORDER BY pos) AS names FROM ent GROUP BY 1) LEFT JOIN (SELECT exp_id, count(*) AS n_relations FROM rel GROUP BY 1) USING (exp_id)")
def _(s, d):
    """Exploded entities gathered again, in order."""
    e = R.ent_view(s, d).groupBy("exp_id").agg(F.count("*").alias("n_entities"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("")).alias("name")))), lambda x: x["name"]), "|").alias("names"))
    return e.join(R.rel_view(s, d).groupBy("exp_id").agg(F.count("*").alias("n_relations")), "exp_id", "left").fillna(0, ["n_relations"])


def rendered(s: SparkSession, d: str) -> DataFrame:
    e, r = F.col("original_subgraph.entities"), F.col("original_subgraph.relations")
    return R.exp_view(s, d, X.render(e, r).alias("context"))


@C.add("ctx_render")
def _(s, d):
    """The context text of each record, byte for byte as the answering model gets it."""
    return rendered(s, d)


@C.add("ctx_render_empty")
def _(s, d):
    g = R.exp_view(s, d, F.col("perturbed_subgraph.entities").alias("e"), F.col("perturbed_subgraph.relations").alias("r"))
    return g.select("exp_id", X.render_or_empty(F.col("e"), F.col("r")).alias("context"))


_U = "list_filter(list_transform(string_split(answers.ground_truth, '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> '')"
UNITS = f"{EXP}, un AS (SELECT exp_id, {_U} AS u FROM exp WHERE answers.ground_truth IS NOT NULL)"


def units(s: SparkSession, d: str) -> DataFrame:
    return R.exp_view(s, d, text.sentences_by_dot(F.col("answers.ground_truth")).alias("u")).where("u IS NOT NULL")


@C.add("ctx_render_chunks", f"{UNITS} SELECT exp_id, array_to_string(list_transform(u, lambda x, i: '[' || i || '] ' || x), chr(10) || chr(10)) AS block FROM un")
def _(s, d):
    return units(s, d).select("exp_id", X.render_chunks(F.col("u")).alias("block"))


# ---- Generators


@C.add("gen_loo_span", f"{UNITS}, e AS (SELECT exp_id, u, unnest(u) AS removed, unnest(range(len(u))) AS pos FROM un) SELECT exp_id, CAST(pos AS INT) AS pos, removed, array_to_string(list_filter(u, lambda x, i: i - 1 <> pos), '|') AS rest FROM e")
def loo(s, d):
    return N.leave_one_unit_out(units(s, d), "exp_id", "u").withColumn("rest", F.array_join("rest", "|"))


@C.add("gen_swap", f"{UNITS}, i AS (SELECT exp_id, u, CAST(unnest(range(len(u))) AS INT) AS a FROM un), j AS (SELECT exp_id, u, a, CAST(unnest(range(a + 1, len(u))) AS INT) AS b FROM i) SELECT exp_id, a, b, array_to_string(list_transform(u, lambda x, k: CASE WHEN k - 1 = a THEN u[b + 1] WHEN k - 1 = b THEN u[a + 1] ELSE x END), '|') AS units FROM j")
def _(s, d):
    return N.swaps(units(s, d), "exp_id", "u").withColumn("units", F.array_join("units", "|"))


_OBJ = R.with_views("ent", "rel") + """, obj AS (SELECT exp_id, row_number() OVER (PARTITION BY exp_id ORDER BY k, pos) - 1 AS idx, k FROM (SELECT exp_id, 0 AS k, pos FROM ent UNION ALL SELECT exp_id, 1, pos FROM rel))"""


def objects(s: SparkSession, d: str) -> DataFrame:
    """exp_id, idx, kind: entities and then relations of each record."""
    from pyspark.sql import Window

    both = R.ent_view(s, d).select("exp_id", F.lit(0).alias("kind"), "pos").unionByName(R.rel_view(s, d).select("exp_id", F.lit(1).alias("kind"), "pos"))
    return both.select("exp_id", (F.row_number().over(Window.partitionBy("exp_id").orderBy("kind", "pos")) - 1).alias("idx"), "kind")


@C.add("gen_perm_objects", f"{_OBJ}, p AS (SELECT exp_id, idx, k, unnest([1, 2, 3]) AS perm_id FROM obj) SELECT exp_id, CAST(perm_id AS INT) AS perm_id, CAST(row_number() OVER (PARTITION BY exp_id, perm_id ORDER BY md5(exp_id || '|' || perm_id || '|' || idx || '|0'), idx) - 1 AS INT) AS pos, CAST(idx AS INT) AS idx, k AS kind FROM p")
def _(s, d):
    return N.object_permutations(objects(s, d), "exp_id", "kind", 3)


@C.add("gen_perm_units", f"{UNITS}, o AS (SELECT exp_id, CAST(unnest(range(len(u))) AS INT) AS idx FROM un), p AS (SELECT exp_id, idx, unnest([1, 2]) AS perm_id FROM o), q AS (SELECT exp_id, perm_id, idx, row_number() OVER (PARTITION BY exp_id, perm_id ORDER BY md5(exp_id || '|' || perm_id || '|' || idx || '|1'), idx) - 1 AS pos FROM p), k AS (SELECT exp_id, perm_id, string_agg(idx, ',' ORDER BY pos) AS seq FROM q GROUP BY 1, 2) SELECT exp_id, CAST(min(perm_id) AS INT) AS perm_id, seq FROM k GROUP BY exp_id, seq")
def _(s, d):
    """Distinct random orders of a text's units."""
    o = units(s, d).select("exp_id", F.posexplode("u").alias("idx", "unit"))
    q = N.object_permutations(o, "exp_id", "unit", 2, 1)
    k = q.groupBy("exp_id", "perm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"].cast("string")), ",").alias("seq"))
    return k.groupBy("exp_id", "seq").agg(F.min("perm_id").alias("perm_id"))


@C.add("gen_perm_thirds")
def _(s, d):
    """At most six orders of the thirds of each section, equal results once."""
    e = R.ent_view(s, d).select("exp_id", F.lit("e").alias("section"), F.col("pos").alias("idx"))
    r = R.rel_view(s, d).select("exp_id", F.lit("r").alias("section"), F.col("pos").alias("idx"))
    return N.third_permutations(e.unionByName(r), "exp_id", "section")


@C.add("gen_perm_tau")
def _(s, d):
    """All orders of up to four units of a text, with their rank correlation; swaps for longer texts."""
    return N.tau_permutations(units(s, d), "exp_id", "u", 4).withColumn("perm", F.array_join(F.transform("perm", lambda x: x.cast("string")), ","))


@C.add("gen_combos", f"{PT.GAME}, c AS (SELECT m.qid, m.mask, round(sum(el.score), 6) AS relevance FROM masks m JOIN el ON el.qid = m.qid AND ((m.mask >> el.i) & 1) = 1 GROUP BY 1, 2) SELECT qid, mask, relevance, CAST(row_number() OVER (PARTITION BY qid ORDER BY bit_count(mask), relevance DESC, mask) AS INT) AS place FROM c")
def _(s, d):
    """Coalitions by size, the most relevant of a size first; of many elements those that are drawn."""
    from pyspark.sql import Window

    from flipgraph.operators import attribution as T
    from flipgraph.operators.aggregates import rnd

    e = PT.elements(s, d)
    m = T.coalitions(e, draws=PT.DRAWS).join(e.select("qid", "i", "score"), "qid").where("(shiftright(mask, i) & 1) = 1").groupBy("qid", "mask").agg(rnd(F.sum("score")).alias("relevance"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.bit_count("mask"), F.desc("relevance"), "mask")))


_H = "CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


@C.add("gen_triple_mask", f"""{R.with_views('rel')}, s AS (SELECT exp_id, pos, unnest([1, 2, 3]) AS sample, count(*) OVER (PARTITION BY exp_id) AS n FROM rel), r AS (SELECT *, row_number() OVER (PARTITION BY exp_id, sample ORDER BY md5(exp_id || '|' || sample || '|' || pos || '|0'), pos) AS rn FROM s)
 SELECT exp_id, CAST(sample AS INT) AS sample, pos FROM r WHERE rn > 1 + {_H.format(x="exp_id || '|' || sample || '|0'")} % n""")
def _(s, d):
    return N.triple_masks(R.rel_view(s, d).select("exp_id", "pos"), "exp_id", 3)


_INS = f"""{UNITS}, x AS (SELECT exp_id, u, CAST({_H.format(x="exp_id || '|3'")} % (len(u) + 1) AS INT) AS place FROM un)"""


def noise_units(s: SparkSession, d: str, lines: bool) -> DataFrame:
    """exp_id, u, noise: each record's sentences and a foreign unit, which the record's number picks from the documents."""
    n = docs(s, d).count()
    unit = F.get(F.split("text", "\n"), F.lit(0)) if lines else F.get(text.sentences_by_dot(F.col("text")), F.lit(0))
    pool = docs(s, d).select(F.col("doc_id").alias("pick"), F.coalesce(unit, F.lit("")).alias("noise"))
    return units(s, d).withColumn("pick", F.col("exp_id") % n + 1).join(pool, "pick")


@C.add("gen_noise_text", f"{_INS}, p AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, '.'), lambda z: regexp_replace(z, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda z: z <> '')[1], '') AS noise FROM documents) SELECT exp_id, place AS \"at\", array_to_string(list_concat(list_concat(u[1:place], [noise]), u[place + 1:]), '|') AS noisy FROM x JOIN p ON p.doc_id = x.exp_id % (SELECT count(*) FROM documents) + 1")
def _(s, d):
    return N.insert_unit(noise_units(s, d, False), "exp_id", "u", "noise", 3).select("exp_id", "at", F.array_join("noisy", "|").alias("noisy"))


@C.add("gen_noise_chunks", f"{_INS}, p AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS noise FROM documents) SELECT exp_id, place AS \"at\", array_to_string(list_concat(list_concat(u[1:place], [noise]), u[place + 1:]), '|') AS noisy FROM x JOIN p ON p.doc_id = x.exp_id % (SELECT count(*) FROM documents) + 1")
def _(s, d):
    return N.insert_unit(noise_units(s, d, True), "exp_id", "u", "noise", 3).select("exp_id", "at", F.array_join("noisy", "|").alias("noisy"))


@C.add("gen_pool")
def _(s, d):
    """All strings in the JSON texts of noise edits that are usable as text units, at any depth."""
    ops = R.noise_view(s, d, "noise").select("noise_id", F.explode("noise.ops").alias("o"))
    return N.strings_of_json(ops, "noise_id", "o")


def noise_sql(share: float, seed: int, tag: str = "") -> str:
    """CTE ``noise`` (exp_id, name, anchor) over cgn and kgn, its name and those of its parts ending on ``tag``."""
    return f"""num{tag} AS (SELECT kg_id, name, row_number() OVER (PARTITION BY kg_id ORDER BY name) - 1 AS no, count(*) OVER (PARTITION BY kg_id) AS ks FROM kgn), g{tag} AS (SELECT exp_id, kg_id, count(*) AS n FROM cgn GROUP BY 1, 2),
 dr{tag} AS (SELECT exp_id, kg_id, n, w, t FROM (SELECT exp_id, kg_id, n, w, unnest(range(1, w * 4 + 1)) AS t FROM (SELECT *, CAST(greatest(1, round_even(n * {share}e0, 0)) AS INT) AS w FROM g{tag}))), pk{tag} AS (SELECT d.*, num{tag}.name FROM dr{tag} d JOIN num{tag} ON num{tag}.kg_id = d.kg_id AND num{tag}.no = {_H.format(x=f"exp_id || '|' || t || '|{seed}'")} % num{tag}.ks),
 ok{tag} AS (SELECT exp_id, n, w, name, min(t) AS t FROM pk{tag} WHERE NOT EXISTS (SELECT 1 FROM cgn c WHERE c.exp_id = pk{tag}.exp_id AND c.name = pk{tag}.name) GROUP BY 1, 2, 3, 4), kp{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY t) AS rn FROM ok{tag}) WHERE rn <= w),
 an{tag} AS (SELECT exp_id, name AS anchor, row_number() OVER (PARTITION BY exp_id ORDER BY name) - 1 AS a FROM cgn), noise{tag} AS (SELECT k.exp_id, k.name, a.anchor FROM kp{tag} k JOIN an{tag} a ON a.exp_id = k.exp_id AND a.a = {_H.format(x=f"k.exp_id || '|' || k.name || '|{seed}'")} % k.n)"""


@C.add("g_noise_nodes", f"{R.with_views('cgn', 'kgn')}, {noise_sql(0.2, 0)} SELECT exp_id, name, anchor FROM noise")
def _(s, d):
    return N.noise_nodes(R.cgn_view(s, d), R.kgn_view(s, d), "exp_id", 0.2)


# ---- Span attributions: what an answer keeps of the reference when a unit is left out


@C.add("att_span_removal", f"""{UNITS}, e AS (SELECT exp_id, u, unnest(u) AS removed, unnest(range(len(u))) AS pos FROM un), r AS (SELECT e.exp_id, CAST(pos AS INT) AS pos, list_distinct(regexp_extract_all(lower(array_to_string(list_filter(u, lambda x, i: i - 1 <> pos), ' ')), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(x.answers.original), '[a-z0-9]+')) AS b FROM e JOIN exp x ON x.exp_id = e.exp_id)
 SELECT exp_id, pos, round(1.0e0 - CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0e0 END, 6) AS importance FROM r""")
def span_importance(s, d):
    """1 - token overlap of the original answer with the text that lacks the unit."""
    from flipgraph.operators.aggregates import rnd

    rest = N.leave_one_unit_out(units(s, d), "exp_id", "u").withColumn("rest", F.array_join("rest", " "))
    o = R.exp_view(s, d, F.col("answers.original").alias("o"))
    return rest.join(o, "exp_id").select("exp_id", "pos", rnd(1.0 - text.token_jaccard(F.col("rest"), F.col("o"))).alias("importance"))


@C.add("att_word_impact", C.sql["att_span_removal"].replace("SELECT exp_id, pos, round(1.0e0 -", "SELECT * FROM (SELECT exp_id, pos, round(1.0e0 -") + ") WHERE importance > 0.3")
def _(s, d):
    return span_importance(s, d).where("importance > 0.3")


@C.add("agg_span_summary", f"WITH si AS ({C.sql['att_span_removal']}), m AS (SELECT DISTINCT ON (exp_id) exp_id, mode FROM explanations WHERE exp_id IS NOT NULL) SELECT {PA.DIRECTION_SQL} AS direction, count(DISTINCT exp_id) AS cases, count(*) AS calls, round(avg(importance), 5) AS avg_importance FROM si JOIN m USING (exp_id) GROUP BY 1")
def _(s, d):
    from flipgraph.operators.aggregates import rnd

    j = span_importance(s, d).join(R.exp_view(s, d, "mode"), "exp_id")
    return j.groupBy(PA.direction().alias("direction")).agg(F.count_distinct("exp_id").alias("cases"), F.count("*").alias("calls"), rnd(F.avg("importance"), 5).alias("avg_importance"))


@C.add("topk_explanation", f"WITH si AS ({C.sql['att_span_removal']}) SELECT exp_id, pos, importance FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY importance DESC, pos) AS rn FROM si WHERE importance > 0) WHERE rn <= 2")
def _(s, d):
    """The two most important units of each text."""
    from flipgraph.operators import ranking as W

    return W.ranked(span_importance(s, d).where("importance > 0"), ["exp_id"], F.desc("importance"), "pos").where("rn <= 2").select("exp_id", "pos", "importance")


@C.add("agg_rage_summary", f"WITH si AS ({C.sql['att_span_removal']}), q AS (SELECT exp_id, max(importance) AS top, count(*) AS n FROM si GROUP BY 1) SELECT count(*) AS n, round(100.0e0 * count(*) FILTER (top >= 0.5) / count(*), 6) AS pct_flipped, round(avg(n), 6) AS avg_units FROM q")
def _(s, d):
    from flipgraph.operators.aggregates import count_if, rnd

    q = span_importance(s, d).groupBy("exp_id").agg(F.max("importance").alias("top"), F.count("*").alias("n"))
    return q.agg(F.count("*").alias("n"), rnd(100.0 * count_if(F.col("top") >= 0.5) / F.count("*")).alias("pct_flipped"), rnd(F.avg("n")).alias("avg_units"))


@C.add("att_rage_perm")
def _(s, d):
    """Of the orders of a text's units, the nearest that puts another unit first, and how far each unit moves."""
    from pyspark.sql import Window

    p = N.tau_permutations(units(s, d).where(F.size("u") > 1), "exp_id", "u", 4).where(F.get("perm", F.lit(0)) != 0)
    near = p.withColumn("rn", F.row_number().over(Window.partitionBy("exp_id").orderBy(F.desc("tau"), F.array_join(F.transform("perm", lambda x: x.cast("string")), ",")))).where("rn = 1")
    moved = near.select("exp_id", "perm", F.posexplode("perm").alias("at", "unit"))
    return moved.select("exp_id", "unit", (F.abs(F.col("at") - F.col("unit")) / (F.size("perm") - 1)).alias("importance"))

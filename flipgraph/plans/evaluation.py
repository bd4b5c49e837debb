"""Queries of retrieval, nearest neighbours, evaluators and evaluation pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.functions.vectors import dot
from flipgraph.operators import evaluator as E
from flipgraph.operators import graph as G
from flipgraph.operators import vectors as V
from flipgraph.operators.aggregates import count_if, rnd
from flipgraph.plans import graph as PG
from flipgraph.plans.catalog import Catalog
from flipgraph.session import cut, new_folder
from flipgraph.sources import records as R
from flipgraph.sources import sinks
from flipgraph.sources.tables import table

C = Catalog()
EXP = R.with_views("exp")
K = "exp_id"

# ---- Vectors. Queries are the vectors whose id is divisible by 50, against all rows.


def base(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(s: SparkSession, d: str) -> DataFrame:
    return base(s, d).where("id % 50 = 0").withColumnRenamed("id", "qid")


_SIMS = f"""WITH q AS (SELECT vec_id AS qid, embedding AS a, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.qid, e.vec_id AS id, round({PG.DOT.format(a='q.a', b='e.embedding')}, 6) + 0.0e0 AS sim, q.label = e.label AS same FROM q, embeddings e)"""


def _ranked_sql(where: str, k: int, order: str = "DESC") -> str:
    return f"{_SIMS} SELECT qid, id, sim, rn FROM (SELECT qid, id, sim, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim {order}, id) AS INT) AS rn FROM s WHERE {where}) WHERE rn <= {k}"


@C.add("topk_knn", _ranked_sql("true", 10))
def _(s, d):
    return V.exact_knn(asked(s, d), base(s, d), 10)


@C.add("idx_flat", _ranked_sql("true", 3))
def _(s, d):
    """Exact search, all queries in one block of the flat table."""
    return V.exact_knn(asked(s, d), base(s, d), 3)


def cells(s: SparkSession, d: str):
    b = base(s, d)
    centres, probes = V.fit_index(b)
    return centres, V.index_vectors(b, centres), probes


@C.add("idx_build", "SELECT count(*) AS n, true AS all_indexed FROM embeddings")
def _(s, d):
    """An index over all vectors, written by cell and read again."""
    _c, indexed, _p = cells(s, d)
    at = new_folder(s, "index")
    sinks.write_index(indexed, at)
    return s.read.parquet(at).agg(F.count("*").alias("n"), (F.count("cell") == F.count("*")).alias("all_indexed"))


@C.add("snk_index", "SELECT vec_id AS id FROM embeddings")
def _(s, d):
    _c, indexed, _p = cells(s, d)
    at = new_folder(s, "index")
    sinks.write_index(indexed, at)
    return s.read.parquet(at).select("id")


@C.add("topk_knn_cells", _ranked_sql("true", 10))
def _(s, d):
    """Search through the index with every cell probed, which is exact."""
    centres, indexed, _p = cells(s, d)
    return V.cell_knn(asked(s, d), indexed, centres, 10, len(centres))


@C.add("topk_knn_recall")
def _(s, d):
    """Recall of the index, at the probes that its fit asks for, against the exact search."""
    centres, indexed, probes = cells(s, d)
    got = V.cell_knn(asked(s, d), indexed, centres, 10, probes).select("qid", "id")
    exact = V.exact_knn(asked(s, d), base(s, d), 10).select("qid", "id")
    return exact.join(got.withColumn("hit", F.lit(1)), ["qid", "id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), rnd(F.count("hit") / F.count("*")).alias("recall"))


@C.add("g_similar_node", _ranked_sql("same AND id <> qid", 1))
def _(s, d):
    """The most similar other vector of the same label."""
    return V.exact_knn(asked(s, d), base(s, d), 1, same="label", itself=False)


@C.add("g_distant_node", _ranked_sql("same AND id <> qid", 1, "ASC"))
def _(s, d):
    return V.exact_knn(asked(s, d), base(s, d), 1, same="label", itself=False, largest=False)


@C.add("g_similar_edge", _ranked_sql("id <> qid", 1))
def _(s, d):
    """The most similar other vector of any label."""
    return V.exact_knn(asked(s, d), base(s, d), 1, itself=False)


@C.add("topk_threshold_nn", f"{_SIMS}, b AS (SELECT qid, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM s WHERE id <> qid) WHERE rn = 1) SELECT qid, CASE WHEN sim > 0.3 THEN id END AS id, sim FROM b")
def _(s, d):
    """The nearest other vector, of all rows, if it is near enough."""
    return V.nearest_above(asked(s, d), base(s, d), 0.3)


@C.add("g_validate_entity", f"{R.with_views('ent', 'kgn')} SELECT DISTINCT e.exp_id, e.name, k.name IS NOT NULL AS exact, coalesce(k.node_id, m.node_id) AS node_id FROM ent e LEFT JOIN kgn k ON k.kg_id = e.kg_id AND k.name = e.name LEFT JOIN (SELECT kg_id, lower(name) AS low, min(node_id) AS node_id FROM kgn GROUP BY 1, 2) m ON m.kg_id = e.kg_id AND m.low = lower(e.name) WHERE e.name <> ''")
def _(s, d):
    """The node of an entity: by its exact name, else by the name in small letters."""
    k = R.kgn_view(s, d)
    low = k.groupBy("kg_id", F.lower("name").alias("low")).agg(F.min("node_id").alias("loose"))
    e = R.ent_view(s, d).where("name <> ''").select(K, "kg_id", "name").distinct().withColumn("low", F.lower("name"))
    j = e.join(k.select("kg_id", "name", "node_id"), ["kg_id", "name"], "left").join(low, ["kg_id", "low"], "left")
    return j.select(K, "name", F.col("node_id").isNotNull().alias("exact"), F.coalesce("node_id", "loose").alias("node_id"))


_PRUNE = f"{PG._SIM}, es AS (SELECT c.exp_id, c.src, c.tgt, greatest(coalesce(a.sim, 0.0e0), coalesce(b.sim, 0.0e0)) AS sim FROM cge c LEFT JOIN sims a ON a.exp_id = c.exp_id AND a.name = c.src LEFT JOIN sims b ON b.exp_id = c.exp_id AND b.name = c.tgt), te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY sim DESC, src, tgt) AS rn FROM es) WHERE rn <= 2), tn AS (SELECT exp_id, name FROM (SELECT exp_id, name, row_number() OVER (PARTITION BY exp_id ORDER BY sim DESC, name) AS rn FROM sims) WHERE rn <= 3)"


@C.add("topk_prune", f"{_PRUNE} SELECT exp_id, name FROM tn UNION SELECT exp_id, src FROM te UNION SELECT exp_id, tgt FROM te")
def _(s, d):
    """The three best nodes of each graph and the ends of its two best edges."""
    sims = PG.similarities(s, d)
    e = R.cge_view(s, d).join(sims.select(K, F.col("name").alias("src"), F.col("sim").alias("sa")), [K, "src"], "left").join(sims.select(K, F.col("name").alias("tgt"), F.col("sim").alias("sb")), [K, "tgt"], "left")
    e = e.withColumn("sim", F.greatest(F.coalesce("sa", F.lit(0.0)), F.coalesce("sb", F.lit(0.0))))
    return V.prune_subgraph(sims, e, K, 3, 2)[0]


# ---- Retrieval: questions are the records whose id is divisible by 50, each within its own knowledge graph.
_RET = f"""{R.with_views('exp', 'kgn', 'kge', 'cgn')}, {PG.VEC}, rq AS (SELECT x.exp_id, x.kg_id, e.embedding AS q FROM exp x JOIN embeddings e ON e.vec_id = x.exp_id % {PG.VECTORS} WHERE x.exp_id % 50 = 0),
rl AS (SELECT exp_id, kg_id, name FROM (SELECT rq.exp_id, rq.kg_id, nv.name, row_number() OVER (PARTITION BY rq.exp_id ORDER BY round({PG.DOT.format(a='nv.vec', b='rq.q')}, 6) DESC, nv.name) AS rn FROM rq JOIN nv ON nv.kg_id = rq.kg_id) WHERE rn <= 2)"""


@C.add("ret_subgraph", f"{_RET} SELECT DISTINCT rl.exp_id, e.src, e.tgt FROM rl JOIN kge e ON e.kg_id = rl.kg_id AND (e.src = rl.name OR e.tgt = rl.name)")
def _(s, d):
    """Local retrieval: the two nodes nearest to the question and the edges at them."""
    q = R.exp_view(s, d, "kg_id").where("exp_id % 50 = 0").withColumn("vec_id", F.col(K) % PG.vector_count(s, d)).join(table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("q")), "vec_id")
    n = q.select(K, "kg_id", "q").join(PG.node_vectors(s, d).select("kg_id", "name", "vec"), "kg_id").select(K, "kg_id", "name", rnd(dot(F.col("vec"), F.col("q"))).alias("sim"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy(K).orderBy(F.desc("sim"), "name"))).where("rn <= 2").select(K, "kg_id", "name")
    e = R.kge_view(s, d).select("kg_id", "src", "tgt")
    hit = [top.join(e.withColumn("name", F.col(end)), ["kg_id", "name"]).select(K, "src", "tgt") for end in ("src", "tgt")]
    return G.union_all(hit).distinct()


@C.add("ret_bypass", f"{EXP} SELECT exp_id, '' AS context FROM exp")
def _(s, d):
    return R.exp_view(s, d, F.lit("").alias("context"))


@C.add("ret_chunks", "WITH q AS (SELECT DISTINCT ON (exp_id) exp_id, kg_id, question FROM explanations WHERE exp_id % 50 = 0), t AS (SELECT exp_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS a, kg_id FROM q), x AS (SELECT t.exp_id, d.doc_id, len(list_intersect(a, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')))) AS n FROM t JOIN documents d ON d.kg_id = t.kg_id WHERE d.text IS NOT NULL) SELECT exp_id, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY n DESC, doc_id) AS rn FROM x WHERE n > 0) WHERE rn <= 3")
def _(s, d):
    """The three texts of a question's graph that share most words with it, found through the words they share."""
    tok = lambda c: F.explode(F.array_distinct(text.norm_tokens(F.col(c))))
    q = R.exp_view(s, d, "kg_id", "question").where("exp_id % 50 = 0").select(K, "kg_id", tok("question").alias("w"))
    t = table(s, d, "documents").select("doc_id", "kg_id", tok("text").alias("w"))
    n = q.join(t, ["kg_id", "w"]).groupBy(K, "doc_id").agg(F.count("*").alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy(K).orderBy(F.desc("n"), "doc_id"))).where("rn <= 3").select(K, "doc_id", "n")


# ---- Evaluators: contexts are the descriptions of a record's entities.


def contexts(s: SparkSession, d: str) -> DataFrame:
    lines = F.transform("original_subgraph.entities", lambda x: F.coalesce(x["description"], F.lit("")))
    return R.exp_view(s, d, "question", F.col("answers.original").alias("reference"), F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("context")).select(F.col(K).alias("qid"), F.lit("0").alias("state"), "context", "question", "reference")


_TOKS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
_CTX = f"{R.with_views('exp', 'ent')}, cx AS (SELECT x.exp_id AS qid, any_value(x.question) AS question, any_value(x.answers.original) AS reference, coalesce(string_agg(coalesce(e.description, ''), chr(10) ORDER BY e.pos), '') AS context FROM exp x LEFT JOIN ent e ON e.exp_id = x.exp_id GROUP BY 1), sc AS (SELECT qid, CAST(coalesce(len({_TOKS.format(x='reference')}) > 0 AND len(list_intersect({_TOKS.format(x='reference')}, {_TOKS.format(x='context')})) >= 0.5 * len({_TOKS.format(x='reference')}), false) AS INT) AS score FROM cx)"


@C.add("mdl_judge", f"{_CTX} SELECT qid, score FROM sc")
def _(s, d):
    return E.Lexical().evaluate(contexts(s, d)).select("qid", "score")


@C.add("mdl_generate", f"""{_CTX}, li AS (SELECT qid, question, unnest(string_split(context, chr(10))) AS line, unnest(range(len(string_split(context, chr(10))))) AS pos FROM cx), j AS (SELECT qid, line, pos, CASE WHEN len({_TOKS.format(x='line')}) > 0 AND len({_TOKS.format(x='question')}) > 0 THEN len(list_intersect({_TOKS.format(x='line')}, {_TOKS.format(x='question')})) / len(list_distinct(list_concat({_TOKS.format(x='line')}, {_TOKS.format(x='question')}))) ELSE 0.0e0 END AS o FROM li)
 SELECT qid, arg_min(line, (-o, pos)) AS answer FROM j GROUP BY 1""")
def _(s, d):
    return E.Lexical().evaluate(contexts(s, d)).select("qid", "answer")


@C.add("mdl_judge_safe", f"{EXP} SELECT exp_id, CASE WHEN trim(t) IN ('0', '1') THEN CAST(trim(t) AS INT) ELSE 0 END AS score FROM (SELECT exp_id, CASE exp_id % 3 WHEN 0 THEN ' 1 ' WHEN 1 THEN '0' ELSE answers.original END AS t FROM exp)")
def _(s, d):
    t = F.when(F.col(K) % 3 == 0, F.lit(" 1 ")).when(F.col(K) % 3 == 1, F.lit("0")).otherwise(F.col("answers.original"))
    return R.exp_view(s, d, E.safe_score(t).alias("score"))


@C.add("mdl_replay", f"{EXP} SELECT exp_id AS qid, CASE WHEN exp_id % 4 <> 0 THEN answers.original END AS answer FROM exp")
def _(s, d):
    """Recorded answers, of which one in four is missing."""
    rec = R.exp_view(s, d, F.col("answers.original").alias("answer")).where("exp_id % 4 <> 0").select(F.col(K).alias("qid"), F.lit("0").alias("state"), "answer", F.lit(1).alias("score"))
    return E.Replay(rec).evaluate(contexts(s, d)).select("qid", "answer")


@C.add("mdl_mcq", f"{EXP} SELECT exp_id, CASE exp_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE '' END AS letter FROM exp")
def _(s, d):
    raw = F.when(F.col(K) % 3 == 0, '{"answer": "b"}').when(F.col(K) % 3 == 1, "(C) because").otherwise("?")
    return R.exp_view(s, d, E.choice_letter(raw).alias("letter"))


@C.add("mdl_embed", f"{R.with_views('cgn', 'kgn')}, {PG.VEC} SELECT kg_id, name, len(vec) AS dim FROM nv")
def _(s, d):
    """Embeddings are a table that is joined by name."""
    return PG.node_vectors(s, d).select("kg_id", "name", F.size("vec").cast("long").alias("dim"))


@C.add("mdl_entities", f"{R.with_views('ent')} SELECT exp_id, count(*) AS n FROM (SELECT DISTINCT x.exp_id, e.name FROM exp x JOIN ent e ON e.exp_id = x.exp_id WHERE e.name <> '' AND contains(x.question, e.name)) GROUP BY 1")
def _(s, d):
    """Entities of a question, found by the names of its graph; a model can take this place."""
    e = R.ent_view(s, d).where("name <> ''").select(K, "name").distinct().join(R.exp_view(s, d, "question"), K)
    return e.where(F.contains("question", "name")).groupBy(K).agg(F.count("*").alias("n"))


@C.add("mdl_logprob", f"{EXP} SELECT exp_id, round((ln(least(greatest(answers.similarity, 1e-6), 1.0)) - ln(1e-6)) / greatest(len(regexp_extract_all(lower(answers.original), '[a-z0-9]+')), 1), 6) AS utility FROM exp WHERE answers.similarity IS NOT NULL AND answers.original IS NOT NULL")
def _(s, d):
    """Gain in log probability per token over the empty context; similarity stands in for the probability."""
    r = R.exp_view(s, d, F.col("answers.similarity").alias("p"), F.col("answers.original").alias("o")).where("p IS NOT NULL AND o IS NOT NULL")
    gain = F.ln(F.least(F.greatest("p", F.lit(1e-6)), F.lit(1.0))) - F.ln(F.lit(1e-6))
    return r.select(K, rnd(gain / F.greatest(F.size(text.norm_tokens(F.col("o"))), F.lit(1))).alias("utility"))


# ---- Pipelines


_SUF = f"""{R.with_views('ops', 'ent')}, o AS (SELECT DISTINCT exp_id, node FROM ops WHERE found AND node <> ''), cx AS (SELECT o.exp_id, string_agg(coalesce(e.description, '') || ' ' || e.name, chr(10) ORDER BY e.pos) AS context FROM o JOIN ent e ON e.exp_id = o.exp_id AND e.name = o.node GROUP BY 1),
 r AS (SELECT x.exp_id, x.mode, x.answers.original AS reference, coalesce(cx.context, '') AS context FROM exp x LEFT JOIN cx USING (exp_id) WHERE x.found AND x.mode = 'ft')"""


@C.add("ev_sufficiency", f"{_SUF} SELECT mode, count(*) AS n, CAST(sum(CAST(coalesce(len({_TOKS.format(x='reference')}) > 0 AND len(list_intersect({_TOKS.format(x='reference')}, {_TOKS.format(x='context')})) >= 0.5 * len({_TOKS.format(x='reference')}), false) AS INT)) AS BIGINT) AS sufficient FROM r GROUP BY mode")
def _(s, d):
    """Whether the edited entities alone still support the original answer."""
    o = R.ops_view(s, d).where("found AND node <> ''").select(K, F.col("node").alias("name")).distinct()
    e = R.ent_view(s, d).join(o, [K, "name"]).groupBy(K).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.coalesce("description", F.lit("")), F.lit(" "), "name").alias("t")))), lambda x: x["t"]), "\n").alias("context"))
    r = R.exp_view(s, d, "mode", "found", F.col("answers.original").alias("reference")).where("found AND mode = 'ft'").join(e, K, "left")
    score = E.lexical_score(F.coalesce("context", F.lit("")), F.col("reference"))
    return r.groupBy("mode").agg(F.count("*").alias("n"), F.sum(score).alias("sufficient"))


_NOI = R.with_views("noi")


@C.add("agg_noise_outcome", f"{_NOI} SELECT noise_level, count(*) AS n, count(*) FILTER (NOT noise.noise_robust) AS changed, count(*) FILTER (noise.noise_robust AND found) AS found, count(*) FILTER (noise.noise_robust AND found AND NOT coalesce(noise.noise_in_explanation, false)) AS resistant FROM noi GROUP BY 1")
def _(s, d):
    """Runs whose answer the noise alone changes are passed over; of the others, finds without noise in them."""
    n = R.noise_view(s, d, "noise_level", "found", "noise")
    ok = F.col("noise.noise_robust") & F.col("found")
    return n.groupBy("noise_level").agg(F.count("*").alias("n"), count_if(~F.col("noise.noise_robust")).alias("changed"), count_if(ok).alias("found"), count_if(ok & ~F.coalesce("noise.noise_in_explanation", F.lit(False))).alias("resistant"))


@C.add("ev_noise_compare", f"{_NOI}, w AS (SELECT DISTINCT exp_id, noise_level FROM noi WHERE found AND noise.noise_robust) SELECT n.mode, n.noise_level, count(*) AS n, round(count(*) FILTER (len(n.noise.noise_nodes_in_counterfactual) = 0) / count(*), 6) AS rate FROM noi n JOIN w USING (exp_id, noise_level) GROUP BY 1, 2")
def _(s, d):
    """Resistance rates over the (question, level) pairs that a robust find allows."""
    n = R.noise_view(s, d, "exp_id", "mode", "noise_level", "found", "noise")
    w = n.where("found AND noise.noise_robust").select("exp_id", "noise_level").distinct()
    return n.join(w, ["exp_id", "noise_level"], "left_semi").groupBy("mode", "noise_level").agg(F.count("*").alias("n"), rnd(count_if(F.size("noise.noise_nodes_in_counterfactual") == 0) / F.count("*")).alias("rate"))


# Choice questions: the options are the record's own ground truth and those of the records 101, 202 and 303 ids further
# on, around the end; the right letter follows from the id.
_MED = f"""{R.with_views('ent', 'kgn', 'kge', 'cgn')}, {PG.VEC}, mq AS (SELECT DISTINCT x.exp_id, x.kg_id, e.name FROM exp x JOIN ent e ON e.exp_id = x.exp_id WHERE e.name <> '' AND contains(x.question, e.name)),
me AS (SELECT DISTINCT q.exp_id, q.kg_id, q.name AS src, e.tgt FROM mq q JOIN kge e ON e.kg_id = q.kg_id AND e.src = q.name), mb AS (SELECT exp_id, kg_id, name FROM mq UNION SELECT exp_id, kg_id, tgt FROM me),
ms AS (SELECT b.exp_id, b.name, round({PG.DOT.format(a='nv.vec', b='v.embedding')}, 6) AS sim FROM mb b JOIN nv ON nv.kg_id = b.kg_id AND nv.name = b.name JOIN embeddings v ON v.vec_id = b.exp_id % {PG.VECTORS}),
mes AS (SELECT m.exp_id, m.src, m.tgt, greatest(coalesce(a.sim, 0.0e0), coalesce(b.sim, 0.0e0)) AS sim FROM me m LEFT JOIN ms a ON a.exp_id = m.exp_id AND a.name = m.src LEFT JOIN ms b ON b.exp_id = m.exp_id AND b.name = m.tgt),
te5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY sim DESC, src, tgt) AS rn FROM mes) WHERE rn <= 5), tn5 AS (SELECT exp_id, name FROM (SELECT exp_id, name, row_number() OVER (PARTITION BY exp_id ORDER BY sim DESC, name) AS rn FROM ms) WHERE rn <= 5 UNION SELECT exp_id, src FROM te5 UNION SELECT exp_id, tgt FROM te5),
ds AS (SELECT exp_id, name, string_agg(coalesce(description, ''), ' ' ORDER BY pos) AS txt FROM ent GROUP BY 1, 2), cx5 AS (SELECT t.exp_id, string_agg(t.name || ' ' || coalesce(ds.txt, ''), ' ') AS context, count(*) AS n_nodes FROM tn5 t LEFT JOIN ds ON ds.exp_id = t.exp_id AND ds.name = t.name GROUP BY 1),
op AS (SELECT x.exp_id, j, substr('ABCD', CAST((x.exp_id + j) % 4 AS INT) + 1, 1) AS letter, coalesce(o.answers.ground_truth, '') AS opt FROM (SELECT exp_id, unnest([0, 1, 2, 3]) AS j FROM exp) x LEFT JOIN exp o ON o.exp_id = (x.exp_id + 101 * j) % ((SELECT max(exp_id) FROM exp) + 1)),
sc5 AS (SELECT op.exp_id, letter, CASE WHEN len({_TOKS.format(x='opt')}) > 0 THEN len(list_intersect({_TOKS.format(x='opt')}, {_TOKS.format(x="coalesce(c.context, '')")})) / len({_TOKS.format(x='opt')}) ELSE 0.0e0 END AS share FROM op JOIN cx5 c ON c.exp_id = op.exp_id),
an5 AS (SELECT exp_id, arg_min(letter, (-share, letter)) AS answer FROM sc5 GROUP BY 1)"""


@C.add("ev_medical", f"{_MED} SELECT a.exp_id, c.n_nodes, a.answer, CAST(a.answer = substr('ABCD', CAST(a.exp_id % 4 AS INT) + 1, 1) AS INT) AS score FROM an5 a JOIN cx5 c ON c.exp_id = a.exp_id")
def medical(s, d):
    """Entities of a question, linked to their graph, with their successors; pruned to five nodes and five edges by
    similarity; the letter of the option that the context covers most, and whether it is the right one.

    Questions that name no entity have no context and no row.
    """
    q = cut(R.ent_view(s, d).where("name <> ''").select(K, "kg_id", "name").distinct().join(R.exp_view(s, d, "question"), K).where(F.contains("question", "name")).select(K, "kg_id", "name"), "asked")
    step = cut(q.withColumnRenamed("name", "src").join(R.kge_view(s, d).select("kg_id", "src", "tgt"), ["kg_id", "src"]).select(K, "kg_id", "src", "tgt"), "steps")
    ball = q.unionByName(step.select(K, "kg_id", F.col("tgt").alias("name"))).distinct()
    sims = cut(PG.similarities(s, d, ball), "sims")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    e = step.join(sims.select(K, F.col("name").alias("src"), F.col("sim").alias("sa")), [K, "src"], "left").join(sims.select(K, F.col("name").alias("tgt"), F.col("sim").alias("sb")), [K, "tgt"], "left")
    nodes, _e = V.prune_subgraph(sims, e.withColumn("sim", F.greatest(zero(F.col("sa")), zero(F.col("sb")))), K, 5, 5)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("description", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    described = R.ent_view(s, d).groupBy(K, "name").agg(told.alias("txt"))
    context = nodes.join(described, [K, "name"], "left").groupBy(K).agg(F.array_join(F.collect_list(F.concat_ws(" ", "name", "txt")), " ").alias("context"), F.count("*").alias("n_nodes"))
    truth = cut(R.exp_view(s, d, F.coalesce("answers.ground_truth", F.lit("")).alias("opt")), "truths")
    span = truth.agg(F.coalesce(F.max(K) + 1, F.lit(1))).first()[0]
    each = context.withColumn("j", F.explode(F.array(*map(F.lit, range(4))))).withColumn("from", (F.col(K) + 101 * F.col("j")) % F.lit(span))
    options = each.join(truth.select(F.col(K).alias("from"), "opt"), "from", "left").withColumn("opt", F.coalesce("opt", F.lit("")))
    t, c = F.array_distinct(text.norm_tokens(F.col("opt"))), F.array_distinct(text.norm_tokens(F.col("context")))
    share = F.when(F.size(t) > 0, F.size(F.array_intersect(t, c)) / F.size(t)).otherwise(0.0)
    letter = F.substring(F.lit("ABCD"), ((F.col(K) + F.col("j")) % 4 + 1).cast("int"), F.lit(1))
    best = options.groupBy(K, "n_nodes").agg(F.min_by(letter, F.struct((-share).alias("s"), letter.alias("l"))).alias("answer"))
    right = F.substring(F.lit("ABCD"), (F.col(K) % 4 + 1).cast("int"), F.lit(1))
    return best.select(K, "n_nodes", "answer", (F.col("answer") == right).cast("int").alias("score"))


@C.add("ev_medical_score", f"{_MED} SELECT count(*) AS n, CAST(sum(CAST(answer = substr('ABCD', CAST(exp_id % 4 AS INT) + 1, 1) AS INT)) AS BIGINT) AS n_right, round(avg(CAST(answer = substr('ABCD', CAST(exp_id % 4 AS INT) + 1, 1) AS INT)), 6) AS exact_match FROM an5")
def _(s, d):
    return medical(s, d).agg(F.count("*").alias("n"), F.sum("score").alias("n_right"), rnd(F.avg("score")).alias("exact_match"))

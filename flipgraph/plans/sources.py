"""Queries of the readers and writers: each writes a table to the shared folder in a tool's format and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.operators.aggregates import rnd
from flipgraph.plans import aggregates as PA
from flipgraph.plans.catalog import Catalog
from flipgraph.session import new_folder
from flipgraph.sources import readers as I
from flipgraph.sources import records as R
from flipgraph.sources import sinks as O
from flipgraph.sources.tables import table

C = Catalog()
EXP, NOI = R.with_views("exp"), R.with_views("noi")
_RECORD = ("question", "found", "num_operations", "operations", "cost", "answers", "original_subgraph", "perturbed_subgraph", "llm_calls", "mode", "timings")


@C.add("src_cfe_dir", f"{EXP} SELECT mode, count(*) AS n, count(*) FILTER (found) AS n_found, round(sum(cost), 4) AS cost, CAST(sum(len(operations)) AS BIGINT) AS n_ops FROM exp GROUP BY mode")
def _(s, d):
    """Explanation records as JSON files, read back with the record's schema."""
    at = new_folder(s, "json")
    R.exp_view(s, d, *_RECORD, F.col("recorded_at").alias("timestamp")).drop("exp_id").write.json(at)
    got = I.explanations(s, at, multi_line=False)
    return got.groupBy("mode").agg(F.count("*").alias("n"), F.count(F.when(F.col("found"), 1)).alias("n_found"), F.round(F.sum("cost"), 4).alias("cost"), F.sum(F.size("operations")).alias("n_ops"))


@C.add("src_path_partition", f"{NOI} SELECT noise_level, count(*) AS n FROM noi GROUP BY 1")
def _(s, d):
    """The noise level from the folder names of a run's files."""
    at = new_folder(s, "levels")
    R.noise_view(s, d, "noise_level", "question").withColumn("folder", F.concat(F.lit("noise_level_"), F.col("noise_level"))).drop("noise_level").write.partitionBy("folder").json(at)
    got = s.read.schema("noise_id long, question string").option("recursiveFileLookup", True).json(at).select("noise_id", F.col("_metadata.file_path").alias("file"))
    return I.from_path(got, r"noise_level_(\d+)", "noise_level").groupBy("noise_level").agg(F.count("*").alias("n"))


@C.add("src_qa_csv", f"{EXP}, q AS (SELECT CAST(exp_id AS VARCHAR) AS id, question, nullif(answers.ground_truth, '') AS answer FROM exp WHERE question IS NOT NULL AND trim(question) <> '') SELECT id, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY id) AS rn FROM q) WHERE rn = 1 AND question IN (SELECT question FROM noise_runs)")
def _(s, d):
    at = new_folder(s, "qa")
    rows = R.exp_view(s, d, "question", F.col("answers.ground_truth").alias("answer")).where("trim(question) <> ''")
    rows.select(F.col("exp_id").cast("string").alias("id"), F.col("question").alias("questions"), F.col("answer").alias("answers")).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(at)
    return I.qa_csv(s, at, table(s, d, "noise_runs").select("question"))


_ATT = "att AS (SELECT DISTINCT ON (attr_id) * FROM attributions WHERE exp_id IS NOT NULL)"


@C.add("src_idmap_json", f"WITH {_ATT} SELECT CAST(attr_id AS VARCHAR) AS id, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT attr_id, unnest(map_values(shapley_scores)) AS v FROM att) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1")
def _(s, d):
    at = new_folder(s, "idmap")
    att = R.once(table(s, d, "attributions").where("exp_id IS NOT NULL"), "attr_id", "question", "shapley_scores")
    clean = F.map_filter("shapley_scores", lambda k, v: v.isNotNull() & ~F.isnan(v))
    record = F.create_map(F.col("attr_id").cast("string"), F.struct("question", clean.alias("scores")), F.concat(F.lit("__summary__"), F.col("attr_id")), F.struct(F.lit(None).cast("string").alias("question"), F.lit(None).cast("map<string,double>").alias("scores")))
    att.select(F.to_json(record).alias("value")).write.text(at)
    got = I.id_map_json(s, at, "struct<question:string,scores:map<string,double>>").select("id", F.explode("scores").alias("k", "v"))
    return got.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@C.add("src_facts", f"{EXP}, {PA.FACTS} SELECT CAST(exp_id AS VARCHAR) AS id, unit_pos, unit FROM facts")
def _(s, d):
    """Facts as sentences, as paragraphs or as a gold text, by the record's number."""
    at = new_folder(s, "facts")
    rows = R.exp_view(s, d, "question", text.sentences_by_dot(F.col("answers.ground_truth")).alias("u")).where("size(u) > 0")
    one = (F.col("exp_id") % 3 == 0) & (F.size("u") == 1)
    record = F.struct("question", F.when(one, F.get("u", F.lit(0))).alias("gold_text"), F.when(~one & (F.col("exp_id") % 2 == 0), F.col("u")).alias("supporting_sentences"), F.when(~one & (F.col("exp_id") % 2 == 1), F.transform("u", lambda x: F.struct(x.alias("text")))).alias("supporting_paragraphs"))
    rows.select(F.to_json(F.create_map(F.col("exp_id").cast("string"), record)).alias("value")).write.text(at)
    return I.facts(s, at).select("id", "unit_pos", "unit")


@C.add("src_graphml", f"{R.with_views('kgn', 'kge')} SELECT (SELECT count(*) FROM kgn) AS n_nodes, (SELECT count(*) FROM kge) AS n_edges, (SELECT count(DISTINCT type) FROM kgn WHERE type <> '' AND trim(type) <> '') AS n_types, (SELECT CAST(sum(n) AS BIGINT) FROM kge) AS weight")
def _(s, d):
    """All knowledge graphs as GraphML, read back through the file's own attribute keys."""
    at = new_folder(s, "graphml")
    name = lambda c: F.concat("kg_id", F.lit("/"), c)
    n = R.kgn_view(s, d).select(name("name").alias("id"), F.col("type").alias("entity_type"), F.lit("x").alias("description"))
    e = R.kge_view(s, d).select(name("src").alias("src"), name("tgt").alias("tgt"), F.lit("d").alias("description"), F.lit("k").alias("keywords"), F.col("n").alias("weight"), F.lit("s").alias("source_id"))
    O.write_graphml(n, e, at)
    nodes, edges = I.graphml(s, at)
    a = nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct(F.when(F.trim("entity_type") != "", F.col("entity_type"))).alias("n_types")).withColumn("one", F.lit(1))
    b = edges.agg(F.count("*").alias("n_edges"), F.sum("weight").cast("long").alias("weight")).withColumn("one", F.lit(1))
    return a.join(b, "one").select("n_nodes", "n_edges", "n_types", "weight")


@C.add("src_vecstore", "SELECT CAST(vec_id AS VARCHAR) AS id, 64 AS dim, 1.0e0 AS length FROM embeddings")
def vector_store(s, d):
    """Vectors through the store's encoding: all of length 1 within the precision of half floats."""
    at = new_folder(s, "vectors")
    v = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("V"), "vec_id").alias("name"), F.col("label").cast("string").alias("content"), F.col("embedding").alias("vec"))
    O.write_vector_store(v, at)
    got = I.vector_store(s, at)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return got.select("id", F.size("vec").alias("dim"), F.round(F.sqrt(norm), 3).alias("length"))


@C.add("snk_vecstore", "SELECT count(*) AS n, true AS close FROM embeddings")
def _(s, d):
    """Largest error of the encoding, over all values, stays below that of half floats."""
    at = new_folder(s, "vectors")
    v = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("").alias("content"), F.col("embedding").alias("vec"))
    O.write_vector_store(v, at)
    j = I.vector_store(s, at).select("id", F.col("vec").alias("got")).join(v, "id")
    err = F.aggregate(F.zip_with("got", "vec", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda m, x: F.greatest(m, x))
    return j.agg(F.count("*").alias("n"), (F.max(err) < 1e-2).alias("close"))


@C.add("src_textstore", "SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def _(s, d):
    at = new_folder(s, "texts")
    table(s, d, "documents").select(F.to_json(F.create_map(F.col("doc_id").cast("string"), F.struct(F.col("text").alias("content")))).alias("value")).write.text(at)
    return I.text_store(s, at).select("id", F.length("content").cast("long").alias("n"))


@C.add("src_parquet", "SELECT doc_id, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS passage FROM documents")
def _(s, d):
    at = new_folder(s, "passages")
    table(s, d, "documents").select("doc_id", F.col("text").alias("passage")).write.parquet(at)
    return I.passages(s, at)


@C.add("src_jsonl_multihop", f"{R.with_views('ent')}, f AS (SELECT exp_id, name, arg_min(coalesce(description, ''), pos) AS description, min(pos) AS pos FROM ent WHERE name IS NOT NULL AND pos % 2 = 0 GROUP BY 1, 2) SELECT CAST(exp_id AS VARCHAR) AS id, string_agg(description, ' ||| ' ORDER BY pos) AS paragraphs FROM f GROUP BY 1")
def multihop(s, d):
    """Entities as paragraphs with their names as titles, every second one supporting; equal titles once."""
    at = new_folder(s, "multihop")
    p = F.transform("original_subgraph.entities", lambda x, i: F.struct(x["name"].alias("title"), F.coalesce(x["description"], F.lit("")).alias("text"), ((i % 2 == 0) & x["name"].isNotNull()).alias("is_supporting")))
    R.exp_view(s, d, "question", p.alias("paragraphs")).select(F.col("exp_id").cast("string").alias("id"), "question", F.lit("").alias("answer"), "paragraphs").write.json(at)
    return I.multihop_jsonl(s, at).select("id", "paragraphs").where("paragraphs IS NOT NULL")


@C.add("src_longest", f"{EXP}, p AS (SELECT exp_id, list_filter([trim(coalesce(answers.ground_truth, '')), trim(coalesce(answers.original, '')), trim(coalesce(answers.perturbed, ''))], lambda x: x <> '') AS p FROM exp) SELECT exp_id, coalesce(list_reduce(p, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, ''), '') AS value FROM p")
def _(s, d):
    a = F.concat_ws(" ||| ", *(F.coalesce(F.trim(F.col(f"answers.{c}")), F.lit("")) for c in ("ground_truth", "original", "perturbed")))
    return R.exp_view(s, d, I.longest(a).alias("value"))


@C.add("src_recipes", f"{EXP} SELECT exp_id, concat_ws('. ', regexp_replace(answers.ground_truth, '[\\[\\]\"'']', '', 'g'), regexp_replace(answers.original, '[\\[\\]\"'']', '', 'g')) AS text FROM exp")
def _(s, d):
    rows = R.exp_view(s, d, F.col("answers.ground_truth").alias("a"), F.col("answers.original").alias("b"))
    return I.recipe_texts(rows, "exp_id", ["a", "b"])


_SENTS = "list_filter(list_transform(string_split(coalesce(description, ''), '.'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> '')"


@C.add("src_annotate", f"{R.with_views('ent')}, x AS (SELECT exp_id, pos AS doc, pos % 2 = 1 AS is_gold, CAST(len({_SENTS}) AS INT) AS n FROM ent) SELECT exp_id, doc, is_gold, CAST(coalesce(sum(n) OVER (PARTITION BY exp_id ORDER BY is_gold DESC, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM x")
def _(s, d):
    e = R.ent_view(s, d).select("exp_id", F.col("pos").alias("doc"), text.sentences_by_dot(F.coalesce("description", F.lit(""))).alias("sentences"), (F.col("pos") % 2 == 1).alias("is_gold"))
    return I.annotated(e, "exp_id")


@C.add("src_partition_json", f"{EXP} SELECT CAST(exp_id AS VARCHAR) AS key, question, 'A: yes | B: no' AS options, 'A' AS answer FROM exp WHERE mode = 'ff' AND question IS NOT NULL")
def _(s, d):
    """One branch of nested JSON: here the modes are the branches."""
    at = new_folder(s, "nested")
    q = F.struct("question", F.create_map(F.lit("A"), F.lit("yes"), F.lit("B"), F.lit("no")).alias("options"), F.lit("A").alias("answer"))
    rows = R.exp_view(s, d, "mode", "question").where("mode IS NOT NULL AND question IS NOT NULL")
    one = rows.select(F.create_map("mode", F.create_map(F.col("exp_id").cast("string"), q)).alias("m"))
    one.select(F.to_json("m").alias("value")).repartition(8).write.text(at)
    lines = s.read.text(at)  # one object a line here; whole files are read the same way
    value = "map<string,map<string,struct<question:string,options:map<string,string>,answer:string>>>"
    got = lines.select(F.from_json("value", value).alias("m")).select(F.explode(F.col("m")["ff"]).alias("key", "v"))
    options = F.array_join(F.transform(F.array_sort(F.map_entries("v.options")), lambda o: F.concat(o["key"], F.lit(": "), o["value"])), " | ")
    return got.select("key", "v.question", options.alias("options"), "v.answer")


@C.add("snk_cfe", f"{EXP} SELECT mode, coalesce(nullif(array_to_string(list_sort(list_distinct(list_transform(operations, lambda o: json_extract_string(o, '$[0]')))), '+'), ''), 'none') AS ops_set, count(*) AS n FROM exp GROUP BY 1, 2")
def _(s, d):
    at = new_folder(s, "cfe")
    O.write_explanations(R.exp_view(s, d, "mode", "operations", "cost"), at)
    return s.read.parquet(at).groupBy("mode", "ops_set").agg(F.count("*").alias("n"))


@C.add("snk_noise", f"{NOI} SELECT noise_level, count(*) AS n FROM noi WHERE mode = 'ft' GROUP BY 1")
def _(s, d):
    at = new_folder(s, "noise")
    O.write_noise(R.noise_view(s, d, "mode", "noise_level", "question"), at)
    return s.read.parquet(at).where("mode = 'ft'").groupBy("noise_level").agg(F.count("*").alias("n"))


@C.add("snk_csv_json_summary", f"{EXP} SELECT mode, count(*) AS n FROM exp GROUP BY 1")
def _(s, d):
    a, b = new_folder(s, "csv"), new_folder(s, "json")
    O.write_summary(R.exp_view(s, d, "mode").groupBy("mode").agg(F.count("*").alias("n")), a, b)
    return s.read.schema("mode string, n long").option("header", True).csv(a).intersect(s.read.schema("mode string, n long").json(b).select("mode", "n"))


@C.add("snk_resume", f"{EXP} SELECT exp_id FROM exp WHERE exp_id NOT IN (SELECT exp_id FROM noise_runs WHERE exp_id IS NOT NULL AND found)")
def _(s, d):
    """Records without a noise run that ended well: what a resumed job has left to do."""
    done = table(s, d, "noise_runs").select("exp_id", F.when(~F.col("found"), "no find").alias("error"))
    return O.missing_only(R.exp_view(s, d), done, "exp_id")


@C.add("snk_latex")
def _(s, d):
    """A table of success by mode as LaTeX, one row with the text."""
    rows = R.exp_view(s, d, "mode", "found").groupBy("mode").agg(F.count("*").alias("n"), F.avg(F.col("found").cast("int")).alias("success")).orderBy("mode").limit(100).collect()
    return s.createDataFrame([(O.latex_table(rows, ["mode", "n", "success"], {"success"}),)], "latex string")


@C.add("snk_report")
def _(s, d):
    """The cheapest explanation as text, Markdown and HTML."""
    row = R.exp_view(s, d, "question", "answers", "cost", "operations", "found").where("found").orderBy("cost", "exp_id").first()
    return s.createDataFrame([(k, O.report(row, k)) for k in ("text", "markdown", "html")], "style string, report string")

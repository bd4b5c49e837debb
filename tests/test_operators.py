"""Readers, context texts, generators, ranking and functions on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from flipgraph.functions import text, vectors
from flipgraph.operators import aggregates as A
from flipgraph.operators import context as X
from flipgraph.operators import evaluator as E
from flipgraph.operators import generators as N
from flipgraph.operators import ranking as W
from flipgraph.sources import readers as I
from flipgraph.sources import sinks as O


def test_render_is_json_with_escapes(spark):
    e, r = [{"name": "Ä b", "type": None, "description": 'x "y"'}], [{"src": "Ä b", "tgt": "c", "description": ""}]
    t = X.context_text(e, r)
    assert t.split("\n")[2] == json.dumps({"entity": "Ä b", "type": "", "description": 'x "y"'}) and t.endswith("```\n")
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "plain\ntext")], "doc_id int, text string")
    got = X.parse_entities(df, "doc_id").collect()
    assert [(r.doc_id, r.name, r.type, r.description) for r in got] == [(1, "Ä b", "", 'x "y"')]
    rel = X.parse_relations(df, "doc_id").collect()
    assert [(r.src, r.tgt) for r in rel] == [("Ä b", "c")]


def test_pipe_format_and_repeated_sections(spark):
    t = '-----Entities-----\n("entity"<|>"old")\n-----Entities-----\n("entity"<|>"A"<|>"person"<|>"d"<|>2)##\nnoise\n-----Relationships-----\n("relationship"<|>"A"<|>"B"<|>"k"<|>"d"<|>1.5)'
    df = spark.createDataFrame([(1, t)], "doc_id int, text string")
    e = X.parse_entities(df, "doc_id").collect()
    assert [(r.name, r.type) for r in e] == [("A", "person")]
    r = X.parse_relations(df, "doc_id").collect()
    assert [(x.src, x.tgt, x.keywords, x.weight) for x in r] == [("A", "B", "k", 1.5)]


def test_broken_json_files_are_skipped(spark, tmp_path):
    (tmp_path / "a" / "noise_level_20").mkdir(parents=True)
    (tmp_path / "a" / "noise_level_20" / "x.json").write_text('{"question": "q",\n "found": true, "operations": [["delete_node", "A"], ["delete_edge", ["S", "T"]]]}')
    (tmp_path / "a" / "bad.json").write_text('{"question": ')
    rows = I.from_path(I.explanations(spark, str(tmp_path)), r"noise_level_(\d+)", "level").collect()
    assert [(r.question, r.level) for r in rows] == [("q", 20)] and json.loads(rows[0].operations[1]) == ["delete_edge", ["S", "T"]]


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "n", "c", [0.6, 0.8]), ("2", "z", "c", [0.0, 0.0])], "id string, name string, content string, vec array<float>")
    O.write_vector_store(df, str(tmp_path / "v"))
    got = {r.id: r.vec for r in I.vector_store(spark, str(tmp_path / "v")).collect()}
    assert got["1"] == pytest.approx([0.6, 0.8], abs=1e-3) and got["2"] == [0.0, 0.0]


def test_facts_precedence_and_partitions(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"1": {"question": "q", "supporting_sentences": ["a"], "gold_text": "g"}, "2": {"question": "q", "supporting_sentences": [], "supporting_paragraphs": [{"text": "p"}]}, "3": {"question": "q", "gold_text": "g"}, "__summary__": {}}))
    assert {(r.id, r.unit) for r in I.facts(spark, str(tmp_path / "f.json")).collect()} == {("1", "a"), ("2", "p"), ("3", "g")}
    (tmp_path / "m.json").write_text(json.dumps({"mmlu": {"bio-1": {"question": "q", "options": {"B": "y", "A": "x"}, "answer": "A"}, "law-1": {"question": "r"}}, "med": {}}, indent=1))
    got = I.partition_json(spark, str(tmp_path / "m.json"), "mmlu_bio").collect()
    assert [(r.key, r.options) for r in got] == [("bio-1", "A: x | B: y")]


def test_reports(spark):
    row = spark.createDataFrame([("q<", ("g", "o", "p", 0.1), 1.0, ["[]"])], "question string, answers struct<ground_truth:string,original:string,perturbed:string,similarity:double>, cost double, operations array<string>").first()
    assert "q&lt;" in O.report(row, "html") and O.report(row, "markdown").startswith("**Question**")
    t = O.latex_table(spark.createDataFrame([("a", None), ("b", 0.256)], "m string, p double").collect(), ["m", "p"], {"p"})
    assert "a & --" in t and "b & 25.6" in t


def test_permutations(spark):
    items = spark.createDataFrame([(1, "e", i) for i in range(4)] + [(2, "e", 0)], "id long, section string, idx int")
    p = N.third_permutations(items, "id", "section")
    assert p.where("id = 1").select("perm_id").distinct().count() == 6 and p.where("id = 2").select("perm_id").distinct().count() == 1
    assert [r.idx for r in p.where("id = 1 AND perm_id = '0_1_2'").orderBy("pos").collect()] == [0, 1, 2, 3]
    o = N.object_permutations(spark.createDataFrame([(1, i, "x") for i in range(6)], "id long, idx int, item string"), "id", "item", 4)
    for k in range(1, 5):
        assert sorted(r.idx for r in o.where(f"perm_id = {k}").collect()) == list(range(6))


def test_sample_is_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = ({r.k for r in N.sampled_percent(df, "k", 30, seed).collect()} for seed in (1, 1))
    assert len(a) == 300 and a == b != {r.k for r in N.sampled_percent(df, "k", 30, 2).collect()}


def test_ranks_and_metrics(spark):
    a = spark.createDataFrame([(1, x, float(s)) for x, s in zip("abcd", (4, 3, 2, 1), strict=True)], "qid int, element_id string, score double")
    b = spark.createDataFrame([(1, x, float(s)) for x, s in zip("abcd", (1, 2, 3, 4), strict=True)], "qid int, element_id string, score double")
    ra, rb = W.ranked(a, ["qid"]), W.ranked(b, ["qid"])
    assert W.kendall(ra, ra, ["qid"]).first().tau == 1 and W.kendall(ra, rb, ["qid"]).first().tau == -1
    g = a.withColumn("is_gold", F.col("element_id").isin("a", "c"))
    assert W.average_precision(g, ["qid"]).first().ap == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert A.precision_at_k(g, (1, 3, 5), "qid").where("k = 5").first().n == 4
    flat = spark.createDataFrame([(1, "a", 0.0, True), (1, "b", -1.0, False)], "qid int, element_id string, score double, is_gold boolean")
    r = A.precision_at_k(flat, (1,), "qid").first()
    assert (r.n, r.precision, r.hit) == (0, None, 0)


def test_functions(spark):
    r = spark.createDataFrame([("Zürich, the 2nd!", "ZÜRICH", None, [1.0, 0.0], [0.0, 0.0])], "a string, b string, c string, v array<double>, z array<double>")
    x = r.select(text.norm(F.col("a")), text.norm_contains(F.col("a"), F.col("c")), text.token_jaccard(F.col("a"), F.col("c")), vectors.cosine(F.col("v"), F.col("z")), text.escape_html(F.lit("<a&'\">")), text.norm(F.col("c"))).first()
    assert list(x) == ["z rich the 2nd", False, 0.0, 0.0, "&lt;a&amp;&#x27;&quot;&gt;", None]


def test_evaluators_ask_once(spark):
    rows = spark.createDataFrame([(1, "s", "the cat\nsat here", "where sat it", "cat sat"), (1, "s", "the cat\nsat here", "where sat it", "cat sat"), (2, "t", "", "q", None)], "qid long, state string, context string, question string, reference string")
    got = {r.qid: (r.answer, r.score) for r in E.Lexical().evaluate(rows).collect()}
    assert got == {1: ("sat here", 1), 2: ("", 0)}
    calls = spark.sparkContext.accumulator(0)

    def ask(contexts, questions, references):
        calls.add(len(contexts))
        return ["x"] * len(contexts), [1] * len(contexts)

    cache = spark.createDataFrame([(1, "s", "known", 0)], "qid long, state string, answer string, score int")
    out = {r.qid: r.answer for r in E.Callable_(ask).evaluate(rows, cache).collect()}
    assert out == {1: "known", 2: "x"} and calls.value == 1

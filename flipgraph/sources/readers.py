"""Readers of the file formats that explanation tools leave behind. All take explicit schemas; nothing is inferred."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

SUBGRAPH = "struct<entities:array<struct<name:string,type:string,description:string,rank:double>>,relations:array<struct<src:string,tgt:string,keywords:string,description:string,weight:double>>>"
EXPLANATION = (
    "question string, found boolean, num_operations int, operations array<string>, cost double, answers struct<ground_truth:string,original:string,perturbed:string,similarity:double>, "
    f"original_subgraph {SUBGRAPH}, perturbed_subgraph {SUBGRAPH}, timestamp string, llm_calls int, mode string, "
    "timings struct<setup_seconds:double,total_seconds:double,retrieval_seconds:double,index_seconds:double,algorithm_seconds:double,llm_seconds:double>"
)


def explanations(spark: SparkSession, path: str, schema: str = EXPLANATION, multi_line: bool = True) -> DataFrame:
    """JSON records below ``path``, one per file (or per line), with the file's address; broken ones are dropped.

    Edits of mixed shape arrive as JSON texts in ``operations``.
    """
    reader = spark.read.schema(f"{schema}, _broken string").option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    rows = reader.option("multiLine", multi_line).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.where("_broken IS NULL").drop("_broken")


def from_path(df: DataFrame, pattern: str, name: str, file: str = "file", kind: str = "int") -> DataFrame:
    """A column cut out of the file's address, such as the level in noise_level_20."""
    return df.withColumn(name, F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")).cast(kind))


def qa_csv(spark: SparkSession, path: str, questions: DataFrame | None = None) -> DataFrame:
    """(id, question, answer) of a CSV with a header; of equal questions the lowest id. Optionally those of a set."""
    rows = spark.read.schema("id string, questions string, answers string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    w = Window.partitionBy("questions").orderBy("id")
    first = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", F.col("questions").alias("question"), F.col("answers").alias("answer"))
    return first if questions is None else first.join(questions.select("question").distinct(), "question", "left_semi")


def id_map_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(id, value.*) of lines with objects of records by id; keys that start with __ are summaries and left out."""
    rows = spark.read.text(path).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return rows.select(F.explode("m").alias("id", "v")).where(~F.startswith("id", F.lit("__"))).select("id", "v.*")


def facts(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, unit_pos, unit): supporting sentences, else paragraphs, else the gold text of each question."""
    value = "struct<question:string,gold_text:string,supporting_sentences:array<string>,supporting_paragraphs:array<struct<text:string>>>"
    rows = id_map_json(spark, path, value)
    some = lambda c: F.when(F.size(c) > 0, c)
    units = F.coalesce(some(F.col("supporting_sentences")), some(F.col("supporting_paragraphs.text")), F.when(F.col("gold_text") != "", F.array("gold_text")))
    return rows.select("id", "question", F.posexplode(units).alias("unit_pos", "unit"))


def partition_json(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """(key, question, options, answer) of one branch of a nested JSON; mmlu_<subject> takes mmlu's keys of that prefix."""
    name, _, prefix = partition.partition("_") if partition.startswith("mmlu_") else (partition, "", "")
    value = "map<string,map<string,struct<question:string,options:map<string,string>,answer:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", value).alias("m"))
    rows = rows.select(F.explode(F.col("m")[name]).alias("key", "v"))
    rows = rows.where(F.startswith("key", F.lit(prefix))) if prefix else rows
    text = F.array_join(F.transform(F.array_sort(F.map_entries("v.options")), lambda o: F.concat(o["key"], F.lit(": "), o["value"])), " | ")
    return rows.select("key", "v.question", text.alias("options"), "v.answer")


def multihop_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer, paragraphs): supporting paragraphs joined by |||, equal titles once, in order."""
    schema = "id string, question string, answer string, paragraphs array<struct<title:string,text:string,is_supporting:boolean>>"
    rows = spark.read.schema(schema).json(path)
    kept = F.filter("paragraphs", lambda p: p["is_supporting"])
    titles = F.array_distinct(F.transform(kept, lambda p: p["title"]))
    once = F.transform(titles, lambda t: F.get(F.filter(kept, lambda p: p["title"] == t), F.lit(0))["text"])
    return rows.select("id", "question", "answer", F.array_join(once, " ||| ").alias("paragraphs"))


def longest(text: Column, delimiter: str = r"\|\|\|") -> Column:
    """The longest part of a delimited text, the first of equals; empty parts do not count."""
    parts = F.filter(F.transform(F.split(text, delimiter), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(texts: pd.Series) -> pd.Series:
    """base64(zlib(float16 values)) as floats; null for null."""
    return texts.map(lambda t: None if t is None else np.frombuffer(zlib.decompress(base64.b64decode(t)), np.float16).astype(np.float32))


@F.pandas_udf(StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else base64.b64encode(zlib.compress(np.asarray(v, np.float16).tobytes())).decode())


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, content, vec) of lines with encoded vectors; a relation's name is src->tgt. Vectors have length 1."""
    rows = spark.read.schema("__id__ string, entity_name string, src_id string, tgt_id string, content string, vector string").json(path)
    name = F.coalesce("entity_name", F.concat("src_id", F.lit("->"), "tgt_id"))
    v = rows.select(F.col("__id__").alias("id"), name.alias("name"), "content", decode_vector("vector").alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.withColumn("norm", F.greatest(norm, F.lit(1e-10))).select("id", "name", "content", F.transform("raw", lambda x: (x / F.col("norm")).cast("float")).alias("vec"))


def text_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, content) of lines with objects of chunks by id; empty contents are left out."""
    return id_map_json(spark, path, "struct<content:string>").where("trim(content) <> ''")


def passages(spark: SparkSession, path: str, text: str = "passage") -> DataFrame:
    """A Parquet table of passages with line breaks as blanks."""
    return spark.read.parquet(path).withColumn(text, F.trim(F.regexp_replace(text, r"[\r\n]+", " ")))


def recipe_texts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, text): list columns without brackets and quotes, joined into one text; nulls are passed over."""
    clean = [F.regexp_replace(F.col(c), r"[\[\]\"']", "") for c in columns]
    return rows.select(key, F.concat_ws(". ", *clean).alias("text"))


def annotated(rows: DataFrame, key: str) -> DataFrame:
    """rows: (key, doc, sentences array, is_gold). (key, doc, is_gold, first, n): gold documents first, then by number;
    ``first`` is the running number of the document's first sentence."""
    w = Window.partitionBy(key).orderBy(F.desc("is_gold"), "doc")
    before = F.coalesce(F.sum(F.size("sentences")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(key, "doc", "is_gold", before.alias("first"), F.size("sentences").alias("n"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, entity_type, description) and edges (src, tgt, description, keywords, weight, source_id) of GraphML.

    Attribute keys d0, d1, ... are resolved by the file's own <key> declarations.
    """
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    names = {(r[2], r[0]): r[1] for r in keys.distinct().limit(1000).collect()}
    data = "data array<struct<_key:string,_VALUE:string>>"

    def attr(kind: str, name: str) -> Column:
        ids = [i for (k, i), n in names.items() if n == name and k in (kind, "all")] or [name]
        return F.get(F.filter("data", lambda x: x["_key"].isin(*ids)), F.lit(0))["_VALUE"].alias(name)

    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    e = edges.select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), *(attr("edge", a) for a in ("description", "keywords", "weight", "source_id")))
    return nodes.select(F.col("_id").alias("id"), attr("node", "entity_type"), attr("node", "description")), e.withColumn("weight", F.col("weight").cast("double"))

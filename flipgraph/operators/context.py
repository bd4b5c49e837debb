"""Parsing and rendering of the context texts that a graph-based retriever hands to the answering model."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The two header styles of a section (fixed patterns): dashes around a name, or the name in brackets.
DASHED = r"^-{3,}\s*([\p{L}\p{N}_][\p{L}\p{N}_\s]*[\p{L}\p{N}_]|[\p{L}\p{N}_])\s*-{3,}$"
NAMED = r"(?i)^Knowledge Graph Data\s*\(([\p{L}\p{N}_]+)\)\s*:"


def lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line, header): header is the section's name where the line opens one."""
    each = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    bare = F.trim("line")
    name = F.coalesce(F.nullif(F.regexp_extract(bare, DASHED, 1), F.lit("")), F.nullif(F.regexp_extract(bare, NAMED, 1), F.lit("")))
    return each.withColumn("header", F.lower(F.trim(name)))


def section_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, part, pos, line): the lines of each section; those before the first are in ``header``.

    ``part`` counts the headers so far, so that a repeated section is told from the earlier one.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(texts, key, text).withColumn("part", F.count("header").over(w)).withColumn("section", F.coalesce(F.last("header", True).over(w), F.lit("header")))
    return rows.where("header IS NULL").select(key, "section", "part", "pos", "line")


def sections(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, body): the last section of each name. A section without lines has no row."""
    rows = section_lines(texts, key, text)
    bodies = rows.groupBy(key, "section", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return bodies.groupBy(key, "section").agg(F.max_by("body", "part").alias("body"))


def last_section_lines(texts: DataFrame, key: str, names: tuple[str, ...], text: str = "text") -> DataFrame:
    """(key, pos, line) of the last section whose name is the first of ``names`` that the text has."""
    rows = section_lines(texts, key, text).where(F.col("section").isin(*names))
    order = F.struct(*(F.col("section") == n for n in names), F.col("part"))
    top = rows.withColumn("o", order).withColumn("best", F.max("o").over(Window.partitionBy(key)))
    return top.where("o = best").select(key, "pos", "line")


def json_lines(rows: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, without leading back-ticks; others are dropped."""
    j = rows.withColumn("json", F.regexp_replace(F.trim("line"), "^`+", ""))
    return j.where(F.startswith("json", F.lit("{")) & F.try_parse_json("json").isNotNull()).drop("line")


def pipe_lines(rows: DataFrame) -> DataFrame:
    """Lines in brackets, cut at <|>, without blanks and quotes around the parts: column ``parts``."""
    bare = F.trim("line")
    inner = F.regexp_replace(bare, r"^\(|\)$", "")
    parts = F.transform(F.split(inner, r"<\|>"), lambda p: F.regexp_replace(F.trim(p), '^"+|"+$', ""))
    return rows.where(F.startswith(bare, F.lit("("))).withColumn("parts", parts).drop("line")


def parse_entities(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, name, type, description, rank). JSON lines if the section's first JSON line has an entity, else tuples."""
    rows = last_section_lines(texts, key, ("entity", "entities"), text)
    j = json_lines(rows)
    get = lambda f: F.coalesce(F.get_json_object("json", f"$.{f}"), F.lit(""))
    first = F.first(F.get_json_object("json", "$.entity").isNotNull()).over(Window.partitionBy(key).orderBy("pos"))
    good = j.withColumn("as_json", first).where("as_json")
    from_json = good.select(key, "pos", get("entity").alias("name"), get("type").alias("type"), get("description").alias("description"), F.coalesce(F.get_json_object("json", "$.rank").try_cast("double"), F.lit(0.0)).alias("rank"))
    p = pipe_lines(rows).join(good.select(key).distinct(), key, "left_anti")
    at = F.when(F.lower(F.get("parts", F.lit(0))) == "entity", 1).otherwise(0)
    part = lambda k: F.coalesce(F.get("parts", at + k), F.lit(""))
    from_pipe = p.select(key, "pos", part(0).alias("name"), part(1).alias("type"), part(2).alias("description"), F.coalesce(part(3).try_cast("double"), F.lit(0.0)).alias("rank"))
    return from_json.unionByName(from_pipe)


def parse_relations(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, src, tgt, keywords, description, weight), from JSON lines or tuples."""
    rows = last_section_lines(texts, key, ("relationship", "relationships"), text)
    j = json_lines(rows)
    get = lambda *fs: F.coalesce(*(F.get_json_object("json", f"$.{f}") for f in fs), F.lit(""))
    first = F.first((get("entity1", "src_id") != "")).over(Window.partitionBy(key).orderBy("pos"))
    good = j.withColumn("as_json", first).where("as_json")
    from_json = good.select(key, "pos", get("entity1", "src_id").alias("src"), get("entity2", "tgt_id").alias("tgt"), get("keywords").alias("keywords"), get("description").alias("description"), F.coalesce(F.get_json_object("json", "$.weight").try_cast("double"), F.lit(0.0)).alias("weight"))
    p = pipe_lines(rows).join(good.select(key).distinct(), key, "left_anti")
    at = F.when(F.lower(F.get("parts", F.lit(0))) == "relationship", 1).otherwise(0)
    part = lambda k: F.coalesce(F.get("parts", at + k), F.lit(""))
    from_pipe = p.select(key, "pos", part(0).alias("src"), part(1).alias("tgt"), part(2).alias("keywords"), part(3).alias("description"), F.coalesce(part(4).try_cast("double"), F.lit(0.0)).alias("weight"))
    return from_json.unionByName(from_pipe)


def context_text(entities: Iterable[dict], relations: Iterable[dict]) -> str:
    """The text of a context: two sections of fenced JSON lines, ASCII with escapes, in the given order."""
    def block(title: str, rows: list[dict]) -> list[str]:
        return [f"Knowledge Graph Data ({title}):", "```json", *map(json.dumps, rows), "```", ""]

    e = [{"entity": x["name"] or "", "type": x["type"] or "", "description": x["description"] or ""} for x in entities]
    r = [{"entity1": x["src"] or "", "entity2": x["tgt"] or "", "description": x["description"] or ""} for x in relations]
    return "\n".join(block("Entity", e) + block("Relationship", r))


@F.pandas_udf(StringType())
def render(entities: pd.Series, relations: pd.Series) -> pd.Series:
    return pd.Series([context_text(e if e is not None else (), r if r is not None else ()) for e, r in zip(entities, relations, strict=True)])


def render_or_empty(entities: Column, relations: Column) -> Column:
    """As ``render``, but an empty text for a graph without entities."""
    return F.when(F.coalesce(F.size(entities), F.lit(0)) <= 0, F.lit("")).otherwise(render(entities, relations))


def render_chunks(chunks: Column) -> Column:
    """Chunks under numbers from 1, blank lines between them."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")

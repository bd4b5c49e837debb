"""Writers of explanations, noise runs, vectors and reports. Tables are keyed and partitioned, so no record overwrites another."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.sources.readers import encode_vector


def write_explanations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by mode and by the set of edit kinds, whatever their order."""
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("operations", lambda o: F.get_json_object(o, "$[0]")))), "+")
    df.withColumn("ops_set", F.when(kinds == "", "none").otherwise(kinds)).write.mode(mode).partitionBy("mode", "ops_set").parquet(path)


def write_noise(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("mode", "noise_level").parquet(path)


def write_vector_store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """df: (id, name, content, vec). JSON lines with vectors as base64(zlib(float16))."""
    df.select(F.col("id").alias("__id__"), F.col("name").alias("entity_name"), "content", encode_vector("vec").alias("vector")).write.mode(mode).json(path)


def write_index(df: DataFrame, path: str, cell: str = "cell", mode: str = "overwrite") -> None:
    """Vectors partitioned by their cell, so that a search reads the cells it probes."""
    df.write.mode(mode).partitionBy(cell).parquet(path)


def write_summary(df: DataFrame, csv: str, json: str) -> None:
    """A small result as CSV with a header and as JSON lines."""
    one = df.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(csv)
    one.write.mode("overwrite").json(json)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes: (id, entity_type, description); edges: (src, tgt, description, keywords, weight, source_id). One element a line."""
    def data(key: str, column: str):
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f'<data key="{key}">'), text.escape_html(F.col(column).cast("string")), F.lit("</data>"))).otherwise("")

    keys = [("n0", "node", "entity_type"), ("n1", "node", "description"), ("e0", "edge", "description"), ("e1", "edge", "keywords"), ("e2", "edge", "weight"), ("e3", "edge", "source_id")]
    quoted = lambda c: text.escape_html(F.col(c))
    n = nodes.select(F.concat(F.lit('<node id="'), quoted("id"), F.lit('">'), data("n0", "entity_type"), data("n1", "description"), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), quoted("src"), F.lit('" target="'), quoted("tgt"), F.lit('">'), *(data(k, c) for k, _, c in keys[2:]), F.lit("</edge>")).alias("value"))

    def document(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<graphml>", *(f'<key id="{i}" for="{k}" attr.name="{n}" attr.type="string"/>' for i, k, n in keys), '<graph edgedefault="directed">']})
        yield from frames
        yield pd.DataFrame({"value": ["</graph></graphml>"]})

    n.unionByName(e).mapInPandas(document, "value string").write.mode("overwrite").text(path)  # each file is a document


def missing_only(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be done: rows whose key the output does not hold without an error."""
    good = done.where("error IS NULL") if "error" in done.columns else done
    return todo.join(good.select(key).distinct(), key, "left_anti")


def latex_table(rows: list[Row], columns: list[str], percent: set[str]) -> str:
    """A small result as a LaTeX table: -- for null, percentages with one decimal."""
    def cell(r: Row, c: str) -> str:
        v = r[c]
        return "--" if v is None else f"{100 * v:.1f}" if c in percent else str(v)

    body = " \\\\\n".join(" & ".join(cell(r, c) for c in columns) for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(columns)}}}\n{' & '.join(columns)} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}"


def report(row: Row, style: str = "text") -> str:
    """One explanation as text, Markdown or HTML: question, answers, edits and cost."""
    lines = [("Question", row["question"]), ("Original answer", row["answers"]["original"]), ("Changed answer", row["answers"]["perturbed"]), ("Cost", row["cost"])]
    ops = list(row["operations"] or [])
    if style == "html":
        items = "".join(f"<li>{html.escape(o)}</li>" for o in ops)
        return "<html><body>" + "".join(f"<p><b>{k}</b>: {html.escape(str(v))}</p>" for k, v in lines) + f"<ul>{items}</ul></body></html>"
    if style == "markdown":
        return "\n".join([*(f"**{k}**: {v}" for k, v in lines), *(f"- {o}" for o in ops)])
    return "\n".join([*(f"{k}: {v}" for k, v in lines), *(f"  {o}" for o in ops)])

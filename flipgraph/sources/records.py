"""Typed views of the explanation, noise, graph and score tables.

Each ``*_view`` takes a session and a scale directory and gives the columns that operators use; the dict CTE
has the same views as common table expressions for the SQL twins. One record counts once, however often it was
delivered; a record without an id is a record of its own only where the id is not needed, so it is left out here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.sources.tables import table


def once(df: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])


def exp_view(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """Explanation records, one row each, with ``columns``."""
    return once(table(spark, sf_dir, "explanations"), "exp_id", *columns)


def noise_view(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return once(table(spark, sf_dir, "noise_runs"), "noise_id", *columns)


def with_ops(df: DataFrame, operations: str = "operations") -> DataFrame:
    """One row per edit: seq, op, node, src, dst instead of the JSON texts in ``operations``.

    A node edit has ``node``, an edge edit ``src`` and ``dst``. Texts that are no edit have a null ``op``.
    """
    rest = [c for c in df.columns if c != operations]
    each = df.select(*rest, F.posexplode(operations).alias("seq", "o"))
    op = F.get_json_object("o", "$[0]")
    return each.select(
        *rest,
        "seq",
        op.alias("op"),
        F.when(op.endswith("node"), F.get_json_object("o", "$[1]")).alias("node"),
        F.when(op.endswith("edge"), F.get_json_object("o", "$[1][0]")).alias("src"),
        F.when(op.endswith("edge"), F.get_json_object("o", "$[1][1]")).alias("dst"),
    )


def ops_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ops(exp_view(spark, sf_dir, "kg_id", "mode", "found", "operations"))


def ent_view(spark: SparkSession, sf_dir: str, graph: str = "original_subgraph") -> DataFrame:
    """exp_id, kg_id, pos, name, type, description, rank: the entities of a record's subgraph."""
    rows = exp_view(spark, sf_dir, "kg_id", F.col(f"{graph}.entities").alias("x"))
    return rows.select("exp_id", "kg_id", F.posexplode("x").alias("pos", "x")).select("exp_id", "kg_id", "pos", "x.*")


def rel_view(spark: SparkSession, sf_dir: str, graph: str = "original_subgraph") -> DataFrame:
    """exp_id, kg_id, pos, src, tgt, keywords, description, weight: the relations of a record's subgraph."""
    rows = exp_view(spark, sf_dir, "kg_id", F.col(f"{graph}.relations").alias("x"))
    return rows.select("exp_id", "kg_id", F.posexplode("x").alias("pos", "x")).select("exp_id", "kg_id", "pos", "x.*")


def graph_edges(relations: DataFrame) -> DataFrame:
    """exp_id, kg_id, src, tgt, description: edges of the context graph; of equal ends the last relation counts."""
    some = relations.where("src <> '' AND tgt <> ''")
    return some.groupBy("exp_id", "kg_id", "src", "tgt").agg(F.max_by(F.coalesce("description", F.lit("")), "pos").alias("description"))


def graph_nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """exp_id, kg_id, name: nodes of the context graph, named entities and ends of edges."""
    names = entities.where("name <> ''").select("exp_id", "kg_id", "name")
    ends = edges.select("exp_id", "kg_id", F.explode(F.array("src", "tgt")).alias("name"))
    return names.unionByName(ends).distinct()


def cge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_edges(rel_view(spark, sf_dir))


def cgn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(ent_view(spark, sf_dir), cge_view(spark, sf_dir))


def kgn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kg_id, name, type, node_id: the nodes of the knowledge graphs, with the type of their latest life."""
    rows = table(spark, sf_dir, "kg_nodes").where("kg_id IS NOT NULL AND name IS NOT NULL")
    return rows.groupBy("kg_id", "name").agg(F.max_by(F.coalesce("entity_type", F.lit("")), F.struct("valid_from", F.coalesce("entity_type", F.lit("")))).alias("type"), F.min("node_id").alias("node_id"))


def kge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kg_id, src, tgt, n: the edges of the knowledge graphs, seen in ``n`` context graphs."""
    return cge_view(spark, sf_dir).groupBy("kg_id", "src", "tgt").agg(F.count(F.lit(1)).alias("n"))


def sco_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, exp_id, method, perm_id, element_id, score of all runs, a row per element; runs over whole graphs have no exp_id."""
    rows = once(table(spark, sf_dir, "attributions"), "attr_id", "run_id", "exp_id", "method", "perm_id", "shapley_scores")
    each = rows.select("run_id", "exp_id", "method", "perm_id", F.explode("shapley_scores").alias("element_id", "score"))
    return each.where("score IS NOT NULL AND NOT isnan(score)").withColumn("score", F.col("score") + 0.0)


def ids_of_ops(ops: DataFrame) -> DataFrame:
    """Adds ``element_id`` to edits: E::name or R::src->dst."""
    edge = F.concat(F.lit("R::"), F.col("src"), F.lit("->"), F.col("dst"))
    return ops.withColumn("element_id", F.coalesce(F.concat(F.lit("E::"), F.col("node")), edge))


_OP = "json_extract_string(o, '$[0]')"
CTE = {
    "exp": "exp AS (SELECT DISTINCT ON (exp_id) * FROM explanations WHERE exp_id IS NOT NULL)",
    "noi": "noi AS (SELECT DISTINCT ON (noise_id) * FROM noise_runs WHERE noise_id IS NOT NULL)",
    "ops": f"""ops AS (SELECT exp_id, kg_id, mode, found, CAST(i AS INT) AS seq, {_OP} AS op,
  CASE WHEN {_OP} LIKE '%node' THEN json_extract_string(o, '$[1]') END AS node, CASE WHEN {_OP} LIKE '%edge' THEN json_extract_string(o, '$[1][0]') END AS src,
  CASE WHEN {_OP} LIKE '%edge' THEN json_extract_string(o, '$[1][1]') END AS dst
  FROM (SELECT exp_id, kg_id, mode, found, unnest(operations) AS o, unnest(range(len(operations))) AS i FROM exp))""",
    "ent": "ent AS (SELECT exp_id, kg_id, CAST(pos AS INT) AS pos, x.name AS name, x.type AS type, x.description AS description, x.rank AS rank FROM (SELECT exp_id, kg_id, unnest(original_subgraph.entities) AS x, unnest(range(len(original_subgraph.entities))) AS pos FROM exp))",
    "rel": "rel AS (SELECT exp_id, kg_id, CAST(pos AS INT) AS pos, x.src AS src, x.tgt AS tgt, x.keywords AS keywords, x.description AS description, x.weight AS weight FROM (SELECT exp_id, kg_id, unnest(original_subgraph.relations) AS x, unnest(range(len(original_subgraph.relations))) AS pos FROM exp))",
    "cge": "cge AS (SELECT exp_id, kg_id, src, tgt, arg_max(coalesce(description, ''), pos) AS description FROM rel WHERE src <> '' AND tgt <> '' GROUP BY 1, 2, 3, 4)",
    "cgn": "cgn AS (SELECT DISTINCT exp_id, kg_id, name FROM (SELECT exp_id, kg_id, name FROM ent WHERE name <> '' UNION ALL SELECT exp_id, kg_id, src FROM cge UNION ALL SELECT exp_id, kg_id, tgt FROM cge))",
    "kgn": "kgn AS (SELECT kg_id, name, arg_max(coalesce(entity_type, ''), (valid_from, coalesce(entity_type, ''))) AS type, min(node_id) AS node_id FROM kg_nodes WHERE kg_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2)",
    "kge": "kge AS (SELECT kg_id, src, tgt, count(*) AS n FROM cge GROUP BY 1, 2, 3)",
    "sco": """sco AS (SELECT run_id, exp_id, method, perm_id, element_id, score + 0.0e0 AS score FROM (
  SELECT run_id, exp_id, method, perm_id, unnest(map_keys(shapley_scores)) AS element_id, unnest(map_values(shapley_scores)) AS score
  FROM (SELECT DISTINCT ON (attr_id) * FROM attributions WHERE attr_id IS NOT NULL)) WHERE score IS NOT NULL AND NOT isnan(score))""",
}
#: The order in which the views build on each other.
_NEEDS = {"ops": ("exp",), "ent": ("exp",), "rel": ("exp",), "cge": ("rel",), "cgn": ("ent", "cge"), "kge": ("cge",)}


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views and of those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(CTE[n] for n in order)

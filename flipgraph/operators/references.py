"""References to records that do not exist (problem 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.operators.skew import hot_keys, salted_lookup
from flipgraph.session import cut
from flipgraph.sources.tables import table

KEYS = ["kg_id", "name"]


def node_references(records: DataFrame, table_name: str, id_col: str, graph: str = "original_subgraph") -> DataFrame:
    """One row per non-null name in the entities and relation ends of each record's subgraph.

    Columns: table_name, rec_id, ref_field, pos, kg_id, name, at, period. Null subgraphs, arrays and
    elements give no row; extra columns of ``records`` are ignored. ``at`` is null where recorded_at is no time.
    """

    def refs(part: str, field: str, label: str):
        return F.transform(F.col(f"{graph}.{part}"), lambda x, i: F.struct(F.lit(label).alias("ref_field"), i.alias("pos"), x[field].alias("name")))

    empty = F.array().cast("array<struct<ref_field:string,pos:int,name:string>>")
    parts = [refs("entities", "name", "entity"), refs("relations", "src", "src"), refs("relations", "tgt", "tgt")]
    each = F.filter(F.concat(*(F.coalesce(p, empty) for p in parts)), lambda r: r["name"].isNotNull())
    return records.select(
        F.lit(table_name).alias("table_name"),
        F.col(id_col).alias("rec_id"),
        "kg_id",
        F.expr("try_cast(recorded_at AS timestamp_ntz)").alias("at"),
        F.substring("recorded_at", 1, 7).alias("period"),
        F.inline(each),
    )


def node_lives(nodes: DataFrame) -> DataFrame:
    """One row per (kg_id, name): the distinct lives of the node. Rows without graph, name or begin are no life."""
    life = F.struct(F.col("valid_from").cast("timestamp_ntz").alias("since"), F.col("deleted_at").cast("timestamp_ntz").alias("until"))
    known = nodes.where(F.col("kg_id").isNotNull() & F.col("name").isNotNull() & F.col("valid_from").isNotNull())
    return known.groupBy(*KEYS).agg(F.collect_set(life).alias("lives"))


def orphan_references(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """The references that find no living node, each with its state.

    The distinct foreign keys are counted with map-side combine and matched against the parent keys once;
    the keys that have no parent (the anti-join) or that have a life to be compared with the record's time are
    joined back to the references, hot keys in several parts. state: ``missing`` (no life at any time),
    ``deleted`` (a life ended at or before ``at``), else ``late``. A null graph or name finds nothing;
    a null time finds no living node and cannot lie after an end. Repeated rows come out once.
    """
    keys = references.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("kg_id IS NOT NULL")
    keys = cut(keys.join(node_lives(nodes), KEYS, "left"), "keys")
    always = F.size("lives") < 0  # null array: the key has no parent
    hot = hot_keys(keys, KEYS)
    found = salted_lookup(references, keys.select(*KEYS, "lives"), KEYS, hot, F.struct("rec_id", "pos"))
    lives, at = F.col("lives"), F.col("at")
    alive = F.exists(lives, lambda x: (x["since"] <= at) & (x["until"].isNull() | (at < x["until"])))
    ended = F.exists(lives, lambda x: x["until"] <= at)
    state = F.when(lives.isNull() | always, "missing").when(F.coalesce(ended, F.lit(False)), "deleted").otherwise("late")
    return (
        found.where(lives.isNull() | ~F.coalesce(alive, F.lit(False)))
        .select("table_name", "rec_id", "ref_field", "pos", state.alias("state"), "period")
        .dropDuplicates(["table_name", "rec_id", "ref_field", "pos"])
    )


def orphan_counts(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans by state, per table and month; months without orphans are listed with zeros.

    The counts of the orphans are taken from distinct (record, field, place), as are the references.
    """
    ids = ["table_name", "rec_id", "ref_field", "pos"]
    every = references.select(*ids, "period").dropDuplicates(ids).groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_refs"))
    by_state = [F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}") for s in ("missing", "deleted", "late")]
    bad = orphans.groupBy("table_name", "period").agg(*by_state)
    same = (every["table_name"] == bad["table_name"]) & every["period"].eqNullSafe(bad["period"])
    zero = [F.coalesce(bad[f"n_{s}"], F.lit(0)).alias(f"n_{s}") for s in ("missing", "deleted", "late")]
    return every.join(bad, same, "left").select(every["table_name"], every["period"], "n_refs", *zero)


def record_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [("explanations", "exp_id"), ("noise_runs", "noise_id")]
    return reduce(DataFrame.unionByName, (node_references(table(spark, sf_dir, t), t, k) for t, k in sources))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(record_references(spark, sf_dir), table(spark, sf_dir, "kg_nodes"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = record_references(spark, sf_dir)
    return orphan_counts(refs, orphan_references(refs, table(spark, sf_dir, "kg_nodes")))


_REFS_SQL = """
recs AS (
  SELECT 'explanations' AS table_name, exp_id AS rec_id, kg_id, recorded_at, original_subgraph AS g FROM explanations
  UNION ALL SELECT 'noise_runs', noise_id, kg_id, recorded_at, original_subgraph FROM noise_runs),
ents AS (SELECT table_name, rec_id, kg_id, recorded_at, unnest(g.entities) AS x, unnest(range(len(g.entities))) AS pos FROM recs),
rels AS (SELECT table_name, rec_id, kg_id, recorded_at, unnest(g.relations) AS x, unnest(range(len(g.relations))) AS pos FROM recs),
refs AS (
  SELECT DISTINCT table_name, rec_id, kg_id, recorded_at, ref_field, CAST(pos AS INT) AS pos, name FROM (
    SELECT table_name, rec_id, kg_id, recorded_at, 'entity' AS ref_field, pos, x.name AS name FROM ents
    UNION ALL SELECT table_name, rec_id, kg_id, recorded_at, 'src', pos, x.src FROM rels
    UNION ALL SELECT table_name, rec_id, kg_id, recorded_at, 'tgt', pos, x.tgt FROM rels) WHERE name IS NOT NULL),
orphans AS (
  SELECT r.table_name, r.rec_id, r.ref_field, r.pos,
    CASE WHEN count(n.name) = 0 THEN 'missing' WHEN count(*) FILTER (n.deleted_at <= CAST(r.recorded_at AS TIMESTAMP)) > 0 THEN 'deleted' ELSE 'late' END AS state,
    substr(r.recorded_at, 1, 7) AS period
  FROM refs r LEFT JOIN kg_nodes n ON n.kg_id = r.kg_id AND n.name = r.name
  GROUP BY r.table_name, r.rec_id, r.ref_field, r.pos, r.recorded_at
  HAVING count(*) FILTER (n.valid_from <= CAST(r.recorded_at AS TIMESTAMP) AND (n.deleted_at IS NULL OR CAST(r.recorded_at AS TIMESTAMP) < n.deleted_at)) = 0)
"""

P3_SQL = {
    "p3_found": f"WITH {_REFS_SQL} SELECT table_name, rec_id, ref_field, pos, state, period FROM orphans",
    "p3_counts": f"""WITH {_REFS_SQL}
, every AS (SELECT table_name, substr(recorded_at, 1, 7) AS period, count(*) AS n_refs FROM refs GROUP BY 1, 2)
SELECT e.table_name, e.period, e.n_refs, count(*) FILTER (o.state = 'missing') AS n_missing, count(*) FILTER (o.state = 'deleted') AS n_deleted,
  count(*) FILTER (o.state = 'late') AS n_late
FROM every e LEFT JOIN orphans o ON o.table_name = e.table_name AND o.period IS NOT DISTINCT FROM e.period GROUP BY 1, 2, 3""",
}

"""Queries of the searches. They have no SQL twin; the tests compare them with brute force."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.operators import search as S
from flipgraph.plans import graph as PG
from flipgraph.plans.catalog import Catalog
from flipgraph.sources import records as R
from flipgraph.sources.tables import table

C = Catalog()
K = "exp_id"
DELETE = ("delete_node", "delete_edge")
ALL = ("delete_node", "delete_edge", "add_node", "add_edge")
#: Calls that a search may spend on a question, and the most that edits may cost, as in the reference; the operators take any budget.
CALLS, COST = 200, 20


def questions(s: SparkSession, d: str, modes: tuple[str, ...], answer: str) -> DataFrame:
    """One row per question with its graph, similarities and the nodes that ``answer`` names."""
    base = R.exp_view(s, d, "kg_id", "mode", F.col("original_subgraph.entities.name").alias("entities"), F.col("original_subgraph.relations").alias("relations"), F.col(f"answers.{answer}").alias("answer"))
    base = base.where(F.col("mode").isin(*modes))
    sims = PG.similarities(s, d).groupBy(K).agg(F.collect_list(F.struct("name", "sim")).alias("sims"))
    needs = R.cgn_view(s, d).join(base.select(K, "answer"), K).where(text.norm_contains(F.col("answer"), F.col("name"))).groupBy(K).agg(F.collect_set("name").alias("needs"))
    return base.join(sims, K, "left").join(needs, K, "left").select(K, "entities", "relations", "sims", "needs")


def corrected(s: SparkSession, d: str, run) -> DataFrame:
    """``run`` on the questions answered wrongly, each with its whole knowledge graph to add from."""
    base = R.exp_view(s, d, "kg_id", "mode", F.col("original_subgraph.entities.name").alias("entities"), F.col("original_subgraph.relations").alias("relations"), F.col("answers.ground_truth").alias("answer"))
    count = PG.vector_count(s, d)
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = base.where(F.col("mode").isin("ff", "tf")).withColumn("vec_id", F.col(K) % count).join(v, "vec_id", "left").drop("vec_id", "mode")
    return S.search_in_graphs(q, PG.node_vectors(s, d, count).select("kg_id", "name", "vec"), R.kge_view(s, d).select("kg_id", "src", "tgt"), run)


def _summary(df: DataFrame) -> DataFrame:
    return df.select(K, "found", F.round("cost", 6).alias("cost"), "calls", F.size("ops").alias("n_ops"), F.to_json("ops").alias("ops"))


@C.add("g_search_break")
def _(s, d):
    """Cheapest deletions that break an answer, exact best-first."""
    return _summary(S.search_all(questions(s, d, ("ft",), "original"), partial(S.best_first, ops=DELETE, hit=0, max_cost=COST, max_calls=CALLS)))


@C.add("g_search_tiered")
def _(s, d):
    """The least costs by whole tiers of states, without a budget of calls: also of flips that the search has no calls left for."""
    return S.tiered_deletions(questions(s, d, ("ft",), "original"), COST).select(K, "found", "cost", "calls")


@C.add("g_search_correct")
def _(s, d):
    """Cheapest edits, additions among them, after which the graph supports the ground truth."""
    return _summary(corrected(s, d, partial(S.best_first, ops=ALL, hit=1, max_cost=COST, max_calls=CALLS, model=2, tier=0.5)))


@C.add("g_psp_refine")
def _(s, d):
    """Probe first, then refine the hits within their stars."""
    return _summary(S.search_all(questions(s, d, ("ft",), "original"), partial(S.best_first, ops=DELETE, hit=0, max_cost=COST, max_calls=CALLS, psp_k=5)))


@C.add("g_psp_ff")
def _(s, d):
    """Corrective search with the cheapest probe hit as an upper bound."""
    return _summary(corrected(s, d, partial(S.best_first, ops=ALL, hit=1, max_cost=COST, max_calls=CALLS, psp_k=5, refine_hits=False, incumbent=True)))


@C.add("g_single_edit")
def _(s, d):
    """Single deletions of a node, tried in the order of names."""
    return _summary(S.search_all(questions(s, d, ("ft",), "original"), partial(S.single_edit, kind="node", hit=0)))


@C.add("g_single_edge")
def _(s, d):
    return _summary(S.search_all(questions(s, d, ("ft",), "original"), partial(S.single_edit, kind="edge", hit=0)))


@C.add("ev_ablation")
def _(s, d):
    """Finds, mean cost and mean calls of the search without a probe and with probes of 2, 3 and 5 pivots."""
    q = questions(s, d, ("ft",), "original")
    cells = [S.search_all(q, partial(S.best_first, ops=DELETE, hit=0, max_cost=COST, max_calls=CALLS, psp_k=k)).withColumn("cell", F.lit(f"psp_k{k}" if k else "no_psp")) for k in (0, 2, 3, 5)]
    from flipgraph.operators.graph import union_all

    return union_all(cells).groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("found"), 1)).alias("n_found"), F.round(F.avg(F.when(F.col("found"), F.col("cost"))), 6).alias("mean_cost"), F.round(F.avg("calls"), 6).alias("mean_calls"))

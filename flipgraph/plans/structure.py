"""Queries of the structural measures. They have no SQL twin, except the replay; the tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.operators import structure as X
from flipgraph.operators.aggregates import op_operands, rnd
from flipgraph.operators.search import State
from flipgraph.plans.catalog import Catalog
from flipgraph.sources import records as R

C = Catalog()
K = "exp_id"


def graphs(s: SparkSession, d: str) -> DataFrame:
    """exp_id, nodes, edges: one row per context graph."""
    e = R.cge_view(s, d).groupBy(K).agg(F.collect_list(F.struct("src", "tgt", "description")).alias("edges"))
    return R.cgn_view(s, d).groupBy(K).agg(F.collect_set("name").alias("nodes")).join(e, K, "left")


@C.add("g_closeness")
def _(s, d):
    run = lambda i, n, e, _r: [(i, v, round(x, 6)) for v, x in X.closeness(n, e).items()]
    return X.per_graph(graphs(s, d), run, "exp_id long, name string, closeness double")


@C.add("g_node_betweenness")
def _(s, d):
    run = lambda i, n, e, _r: [(i, v, round(x, 6)) for v, x in X.betweenness(n, e)[0].items()]
    return X.per_graph(graphs(s, d), run, "exp_id long, name string, betweenness double")


@C.add("g_edge_betweenness")
def _(s, d):
    run = lambda i, n, e, _r: [(i, a, b, round(x, 6)) for (a, b), x in X.betweenness(n, e)[1].items()]
    return X.per_graph(graphs(s, d), run, "exp_id long, src string, tgt string, betweenness double")


@C.add("g_cut")
def _(s, d):
    """Cut points and bridges of each graph, and how many edits hit them."""
    ops = op_operands(R.ops_view(s, d).where("found")).groupBy(K).agg(F.collect_list("operand").alias("operands"))

    def run(i, n, e, row):
        points, bridges = X.cut_points(n, e)
        hit = sum(o in points for o in (row["operands"] if row["operands"] is not None else ()))
        return [(i, len(points), len(bridges), hit)]

    return X.per_graph(graphs(s, d).join(ops, K, "left"), run, "exp_id long, cut_points int, bridges int, hits int")


@C.add("g_shortest_paths")
def _(s, d):
    """Nodes on shortest paths between the entities that a record's edits touch."""
    ops = op_operands(R.ops_view(s, d).where("found")).groupBy(K).agg(F.collect_set("operand").alias("ends"))

    def run(i, n, e, row):
        ends = sorted(set(row["ends"]) & set(n))
        return [(i, v) for v in sorted(X.path_nodes(n, e, ends))]

    return X.per_graph(graphs(s, d).join(ops, K), run, "exp_id long, name string")


def replayed(s: SparkSession, d: str) -> DataFrame:
    ops = R.ops_view(s, d).where("found").groupBy(K).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "node", "src", "dst"))).alias("ops"))

    def run(i, n, e, row):
        edges = [(x["src"], x["tgt"], x["description"]) for x in (row["edges"] if row["edges"] is not None else ())]
        state, cost, _each = X.replay(State(frozenset(n), frozenset(edges)), [(o["op"], o["node"], o["src"], o["dst"]) for o in row["ops"]])
        return [(i, cost, len(state.nodes), len(state.edges))]

    return X.per_graph(graphs(s, d).join(ops, K), run, "exp_id long, cost long, n_nodes int, n_edges int")


@C.add("g_seq_edit_cost")
def _(s, d):
    """Replays each record's edits on its graph: the summed cost of deletions and the size of what is left."""
    return replayed(s, d)


@C.add("ev_structural")
def _(s, d):
    """Mean closeness and betweenness of the nodes that deletions touch and of the others."""
    def run(i, n, e, _r):
        c, b = X.closeness(n, e), X.betweenness(n, e)[0]
        return [(i, v, c[v], b[v]) for v in n]

    m = X.per_graph(graphs(s, d), run, "exp_id long, name string, closeness double, betweenness double")
    hit = op_operands(R.ops_view(s, d).where("found"), "deletions").select(K, F.col("operand").alias("name")).distinct().withColumn("modified", F.lit(True))
    j = m.join(hit, [K, "name"], "left").withColumn("modified", F.coalesce("modified", F.lit(False)))
    return j.groupBy("modified").agg(F.count("*").alias("n"), rnd(F.avg("closeness")).alias("closeness"), rnd(F.avg("betweenness")).alias("betweenness"))

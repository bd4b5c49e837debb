"""Orphan references: every state, nulls, repeated rows, hot keys, empty tables and clashing names."""

from datetime import datetime

from flipgraph.operators import references as P
from flipgraph.operators.skew import hot_keys, salted_lookup

SUB = "struct<entities:array<struct<name:string,type:string,description:string,rank:double>>,relations:array<struct<src:string,tgt:string,keywords:string,description:string,weight:double>>>"
REC = f"exp_id long, kg_id string, recorded_at string, original_subgraph {SUB}, name string, pos int"
NODE = "node_id long, kg_id string, name string, valid_from timestamp_ntz, deleted_at timestamp_ntz, state string"


def day(n):
    return datetime(2026, 1, n)


def record(i, names, rels=(), kg="k", at="2026-01-10T12:00:00"):
    return (i, kg, at, ([(n, None, None, None) for n in names], [(s, t, None, None, None) for s, t in rels]), "clash", 7)


def states(spark, records, nodes):
    r = P.node_references(spark.createDataFrame(records, REC), "explanations", "exp_id")
    out = P.orphan_references(r, spark.createDataFrame(nodes, NODE)).collect()
    return sorted((x.rec_id, x.ref_field, x.pos, x.state, x.period) for x in out)


NODES = [
    (1, "k", "alive", day(1), None, "x"),
    (2, "k", "ended", day(1), day(5), "x"),
    (3, "k", "later", day(20), None, "x"),
    (4, "k", "back", day(1), day(5), "x"),
    (4, "k", "back", day(9), None, "x"),
    (5, "k", "gap", day(1), day(5), "x"),
    (5, "k", "gap", day(20), None, "x"),
    (6, "other", "foreign", day(1), None, "x"),
    (7, "k", "now", datetime(2026, 1, 10, 12), None, "x"),
    (8, "k", "justended", day(1), datetime(2026, 1, 10, 12), "x"),
    (9, None, "nokg", day(1), None, "x"),
]


def test_states(spark):
    names = ["alive", "ended", "later", "back", "gap", "foreign", "now", "justended", None, "", "Alive"]
    got = states(spark, [record(1, names, [("alive", "nobody"), (None, "ended")])], NODES)
    p = "2026-01"
    assert got == sorted([
        (1, "entity", 1, "deleted", p), (1, "entity", 2, "late", p), (1, "entity", 4, "deleted", p), (1, "entity", 5, "missing", p), (1, "entity", 7, "deleted", p),
        (1, "entity", 9, "missing", p), (1, "entity", 10, "missing", p), (1, "tgt", 0, "missing", p), (1, "tgt", 1, "deleted", p)])


def test_nulls_repeats_and_empty(spark):
    rows = [record(1, ["x"]), record(1, ["x"]), record(2, ["alive"], kg=None), record(3, ["alive"], at=None), record(4, ["alive"], at="no time"), (5, "k", "2026-01-10", None, None, None), (6, "k", "2026-01-10", (None, None), None, None)]
    got = states(spark, rows, NODES)
    assert got == [(1, "entity", 0, "missing", "2026-01"), (2, "entity", 0, "missing", "2026-01"), (3, "entity", 0, "late", None), (4, "entity", 0, "late", "no time")]
    assert states(spark, [], NODES) == []
    assert states(spark, [record(1, ["alive"])], []) == [(1, "entity", 0, "missing", "2026-01")]


def test_counts(spark):
    r = P.node_references(spark.createDataFrame([record(1, ["x", "alive"]), record(1, ["x", "alive"]), record(2, ["later"], at="2026-02-01T00:00:00")], REC), "explanations", "exp_id")
    o = P.orphan_references(r, spark.createDataFrame(NODES, NODE))
    got = {(c.period, c.n_refs, c.n_missing, c.n_deleted, c.n_late) for c in P.orphan_counts(r, o).collect()}
    assert got == {("2026-01", 2, 1, 0, 0), ("2026-02", 1, 0, 0, 0)}


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k")
    right = left.select("k").distinct().selectExpr("k", "length(k) AS v")
    hot = hot_keys(left.groupBy("k").count().withColumnRenamed("count", "n"), ["k"], share=0.1)
    assert [h["k"] for h in hot] == ["hot"] and hot[0]["salts"] > 1
    j = salted_lookup(left, right, ["k"], hot, left["id"])
    assert j.count() == 3000 and j.where("v IS NULL").count() == 0
    assert salted_lookup(left, right.where("k <> 'hot'"), ["k"], hot, left["id"]).where("v IS NULL").count() == 1000
    assert salted_lookup(left, right, ["k"], hot, left["id"], "left_semi").count() == 3000

"""Graph edits and costs on graphs small enough to count by hand, and against the plain state class."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flipgraph.operators import graph as G
from flipgraph.operators.search import State

EDGE = "exp_id long, src string, tgt string, description string"


def frames(spark, graphs):
    """graphs: {id: (nodes, edges)}"""
    nodes = [(i, n) for i, (ns, es) in graphs.items() for n in sorted(set(ns) | {x for e in es for x in e})]
    edges = [(i, s, t, "") for i, (_, es) in graphs.items() for s, t in dict.fromkeys(es)]
    return spark.createDataFrame(nodes, "exp_id long, name string"), spark.createDataFrame(edges, EDGE)


SHAPES = {
    1: (["a"], []),
    2: ([], [("a", "b"), ("b", "c")]),
    3: ([], [("h", "a"), ("h", "b"), ("c", "h"), ("d", "h")]),
    4: ([], [("a", "b"), ("b", "c"), ("c", "a")]),
    5: ([], [("a", "b"), ("b", "a")]),
    6: ([], [("a", "a")]),
    7: (["z"], [("a", "b"), ("c", "d")]),
    8: ([], [("a", "a"), ("a", "b")]),
}


def test_node_costs_by_hand(spark):
    n, e = frames(spark, SHAPES)
    cost = {(r.exp_id, r.name): r.cost for r in G.node_deletion_costs(n, e, "exp_id").collect()}
    assert cost[1, "a"] == 1
    assert cost[2, "b"] == 1 + 2 + 2 and cost[2, "a"] == 1 + 1
    assert cost[3, "h"] == 1 + 4 + 4
    assert cost[4, "a"] == 1 + 2
    assert cost[5, "a"] == 1 + 2 + 1
    assert cost[6, "a"] == 1 + 2
    assert cost[7, "z"] == 1 and cost[7, "a"] == 1 + 1 + 1
    uc = {(r.exp_id, r.name): r.cost for r in G.node_deletion_costs(n, e, "exp_id", reference_uc=True).collect()}
    assert uc[5, "a"] == 1 + 2 + 2


def test_edge_costs_by_hand(spark):
    n, e = frames(spark, SHAPES)
    cost = {(r.exp_id, r.src, r.tgt): r.cost for r in G.edge_deletion_costs(n, e, "exp_id").collect()}
    assert cost[2, "a", "b"] == 2 and cost[4, "a", "b"] == 1 and cost[5, "a", "b"] == 1 and cost[6, "a", "a"] == 3 and cost[7, "a", "b"] == 3


def test_stars_and_shapes(spark):
    n, e = frames(spark, SHAPES)
    star = {}
    for r in G.closed_stars(n, e, "exp_id").collect():
        star.setdefault((r.exp_id, r.pivot), set()).add(r.member)
    assert star[3, "h"] == {"h", "a", "b", "c", "d"} and star[3, "a"] == {"a"} and star[2, "b"] == {"a", "b", "c"} and star[8, "b"] == {"b"}
    shape = {r.exp_id: r for r in G.star_shapes(n, e, "exp_id").collect()}
    assert shape[3].is_star and not shape[4].is_star and shape[7].is_star_forest and not shape[7].is_star and shape[7].n_components == 3


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), max_size=7), min_size=1, max_size=12))
def test_costs_equal_the_state_class(spark, graphs):
    g = {i: (["x"], es) for i, es in enumerate(graphs)}
    n, e = frames(spark, g)
    got = {(r.exp_id, r.name): r.cost for r in G.node_deletion_costs(n, e, "exp_id").collect()}
    for i, (ns, es) in g.items():
        names = set(ns) | {x for p in es for x in p}
        s = State(frozenset(names), frozenset((a, b, "") for a, b in es))
        for v in names:
            assert got[i, v] == s.without_node(v)[1]


def test_components_of_a_long_path(spark):
    es = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)]
    n, e = frames(spark, {1: ([], es), 2: (["q"], [])})
    rows = {(r.exp_id, r.name): r.component for r in G.components(n, e, "exp_id").collect()}
    assert {v for (i, _), v in rows.items() if i == 1} == {"n000"} and rows[2, "q"] == "q"


def test_pagerank_sums_to_one(spark):
    n, e = frames(spark, {1: (["z"], [("a", "b"), ("b", "c"), ("d", "b")])})
    rows = {r.name: r["rank"] for r in G.pagerank(n, e, "exp_id").collect()}
    joined = {r.name: r["rank"] for r in G.pagerank(n, e, "exp_id", one_task=0).collect()}
    assert joined.keys() == rows.keys() and all(abs(joined[k] - rows[k]) < 1e-12 for k in rows)
    assert abs(sum(rows.values()) - 1) < 1e-9 and rows["c"] > rows["a"] == pytest.approx(rows["z"])


def test_empty_graphs(spark):
    n, e = frames(spark, {})
    n, e = spark.createDataFrame([], "exp_id long, name string"), spark.createDataFrame([], EDGE)
    for df in (G.node_deletion_costs(n, e, "exp_id"), G.edge_deletion_costs(n, e, "exp_id"), G.components(n, e, "exp_id"), G.state_keys(n, e, "exp_id")):
        assert df.count() == 0

"""Centralities and cut points against plain enumeration."""

from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from flipgraph.operators import structure as X

NODES = list("abcde")
EDGES = st.lists(st.tuples(st.sampled_from(NODES), st.sampled_from(NODES)), max_size=12, unique=True)


def shortest(edges, a, b):
    """All shortest paths from a to b, as node tuples."""
    es = set(edges)
    for k in range(len(NODES)):
        found = [(a, *mid, b) for mid in permutations([x for x in NODES if x not in (a, b)], k) if all(p in es for p in zip((a, *mid), (*mid, b), strict=True))]
        if found:
            return found
    return []


def parts(nodes, pairs):
    left, n = set(nodes), 0
    while left:
        todo = [left.pop()]
        n += 1
        while todo:
            v = todo.pop()
            for p in pairs:
                if v in p:
                    for w in set(p) & left:
                        left.discard(w)
                        todo.append(w)
    return n


@settings(max_examples=60, deadline=None)
@given(EDGES)
def test_against_enumeration(edges):
    paths = {(a, b): shortest(edges, a, b) for a in NODES for b in NODES if a != b}
    near = X.closeness(NODES, edges)
    node, edge = X.betweenness(NODES, edges)
    for v in NODES:
        d = [len(paths[a, v][0]) - 1 for a in NODES if a != v and paths[a, v]]
        assert abs(near[v] - ((len(d) / sum(d)) * (len(d) / 4) if d else 0)) < 1e-12
        want = sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in paths.values() if ps)
        assert abs(node[v] - want / 12) < 1e-12
    for e in edge:
        want = sum(sum(e in zip(p, p[1:], strict=False) for p in ps) / len(ps) for ps in paths.values() if ps)
        assert abs(edge[e] - want / 20) < 1e-12
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    points, bridges = X.cut_points(NODES, edges)
    whole = parts(NODES, pairs)
    for v in NODES:
        rest = parts([x for x in NODES if x != v], {p for p in pairs if v not in p})
        alone = not any(v in p for p in pairs)
        assert (v in points) == (rest > whole - alone)
    assert bridges == {p for p in pairs if parts(NODES, pairs - {p}) > whole}


def test_replay_charges_nothing_for_what_is_gone():
    s = X.State(frozenset("abc"), frozenset({("a", "b", ""), ("b", "c", "")}))
    end, cost, each = X.replay(s, [("delete_node", "b", None, None), ("delete_edge", None, "a", "b"), ("add_node", "n", None, None)])
    assert end.nodes == {"n"} and each == [5, 0, 0] and cost == 5

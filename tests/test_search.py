"""Searches against the enumeration of all deletions on small graphs."""

import heapq
from itertools import combinations
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from flipgraph.operators import search as S
from flipgraph.plans import graph as PG
from flipgraph.plans import search as P

DELETE = ("delete_node", "delete_edge")


def question(edges, needs=(), grow=None, sim=None):
    nodes = {x for e in edges for x in e} | {"z"}
    return S.Question(S.State(frozenset(nodes), frozenset((a, b, "") for a, b in edges)), sim or {}, grow or {}, frozenset(needs))


def cheapest(q, judge, hit, limit):
    """Least cost over all sequences of deletions, by plain relaxation."""
    best, todo = {q.state: 0}, [q.state]
    while todo:
        s = todo.pop()
        for v in s.nodes:
            child, c = s.without_node(v)
            if best[s] + c < best.get(child, limit + 1):
                best[child] = best[s] + c
                todo.append(child)
        for a, b, _ in s.edges:
            child, c = s.without_edge((a, b))
            if best[s] + c < best.get(child, limit + 1):
                best[child] = best[s] + c
                todo.append(child)
    flips = [c for s, c in best.items() if s != q.state and judge.score(s) == hit]
    return min(flips, default=None)


class Pairs(S.Judge):
    """1 while two given nodes are both there and linked."""

    def score(self, state):
        return int(any({a, b} == {"a", "b"} for a, b, _ in state.edges))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), min_size=1, max_size=6, unique=True), st.sampled_from([S.LexicalJudge, Pairs]))
def test_best_first_is_cheapest(edges, judge):
    q = question(edges, needs={"a"} & {x for e in edges for x in e})
    want = cheapest(q, judge(q), 0, 20)
    got = S.best_first(q, judge(q), DELETE, 0, max_cost=20, max_calls=100_000)
    assert (got.cost if got.ops else None) == want
    probed = S.best_first(q, judge(q), DELETE, 0, max_cost=20, max_calls=100_000, psp_k=3)
    if probed.ops and want is not None:
        assert probed.cost >= want


def test_tiers_equal_best_first(spark):
    graphs = [[("a", "b"), ("b", "c"), ("c", "d")], [("a", "b"), ("b", "a")], [("c", "d")], [("a", "b"), ("a", "c"), ("a", "d")]]
    rows = [(i, sorted({x for e in es for x in e}), [(s, t, "", "", 0.0) for s, t in es], ["a"] if any("a" in e for e in es) else None) for i, es in enumerate(graphs)]
    df = spark.createDataFrame(rows, "exp_id long, entities array<string>, relations array<struct<src:string,tgt:string,keywords:string,description:string,weight:double>>, needs array<string>")
    tiers = {r.exp_id: (r.found, r.cost) for r in S.tiered_deletions(df, 12).collect()}
    for i, es in enumerate(graphs):
        q = S.question_of({"entities": sorted({x for e in es for x in e}), "relations": [{"src": s, "tgt": t, "description": ""} for s, t in es], "needs": ["a"] if any("a" in e for e in es) else None})
        f = S.best_first(q, S.LexicalJudge(q), DELETE, 0, max_cost=12, max_calls=100_000)
        assert tiers[i][0] == (f.ops is not None)
        if f.ops:
            assert tiers[i][1] == f.cost


def test_budget_is_exceeded_by_one_call_at_most():
    q = question([(a, b) for a, b in combinations("abcdef", 2)])
    f = S.best_first(q, S.LexicalJudge(q), DELETE, 0, max_cost=50, max_calls=10)
    assert f.ops is None and f.calls == 11


def test_correction_adds_what_is_missing():
    q = question([("a", "b")], needs={"a", "n"}, grow={"a": [("n", "")], "b": [("m", "")]})
    f = S.best_first(q, S.LexicalJudge(q), (*DELETE, "add_node", "add_edge"), 1)
    assert f.ops == [("add_node", "n", None, None), ("add_edge", None, "a", "n")] and f.cost == 2
    bounded = S.best_first(q, S.LexicalJudge(q), (*DELETE, "add_node", "add_edge"), 1, psp_k=2, refine_hits=False, incumbent=True)
    assert bounded.cost == 2


def test_nulls_and_empty_rows(spark):
    rows = [(1, None, None, None), (2, [], [], []), (3, [None, ""], [(None, "x", None, None, None)], ["x"])]
    df = spark.createDataFrame(rows, "exp_id long, entities array<string>, relations array<struct<src:string,tgt:string,keywords:string,description:string,weight:double>>, needs array<string>")
    out = S.search_all(df, lambda q, j: S.best_first(q, j, DELETE, 0)).collect()
    assert {r.exp_id for r in out} == {1, 2, 3}


def test_additions_reach_the_whole_knowledge_graph(spark):
    far = [("a", f"m{i:02}") for i in range(40)] + [("m39", "n"), ("a", "c")]
    rows = [(i, k, ["a", "c"], [], says, [1.0, 0.0]) for i, k, says in ((1, "g", "m39"), (2, "g", "It is N."), (3, "g", "lone"), (4, None, "a"))]
    q = spark.createDataFrame(rows, "exp_id long, kg_id string, entities array<string>, relations array<struct<src:string,tgt:string,description:string>>, answer string, vec array<double>")
    names = {x for e in far for x in e} | {"lone"}
    nodes = spark.createDataFrame([("g", x, [0.9, 0.1] if x in ("m39", "n") else [0.5, 0.5]) for x in sorted(names)], "kg_id string, name string, vec array<double>")
    edges = spark.createDataFrame([("g", *e) for e in far], "kg_id string, src string, tgt string")
    run = lambda q, j: S.best_first(q, j, ("add_node", "add_edge"), 1, model=2)
    got = {r.exp_id: r for r in S.search_in_graphs(q, nodes, edges, run, together=2).collect()}
    assert got[1].found and [o.node for o in got[1].ops if o.node] == ["m39"]  # one of 41 successors
    assert got[2].found and [o.node for o in got[2].ops if o.node] == ["m39", "n"]  # a successor of an added node
    assert not got[3].found  # needed, but no edge leads to it
    assert len(got) == 4
    link = S.best_first(question([("a", "b")], {"b"}, {"a": [("z", "")]}), Linked(question([])), ("add_edge",), 1)
    assert link.ops == [("add_edge", None, "a", "z")]


def eager(q, judge, hit, max_cost, max_calls, model, tier, blend, anchor_once):
    """The corrective search with every edit of a state put on the heap at once."""
    heap, seen, age, last, anchored = [(0.0, 0, 0.0, 0, 0.0, q.state, [])], set(), 0, 0.0, set()
    sim = lambda v: q.sim.get(v, 0.0)
    while heap:
        *_, cost, state, done = heapq.heappop(heap)
        last = cost
        if cost > max_cost or judge.calls > max_calls:
            break
        if state in seen:
            continue
        seen.add(state)
        if done and judge(state) == hit:
            return S.Found(done, cost, state, judge.calls)
        edits = [([("delete_node", v, None, None)], c, sim(v), s) for v in sorted(state.nodes & q.state.nodes) for s, c in [state.without_node(v)]]
        edits += [([("delete_edge", None, a, b)], c, max(sim(a), sim(b)), s) for a, b, _ in sorted(state.edges) if (a, b) in {e[:2] for e in q.state.edges} for s, c in [state.without_edge((a, b))]]
        edits = [e for e in edits if e[3] not in seen]
        for a in sorted(state.nodes):
            if anchor_once and a in anchored:
                continue
            anchored.add(a)
            for b, d in q.grow.get(a, ()):
                node, edge = (2 - sim(b), 2 - max(sim(a), sim(b))) if model == 2 else (1.0, 1.0)
                add, child = ("add_edge", None, a, b), state.with_edge(a, b, d)
                if b not in state.nodes:
                    edits.append(([("add_node", b, None, None), add], node + edge, sim(b), child))
                elif (a, b) not in {e[:2] for e in state.edges}:
                    edits.append(([add], edge, sim(b), child))
        for rows, more, order, child in edits:
            total, added = cost + more, rows[-1][0] == "add_edge"
            first = total if not added else tier * (total // tier) if tier else total - blend * order
            age += 1
            heapq.heappush(heap, (first, len(done) + 1, -order if added else order, age, total, child, [*done, *rows]))
    return S.Found(None, last, None, judge.calls)


LETTERS = st.sampled_from("abcdef")
EDGES = st.lists(st.tuples(LETTERS, LETTERS), min_size=1, max_size=8, unique=True)


@settings(max_examples=150, deadline=None)
@given(EDGES, EDGES, st.dictionaries(LETTERS, st.sampled_from([-0.5, 0.25, 0.5, 0.75, 1.0])), st.sets(LETTERS, max_size=3), st.sampled_from([(2, 0.5, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (3, 0.0, 0.4)]), st.booleans(), st.sampled_from([5, 60]))
def test_edits_made_when_due_are_those_made_at_once(edges, more, sim, needs, order, once, calls):
    grow = {}
    for a, b in more:
        grow.setdefault(a, []).append((b, ""))
    q = question(edges, needs, grow, sim)
    want = eager(q, S.LexicalJudge(q), 1, 20, calls, *order, once)
    model, tier, blend = order
    assert S.best_first(q, S.LexicalJudge(q), (*DELETE, "add_node", "add_edge"), 1, 20, calls, model=model, tier=tier, blend=blend, anchor_once=once) == want


def pushes(monkeypatch, **how):
    """Entries that a search without a hit puts on its heap, where a node has 3000 successors, and its result."""
    count, push = [0], heapq.heappush

    def counted(heap, entry):
        count[0] += 1
        push(heap, entry)

    monkeypatch.setattr(heapq, "heappush", counted)
    q = question([("a", "b")], {"none"}, {"a": [(f"n{i}", "") for i in range(3000)]}, {f"n{i}": i / 3000 for i in range(3000)})
    found = S.best_first(q, S.LexicalJudge(q), (*DELETE, "add_node", "add_edge"), 1, max_cost=20, max_calls=200, **how)
    return count[0], found


def test_correction_makes_additions_when_they_are_due(monkeypatch):
    n, found = pushes(monkeypatch, model=2, tier=0.5)
    assert found.ops is None and found.calls == 201 and n < 3000


def test_bounded_correction_makes_additions_when_they_are_due(monkeypatch):
    n, found = pushes(monkeypatch, psp_k=5, refine_hits=False, incumbent=True)
    assert found.ops is None and found.calls == 201 and n < 3000


def test_names_in_an_answer():
    names = ["Ab", "b c", "C", "!", "zz", *(f"other {i}" for i in range(500))]
    g = S.Graph([], {v: S.np.zeros(2) for v in names})
    few = S.Graph([], {v: S.np.zeros(2) for v in names[:5]})
    for said in ("xab c", "", "other 41", "c"):
        want = {v for v in names if S.plain_words(v) and S.plain_words(v) in said}
        assert g.said_in(said) == want and few.said_in(said) == want & set(names[:5])


def test_vectors_that_are_null_have_no_similarity():
    null = S.np.asarray(None, float)
    for vectors, sims in (({"b": null, "c": S.np.array([1.0, 0.5]), "d": S.np.array([1.0, float("nan")])}, [1.0, 0.0, 0.0]), ({"b": null, "c": null}, [0.0, 0.0]), ({}, [])):
        g = S.Graph([("a", x) for x in "bcd"], vectors)
        for vector, want in (([1.0, 0.0], sims), (None, [0.0] * len(sims)), ([1.0, float("nan")], [0.0] * len(sims))):
            s = S.Similarities({}, g, vector)
            assert s.ranked("a")[0] == want and s.most >= max([0.0, *want]) and sorted(map(s.get, vectors)) == sorted(want)


def test_copies_of_graphs_are_bounded_by_the_questions(spark):
    """40 questions, two together, have at most 32 rows each of a graph of 640: two copies instead of 20."""
    q = spark.createDataFrame([(i, "g", ["n0"], [], "n1", [1.0]) for i in range(40)], "exp_id long, kg_id string, entities array<string>, relations array<struct<src:string,tgt:string,description:string>>, answer string, vec array<double>")
    nodes = spark.createDataFrame([("g", f"n{i}", [0.5]) for i in range(320)], "kg_id string, name string, vec array<double>")
    edges = spark.createDataFrame([("g", "n0", f"n{i}") for i in range(320)], "kg_id string, src string, tgt string")
    copies = spark.sparkContext.accumulator(0)
    seen = []

    def run(q, j):
        if not any(q.links is x for x in seen):
            seen.append(q.links)
            copies.add(1)
        return S.best_first(q, j, ("add_node", "add_edge"), 1)

    got = S.search_in_graphs(q, nodes, edges, run, together=2).collect()
    assert len(got) == 40 and all(r.found for r in got) and 1 <= copies.value <= 4


class Linked(S.Judge):
    def score(self, state):
        return int(("a", "z", "") in state.edges)


def test_queries_search_with_the_reference_budget(spark, monkeypatch):
    """A flip of cost 9 that takes more than 60 calls, and a question whose tiers would not end."""
    star = [("a", x) for x in "bcde"]
    wide = [(f"v{i}", f"v{i + 1}") for i in range(40)]
    rows = [(i, sorted({x for e in es for x in e}), [(*e, "") for e in es], needs) for i, es, needs in ((1, star, ["a"]), (2, wide, []), (3, wide, ["v20"]))]
    df = spark.createDataFrame(rows, "exp_id long, entities array<string>, relations array<struct<src:string,tgt:string,description:string>>, needs array<string>")
    monkeypatch.setattr(P, "questions", lambda *a: df)
    tiers = {r.exp_id: r for r in P.C.queries["g_search_tiered"](spark, "").collect()}
    assert tiers[1].found and tiers[1].cost == 9 and not tiers[2].found and tiers[3].found
    plain = {r.exp_id: r for r in P.C.queries["g_search_break"](spark, "").collect()}
    assert plain[1].found and plain[1].cost == 9
    assert not plain[2].found and plain[2].calls == 201


def test_searches_take_the_number_of_vectors_from_the_table(spark, sf, tmp_path):
    for p in Path(sf).iterdir():
        if p.name != "embeddings.parquet":
            (tmp_path / p.name).symlink_to(p)
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 20").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert PG.vector_count(spark, str(tmp_path)) == 20
    sims = lambda at: {(r.exp_id, x.name): x.sim for r in P.questions(spark, at, ("ft",), "original").collect() for x in r.sims or []}
    all_vectors, few = sims(sf), sims(str(tmp_path))
    assert all_vectors.keys() == few.keys() and all_vectors != few  # by 500, ids without a vector would be lost

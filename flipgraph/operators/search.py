"""Searches for the cheapest edits that flip an answer.

A question is one row: its context graph, the candidates for additions and what the judge needs. Questions are
independent, so rows are searched in parallel; within a row the search is the exact best-first one. The judge is
pluggable: ``Judge`` classes are built per row from the row's values and count their calls.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipgraph.session import cut

Edge = tuple[str, str]


@dataclass(frozen=True)
class State:
    """A context graph: node names and described edges. Equal graphs are equal states."""

    nodes: frozenset
    edges: frozenset  # of (src, tgt, description)

    def without_node(self, name: str) -> tuple[State, int]:
        """The state without a node, its edges and the neighbours left alone; and what that costs."""
        incident = {e for e in self.edges if name in e[:2]}
        around = {x for s, t, _ in incident for x in (s, t)} - {name}
        kept = self.edges - incident
        used = {x for s, t, _ in kept for x in (s, t)}
        alone = {u for u in around if u not in used}
        cost = 1 + sum(1 + (s == t) for s, t, _ in incident) + len(alone)
        return State(self.nodes - {name} - alone, kept), cost

    def without_edge(self, edge: Edge) -> tuple[State, int]:
        kept = frozenset(e for e in self.edges if e[:2] != edge)
        used = {x for s, t, _ in kept for x in (s, t)}
        alone = [x for x in edge if x not in used]
        return State(self.nodes - set(alone), kept), 1 + len(alone)

    def with_edge(self, src: str, tgt: str, description: str = "") -> State:
        return State(self.nodes | {src, tgt}, self.edges | {(src, tgt, description)})

    def star(self, pivot: str) -> tuple[set, set]:
        """The closed star of a node: it, the neighbours that have no other, and its edges."""
        incident = {e for e in self.edges if pivot in e[:2]}
        around = {x for s, t, _ in incident for x in (s, t)} - {pivot}
        only = {u for u in around if all({s, t} == {u, pivot} for s, t, _ in self.edges if u in (s, t))}
        return {pivot} | only, {e[:2] for e in incident}


DELETIONS = ("delete_node", "delete_edge")


class Links:
    """The places of new nodes in the lists of ``grow``, made for an anchor when asked for."""

    def __init__(self, grow: dict) -> None:
        self.grow, self._at = grow, {}

    def __call__(self, anchor: str) -> dict[str, list[int]]:
        at = self._at.get(anchor)
        if at is None:
            at = self._at[anchor] = {}
            for i, (new, _) in enumerate(self.grow.get(anchor, ())):
                at.setdefault(new, []).append(i)
        return at


@dataclass
class Question:
    state: State
    sim: dict = field(default_factory=dict)  # of nodes to the question; missing ones count 0
    grow: dict = field(default_factory=dict)  # anchor -> [(new node, description)] in the knowledge graph
    needs: frozenset = frozenset()  # what the lexical judge looks for
    known: dict | None = None  # nodes that may be added; None for any
    links: Links | None = None  # of ``grow``, where questions share them

    @cached_property
    def pairs(self) -> set[Edge]:
        return {e[:2] for e in self.state.edges}


class Judge:
    """Scores a state for a question: 1 if the answer given from it agrees with the reference. Counts its calls."""

    def __init__(self, question: Question) -> None:
        self.question, self.calls, self._seen = question, 0, {}

    def __call__(self, state: State) -> int:
        if state not in self._seen:
            self.calls += 1
            self._seen[state] = self.score(state)
        return self._seen[state]

    def score(self, state: State) -> int:
        raise NotImplementedError

    def hopeless(self, hit: int) -> bool:
        """Whether no state at all has the score ``hit``; False where that is not known."""
        return False


class LexicalJudge(Judge):
    """1 if every node that the reference names is in the graph; without such nodes always 1."""

    def score(self, state: State) -> int:
        return int(self.question.needs <= state.nodes)

    def hopeless(self, hit: int) -> bool:
        return hit == 0 and not self.question.needs


@dataclass
class Found:
    ops: list | None  # [(op, node, src, dst)]
    cost: float
    state: State | None
    calls: int


def probe(q: Question, judge: Judge, k: int, hit: int) -> tuple[list, set, set]:
    """Deletes each of the k most similar nodes alone: hits [(pivot, cost, state)] and the stars of the others."""
    pivots = sorted(q.state.nodes, key=lambda v: (-q.sim.get(v, 0.0), v))[:k]
    hits, nodes, edges = [], set(), set()
    for v in pivots:
        state, cost = q.state.without_node(v)
        if judge(state) == hit:
            hits.append((v, cost, state))
        else:
            star, around = q.state.star(v)
            nodes |= star
            edges |= around
    return hits, nodes, edges


def refine(q: Question, judge: Judge, pivot: str, seed_cost: float, seed: State, hit: int, budget: int) -> tuple[list, float, State]:
    """Cheapest flip by deletions within the pivot's star, bounded by the deletion of the pivot itself."""
    nodes, edges = q.state.star(pivot)
    best = ([("delete_node", pivot, None, None)], seed_cost, seed)
    heap, seen, n, calls = [(0, 0, 0, q.state, [])], set(), 0, 0
    while heap and calls < budget:
        cost, _, _, state, ops = heapq.heappop(heap)
        if cost >= best[1]:
            break
        if state in seen:
            continue
        seen.add(state)
        if ops:
            calls += 1
            if judge(state) == hit:
                best = (ops, cost, state)
                continue
        children = [("delete_node", v, None, None, *state.without_node(v)) for v in sorted(nodes & state.nodes)]
        children += [("delete_edge", None, s, t, *state.without_edge((s, t))) for s, t, _ in sorted(state.edges) if (s, t) in edges]
        for op, v, s, t, child, c in children:
            if cost + c < best[1]:
                n += 1
                heapq.heappush(heap, (cost + c, len(ops) + 1, n, child, [*ops, (op, v, s, t)]))
    return best


def plain_words(text: str | None) -> str:
    """As ``functions.text.norm``; empty for null."""
    return " ".join(re.findall("[a-z0-9]+", (text or "").lower()))


class Graph:
    """A knowledge graph: successors and vectors of its nodes; a null vector, or one with a null in it, has no similarity."""

    def __init__(self, edges: Iterable[Edge], vectors: dict[str, np.ndarray | None]) -> None:
        self.vectors = {k: v if v is not None and v.ndim and np.isfinite(v).all() else None for k, v in vectors.items()}
        self.next, self.names, self._near = {}, {}, {}
        for v in vectors:
            if plain := plain_words(v):
                self.names.setdefault(plain, []).append(v)
        self.lengths = sorted({len(x) for x in self.names})
        for s, t in sorted(set(edges)):
            self.next.setdefault(s, []).append((t, ""))
        self.links = Links(self.next)
        self.row = {v: i for i, v in enumerate(vectors)}
        none = np.zeros(next((len(v) for v in self.vectors.values() if v is not None), 0))
        self.matrix = np.array([none if v is None else v for v in self.vectors.values()], float)
        self.longest = math.sqrt((self.matrix * self.matrix).sum(axis=1).max()) if vectors else 0.0

    def said_in(self, text: str) -> set[str]:
        """Nodes whose plain name is part of a plain text: its parts of the names' lengths are looked up."""
        parts = {text[i : i + n] for n in self.lengths if n <= len(text) for i in range(len(text) - n + 1)} if len(text) * len(self.lengths) < len(self.names) else {x for x in self.names if x in text}
        return {v for x in parts for v in self.names.get(x, ())}

    def near(self, anchor: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in the anchor's list of the nodes that have a vector, and their rows in the matrix."""
        if anchor not in self._near:
            at = [(i, self.row[t]) for i, (t, _) in enumerate(self.next[anchor]) if t in self.row]
            self._near[anchor] = tuple(np.array(at, int).reshape(-1, 2).T)
        return self._near[anchor]


class Similarities(dict):
    """Similarities of nodes to a question; those of the knowledge graph's nodes are computed when asked for."""

    def __init__(self, known: dict, graph: Graph, vector) -> None:
        super().__init__(known)
        v = None if vector is None else np.asarray(vector, float)
        self.graph, self.vector = graph, None if v is None or not np.isfinite(v).all() else v
        bound = 0.0 if self.vector is None else graph.longest * float(np.sqrt(self.vector @ self.vector)) * (1 + 1e-12)
        #: No node is more similar; rounded as similarities are.
        self.most = max(0.0, *known.values(), round(bound, 6), float(np.round(bound, 6)))

    def get(self, name: str, default: float = 0.0) -> float:
        if name not in self:
            v = self.graph.vectors.get(name)
            self[name] = default if v is None or self.vector is None else round(float(v @ self.vector), 6)
        return self[name]

    def ranked(self, anchor: str) -> tuple[list[float], list[int]]:
        """As ``_ranked``, with one product for all successors of the anchor."""
        places, rows = self.graph.near(anchor)
        sims = np.zeros(len(rows)) if self.vector is None or not self.graph.longest else np.round(self.graph.matrix[rows] @ self.vector, 6)
        order = np.argsort(-sims, kind="stable")
        return sims[order].tolist(), places[order].tolist()


def _ranked(q: Question, anchor: str) -> tuple[list[float], list[int]]:
    """Similarities and places in ``grow`` of the nodes that may be added at an anchor, most similar first, then by place."""
    if isinstance(q.sim, Similarities) and q.known is q.sim.graph.vectors and q.grow is q.sim.graph.next:
        return q.sim.ranked(anchor)
    order = sorted((-q.sim.get(new, 0.0), i) for i, (new, _) in enumerate(q.grow[anchor]) if q.known is None or new in q.known)
    return [-s for s, _ in order], [i for _, i in order]


def _deletions(q: Question, state: State, ops: tuple[str, ...], pruned: tuple[set, set], sign: int):
    """(op row, added cost, order of similarity) of every deletion that the search may try next; ``without`` makes its state.

    The costs are those of ``without_node`` and ``without_edge``, from one count of the edges at each node and pair.
    """
    sim = q.sim.get
    at: dict[str, int] = dict.fromkeys(state.nodes, 0)
    cost: dict[str, int] = dict.fromkeys(state.nodes, 1)  # of a node: it, its edges, loops twice, and the neighbours left alone
    pairs: dict[Edge, int] = {}
    same: dict[Edge, int] = {}
    for s, t, _ in state.edges:
        same[s, t] = same.get((s, t), 0) + 1
        at[s] += 1
        if s == t:
            cost[s] += 2
        else:
            at[t] += 1
            cost[s] += 1
            cost[t] += 1
            pair = (s, t) if s < t else (t, s)
            pairs[pair] = pairs.get(pair, 0) + 1
    for (a, b), n in pairs.items():
        cost[a] += at[b] == n
        cost[b] += at[a] == n
    if "delete_node" in ops:
        for v in sorted(state.nodes & q.state.nodes):
            if v not in pruned[0]:
                yield ("delete_node", v, None, None), cost[v], sign * sim(v, 0.0)
    if "delete_edge" in ops:
        for s, t, _ in sorted(state.edges):
            if (s, t) in q.pairs and (s, t) not in pruned[1] and s not in pruned[0] and t not in pruned[0]:
                n = same[s, t]
                yield ("delete_edge", None, s, t), 1 + (at[s] == n) + (at[t] == n), sign * max(sim(s, 0.0), sim(t, 0.0))


def without(state: State, row: tuple) -> State:
    op, node, src, tgt = row
    return (state.without_node(node) if op == "delete_node" else state.without_edge((src, tgt)))[0]


class Additions:
    """The additions of all expanded states, put on the heap in the order of their keys when they are due.

    At one anchor the keys of all nodes that may be added rise as their similarity falls, in every state, so a question
    ranks an anchor's list once and the heap holds the next of each. Before any is due, a state's new nodes are one entry
    below all of them: its key takes the highest similarity there can be.
    """

    def __init__(self, q: Question, heap: list, ops: tuple[str, ...], model: int, tier: float, blend: float) -> None:
        self.q, self.heap, self.ops, self.model, self.tier, self.blend = q, heap, ops, model, tier, blend
        self.links = q.links or Links(q.grow)
        self.most = q.sim.most if isinstance(q.sim, Similarities) else max(0.0, *q.sim.values(), 0.0)
        self.rankings: dict[str, tuple[list, list]] = {}

    def least(self, cost: float) -> float:
        """No addition to a state of this cost comes before it."""
        total = cost + self._edge(self.most, self.most)
        return self.tier * (total // self.tier) if self.tier else total - self.blend * self.most

    def _push(self, of: tuple, at: tuple, more: float, sim: float, child: tuple) -> None:
        cost, steps, age = of[:3]
        total = cost + more
        first = self.tier * (total // self.tier) if self.tier else total - self.blend * sim
        heapq.heappush(self.heap, (first, steps, -sim, age, at, total, child, of))

    def _edge(self, a: float, b: float) -> float:
        return (2 - max(a, b)) if self.model == 2 else 1.0

    def _node(self, a: float, b: float) -> float:
        return ((2 - b) if self.model == 2 else 1.0) + self._edge(a, b)

    def of(self, cost: float, steps: int, age: int, state: State, done: list, anchors: list[str]) -> None:
        """All additions at ``anchors`` of the state that is expanded at the given cost and age."""
        of = (cost, steps, age, state, done, anchors)
        if "add_edge" in self.ops:
            there = {e[:2] for e in state.edges}
            for rank, anchor in enumerate(anchors):
                at = self.links(anchor)
                for new in at.keys() & state.nodes:
                    if (anchor, new) not in there:
                        sim = self.q.sim.get(new, 0.0)
                        for i in at[new]:
                            self._push(of, (1, rank, i), self._edge(self.q.sim.get(anchor, 0.0), sim), sim, (None, anchor, i, True))
        if "add_node" in self.ops and anchors:
            self._push(of, (1, -1, -1), self._node(self.most, self.most), self.most, None)

    def due(self, of: tuple) -> None:
        """The entry below a state's new nodes is reached: the first of each anchor take its place."""
        for rank, anchor in enumerate(of[5]):
            if anchor not in self.rankings:
                self.rankings[anchor] = _ranked(self.q, anchor)
            self.next(of, rank, anchor, 0)

    def next(self, of: tuple, rank: int, anchor: str, j: int) -> None:
        sims, places = self.rankings[anchor]
        near, nodes = self.q.grow[anchor], of[3].nodes
        while j < len(places) and near[places[j]][0] in nodes:
            j += 1
        if j < len(places):
            self._push(of, (1, rank, places[j]), self._node(self.q.sim.get(anchor, 0.0), sims[j]), sims[j], (rank, anchor, j, False))

    def take(self, of: tuple, child: tuple) -> tuple[State, list]:
        """The state of a popped addition and the edits that lead to it; the anchor's next addition becomes an entry."""
        rank, anchor, at, present = child
        new, description = self.q.grow[anchor][at if present else self.rankings[anchor][1][at]]
        rows = [("add_edge", None, anchor, new)]
        if not present:
            rows = [("add_node", new, None, None), *rows]
            self.next(of, rank, anchor, at + 1)
        return of[3].with_edge(anchor, new, description), [*of[4], *rows]


def best_first(
    q: Question, judge: Judge, ops: tuple[str, ...], hit: int, max_cost: float = 20, max_calls: int = 200, psp_k: int = 0, refine_hits: bool = True,
    incumbent: bool = False, model: int = 3, tier: float = 0.0, blend: float = 0.0, anchor_once: bool = False,
) -> Found:
    """States in order of cost, then number of edits, then similarity, then age; the first that flips wins.

    hit: the score that counts as a flip, 0 for breaking an answer and 1 for correcting one. The first state is
    expanded but not judged. The budget is exceeded by one call at most. psp_k: probe that many pivots first; if
    ``refine_hits`` a hit is refined within its star and ends the search, if ``incumbent`` the cheapest hit
    bounds the search instead; stars without a hit are left out of it. tier and blend (0 at least) order additions by the
    floor of their cost, or by cost less a share of similarity. anchor_once: a node is a place to add at only
    in the first state that holds it.
    """
    pruned: tuple[set, set] = (set(), set())
    best: Found | None = None
    if psp_k and "delete_node" in ops:
        hits, *stars = probe(q, judge, psp_k, hit)
        pruned = (stars[0], stars[1])
        if hits and refine_hits:
            results = [refine(q, judge, v, c, s, hit, max(8, 2 * psp_k)) for v, c, s in hits]
            op, cost, state = min(results, key=lambda r: r[1])
            return Found(op, cost, state, judge.calls)
        if hits and incumbent:
            v, c, s = min(hits, key=lambda h: h[1])
            best = Found([("delete_node", v, None, None)], c, s, judge.calls)
    sign = -1 if hit == 0 else 1
    # (order of cost, edits, order of similarity, age of the expansion and place in it, cost, edit, what it comes from). States are
    # built once they are reached, and the edits of a state are one entry below all of them until they are due.
    heap: list = [(0.0, 0, 0.0, 0, (), 0.0, q.state, [])]
    seen, age, last, anchored = {}, 0, 0.0, set()  # states and the age at which they were expanded
    additions = Additions(q, heap, ops, model, tier, blend) if "add_node" in ops or "add_edge" in ops else None
    bound = min(max_cost, best.cost) if best else max_cost
    while heap:
        _, steps, _, made, _, cost, child, done = heapq.heappop(heap)
        if child is None:
            additions.due(done)
            continue
        if child == ():
            state, done, anchors = done
            for i, (row, more, order) in enumerate(_deletions(q, state, ops, pruned, sign)):
                heapq.heappush(heap, (cost + more, steps, order, made, (0, i), cost + more, row, (state, done)))
            if additions:
                additions.of(cost, steps, made, state, done, anchors)
            continue
        if made and child[0] in DELETIONS:
            state, done = without(done[0], child), [*done[1], child]
            if seen.get(state, made) < made:  # it was known when its parent was expanded
                continue
        last = cost
        if cost > bound or judge.calls > max_calls:
            break
        if not made:
            state = child
        elif child[0] not in DELETIONS:
            state, done = additions.take(done, child)
        if state in seen:
            continue
        if done and judge(state) == hit:
            if best is None or cost <= best.cost:
                best = Found(done, cost, state, judge.calls)
            break
        seen[state] = age
        age += 1
        anchors = [v for v in sorted(state.nodes) if v not in anchored and v in q.grow] if additions else []
        if anchor_once:
            anchored |= state.nodes
        least = min(cost + 1, additions.least(cost)) if additions else cost + 1
        heapq.heappush(heap, (least, len(done) + 1, -math.inf, age, (), cost, (), (state, done, anchors)))
    if best:
        return Found(best.ops, best.cost, best.state, judge.calls)
    return Found(None, last, None, judge.calls)


def single_edit(q: Question, judge: Judge, kind: str, hit: int) -> Found:
    """The first single deletion of a node, or of an edge, in the order of names, that flips."""
    if kind == "node":
        tries = ((("delete_node", v, None, None), *q.state.without_node(v)) for v in sorted(q.state.nodes))
    else:
        tries = ((("delete_edge", None, s, t), *q.state.without_edge((s, t))) for s, t, _ in sorted(q.state.edges))
    for op, state, cost in tries:
        if judge(state) == hit:
            return Found([op], cost, state, judge.calls)
    return Found(None, 0.0, None, judge.calls)


def question_of(row: dict) -> Question:
    """From a row of (entities, relations, sims, grow, needs); nulls and empty names count as absent."""
    edges: dict[Edge, str] = {}
    for r in row.get("relations") if row.get("relations") is not None else ():
        if r["src"] and r["tgt"]:
            edges[(r["src"], r["tgt"])] = r["description"] or ""
    names = {e for e in (row["entities"] if row.get("entities") is not None else ()) if e} | {x for e in edges for x in e}
    sims = {x["name"]: x["sim"] for x in (row["sims"] if row.get("sims") is not None else ())}
    grow: dict[str, list] = {}
    for g in row["grow"] if row.get("grow") is not None else ():
        grow.setdefault(g["anchor"], []).append((g["name"], ""))
    for v in grow.values():
        v.sort()
    needs = frozenset(x for x in (row["needs"] if row.get("needs") is not None else ()) if x)
    return Question(State(frozenset(names), frozenset((s, t, d) for (s, t), d in edges.items())), sims, grow, needs)


SEARCHED = "exp_id long, found boolean, cost double, calls long, ops array<struct<op:string,node:string,src:string,dst:string>>, nodes array<string>"


def _found(row: dict, q: Question, run: Callable[[Question, Judge], Found], judge: type[Judge]) -> tuple:
    f = run(q, judge(q))
    return (row["exp_id"], f.ops is not None, float(f.cost), f.calls, [dict(zip(("op", "node", "src", "dst"), o, strict=True)) for o in f.ops or []], sorted(f.state.nodes) if f.state else None)


def search_all(questions: DataFrame, run: Callable[[Question, Judge], Found], judge: type[Judge] = LexicalJudge) -> DataFrame:
    """Runs ``run`` on each row of ``questions`` (exp_id, entities, relations, and optionally sims, grow, needs)."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [_found(row, question_of(row), run, judge) for row in frame.to_dict("records")]
            yield pd.DataFrame(out, columns=["exp_id", "found", "cost", "calls", "ops", "nodes"])

    return questions.mapInPandas(part, SEARCHED)


#: Rows of a graph that may be copied for each of its questions.
COPIED = 32


def search_in_graphs(questions: DataFrame, nodes: DataFrame, edges: DataFrame, run: Callable[[Question, Judge], Found], judge: type[Judge] = LexicalJudge, together: int = 500) -> DataFrame:
    """As ``search_all``, where any edge of a question's knowledge graph may be added once its source is in the state.

    questions: (exp_id, kg_id, entities, relations, answer, vec); nodes: (kg_id, name, vec); edges: (kg_id, src, tgt). Only
    ``nodes`` may be added; an edge to a present node may be added in any case. Needed are the nodes of the context and of
    the whole knowledge graph that the answer names. About ``together`` questions share one copy of their graph, so the questions of a hot one are spread;
    of a large graph more share one, so that copies take at most ``COPIED`` of its rows a question beyond the first copy.
    """
    g = nodes.select("kg_id", F.col("name").alias("src"), F.lit(None).cast("string").alias("tgt"), "vec").unionByName(edges.select("kg_id", "src", "tgt", F.lit(None).cast(nodes.schema["vec"].dataType).alias("vec")))
    g = cut(g, "graphs")
    sizes = g.groupBy(F.col("kg_id").alias("of")).agg(F.count("*").alias("size"))
    asked = questions.groupBy("kg_id").agg(F.count("*").alias("asked"))
    parts = asked.join(sizes, asked["kg_id"] == sizes["of"], "left").select("kg_id", F.ceil(F.col("asked") / F.greatest(F.lit(together), F.coalesce("size", F.lit(0)) / COPIED)).cast("int").alias("parts"))
    key = parts.withColumnRenamed("kg_id", "of")
    q = questions.join(key, questions["kg_id"].eqNullSafe(key["of"])).drop("of").withColumn("part", F.expr("pmod(xxhash64(exp_id), parts)").cast("int")).drop("parts")
    g = g.join(parts, "kg_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def part(asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        pairs = graph["tgt"].notna()
        kg = Graph(zip(graph["src"][pairs], graph["tgt"][pairs], strict=True), {n: np.asarray(v, float) for n, v in zip(graph["src"][~pairs], graph["vec"][~pairs], strict=True)}) if len(asked) else None
        out = []
        for row in asked.to_dict("records"):
            question = question_of(row)
            question.grow, question.known, question.links, question.sim = kg.next, kg.vectors, kg.links, Similarities(question.sim, kg, row["vec"])
            said = plain_words(row["answer"])
            question.needs = frozenset(kg.said_in(said) | {v for v in question.state.nodes if (w := plain_words(v)) and w in said})
            out.append(_found(row, question, run, judge))
        return pd.DataFrame(out, columns=["exp_id", "found", "cost", "calls", "ops", "nodes"])

    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # searches are much work on few rows
    return q.repartition(n, "kg_id", "part").groupBy("kg_id", "part").cogroup(g.repartition(n, "kg_id", "part").groupBy("kg_id", "part")).applyInPandas(part, SEARCHED)


def tiered_deletions(questions: DataFrame, max_cost: int = 20, judge: type[Judge] = LexicalJudge, hit: int = 0) -> DataFrame:
    """Deletion search by cost tiers: (exp_id, cost, evaluated), where a flip exists within ``max_cost``.

    Costs of deletions are whole numbers, so all unseen states of the lowest open cost are judged together, a
    batch for an evaluator that answers many prompts at once. The first tier with a flip has the least cost.
    Tiers have no budget of calls, so none is searched where the judge knows that nothing flips.
    """

    def run(q: Question, j: Judge) -> Found:
        tiers: dict[int, dict[State, list]] = {0: {q.state: []}}
        seen: set[State] = set()
        if j.hopeless(hit):
            return Found(None, float(max_cost), None, 0)
        for cost in range(max_cost + 1):
            batch = {s: o for s, o in tiers.pop(cost, {}).items() if s not in seen}
            seen |= batch.keys()
            flips = [(len(o), sorted(s.nodes), o, s) for s, o in batch.items() if o and j(s) == hit]
            if flips:
                _, _, o, s = min(flips, key=lambda f: f[:2])
                return Found(o, cost, s, j.calls)
            for s, o in batch.items():
                for row, more, _ in _deletions(q, s, DELETIONS, (set(), set()), -1):
                    if cost + more <= max_cost and (child := without(s, row)) not in seen:
                        tiers.setdefault(int(cost + more), {}).setdefault(child, [*o, row])
        return Found(None, float(max_cost), None, j.calls)

    return search_all(questions, run, judge)

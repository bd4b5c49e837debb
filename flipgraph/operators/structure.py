"""Structural measures of small graphs, one graph per row: centralities, cut points, paths and edit replays."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from flipgraph.operators.search import State


def successors(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, set] = {v: set() for v in nodes}
    for s, t in edges:
        if s != t:
            out[s].add(t)
    return {v: sorted(ts) for v, ts in out.items()}


def distances(graph: dict[str, list[str]], start: str) -> dict[str, int]:
    seen, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in graph[v]:
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen


def closeness(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, float]:
    """By distances towards the node, scaled by the share of nodes that reach it; 0 if none does."""
    back = successors(nodes, [(t, s) for s, t in edges])
    out = {}
    for v in nodes:
        d = distances(back, v)
        total, reach = sum(d.values()), len(d) - 1
        out[v] = (reach / total) * (reach / (len(nodes) - 1)) if total and len(nodes) > 1 else 0.0
    return out


def betweenness(nodes: list[str], edges: list[tuple[str, str]]) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Shares of shortest paths over each node and each edge, directed and normalised."""
    graph = successors(nodes, edges)
    on_node = dict.fromkeys(nodes, 0.0)
    on_edge = {(s, t): 0.0 for s in nodes for t in graph[s]}
    for source in nodes:
        order, before, paths, dist = [], {v: [] for v in nodes}, dict.fromkeys(nodes, 0), {source: 0}
        paths[source] = 1
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in graph[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                c = paths[v] / paths[w] * (1 + share[w])
                on_edge[(v, w)] += c
                share[v] += c
            if w != source:
                on_node[w] += share[w]
    n = len(nodes)
    node_scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    edge_scale = 1 / (n * (n - 1)) if n > 1 else 1.0
    return {v: x * node_scale for v, x in on_node.items()}, {e: x * edge_scale for e, x in on_edge.items()}


def cut_points(nodes: list[str], edges: list[tuple[str, str]]) -> tuple[set[str], set[tuple[str, str]]]:
    """Nodes and linked pairs (in name order) whose loss splits a part of the undirected graph."""
    graph = successors(nodes, [*edges, *((t, s) for s, t in edges)])
    low: dict[str, int] = {}
    at: dict[str, int] = {}
    points, bridges = set(), set()
    for root in nodes:
        if root in at:
            continue
        at[root] = low[root] = len(at)
        stack = [(root, None, iter(graph[root]))]
        children = 0
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in at:
                    low[v] = min(low[v], at[w])
                else:
                    at[w] = low[w] = len(at)
                    stack.append((w, v, iter(graph[w])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > at[parent]:
                        bridges.add((min(parent, v), max(parent, v)))
                    if parent == root:
                        children += 1
                    elif low[v] >= at[parent]:
                        points.add(parent)
        if children > 1:
            points.add(root)
    return points, bridges


def path_nodes(nodes: list[str], edges: list[tuple[str, str]], ends: list[str]) -> set[str]:
    """Nodes on some shortest path between two of ``ends``, both ways."""
    forth = successors(nodes, edges)
    back = successors(nodes, [(t, s) for s, t in edges])
    from_, to = {v: distances(forth, v) for v in ends}, {v: distances(back, v) for v in ends}
    return {x for a in ends for b in ends if a != b and b in from_[a] for x in nodes if x in from_[a] and x in to[b] and from_[a][x] + to[b][x] == from_[a][b]}


def replay(state: State, ops: list[tuple]) -> tuple[State, int, list[int]]:
    """Applies edits in order: the last state, the summed cost of deletions and each edit's cost.

    Deleting what is gone already costs nothing; an addition is not charged here.
    """
    costs = []
    for op, node, src, dst in ops:
        cost = 0
        if op == "delete_node" and node in state.nodes:
            state, cost = state.without_node(node)
        elif op == "delete_edge" and any(e[:2] == (src, dst) for e in state.edges):
            state, cost = state.without_edge((src, dst))
        elif op == "add_node" and node:
            state = State(state.nodes | {node}, state.edges)
        elif op == "add_edge" and src and dst:
            state = state.with_edge(src, dst)
        costs.append(cost)
    return state, sum(costs), costs


def per_graph(graphs: DataFrame, run: Callable[[object, list[str], list[tuple[str, str]], dict], list[tuple]], schema: str) -> DataFrame:
    """graphs: (exp_id, nodes array, edges array of (src, tgt), ...). Rows that ``run`` makes of each graph."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                edges = [(e["src"], e["tgt"]) for e in (row["edges"] if row["edges"] is not None else ())]
                out.extend(run(row["exp_id"], sorted(row["nodes"]), edges, row))
            yield pd.DataFrame(out, columns=columns)

    return graphs.mapInPandas(part, schema)

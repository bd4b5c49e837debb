"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.functions import text
from flipgraph.functions.vectors import dot
from flipgraph.operators import graph as G
from flipgraph.operators.aggregates import op_operands, rnd
from flipgraph.plans.aggregates import contains_sql
from flipgraph.plans.catalog import Catalog
from flipgraph.session import cut
from flipgraph.sources import records as R
from flipgraph.sources.tables import table

C = Catalog()
K = "exp_id"
#: By how many vectors ids are taken in the SQL twins: all of the table.
VECTORS = "(SELECT coalesce(max(vec_id) + 1, 1) FROM embeddings)"


def cg(s: SparkSession, d: str, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all context graphs; ``once``: written, as operators that read them several times want."""
    if not once:
        return R.cgn_view(s, d), R.cge_view(s, d)
    edges = cut(R.cge_view(s, d), "edges")
    return cut(R.graph_nodes(R.ent_view(s, d), edges), "nodes"), edges


GRAPH = R.with_views("cgn") + """,
deg AS (SELECT n.exp_id, n.name, CAST(count(*) FILTER (e.k = 'i') AS BIGINT) AS n_in, CAST(count(*) FILTER (e.k = 'o') AS BIGINT) AS n_out FROM cgn n
  LEFT JOIN (SELECT exp_id, src AS v, 'o' AS k FROM cge UNION ALL SELECT exp_id, tgt, 'i' FROM cge) e ON e.exp_id = n.exp_id AND e.v = n.name GROUP BY 1, 2),
nb AS (SELECT exp_id, v, u, count(*) AS mult FROM (SELECT exp_id, src AS v, tgt AS u FROM cge WHERE src <> tgt UNION ALL SELECT exp_id, tgt, src FROM cge WHERE src <> tgt) GROUP BY 1, 2, 3),
alone AS (SELECT nb.exp_id, v, u, mult FROM nb JOIN deg ON deg.exp_id = nb.exp_id AND deg.name = nb.u WHERE mult = n_in + n_out),
ncost AS (SELECT deg.exp_id, deg.name, 1 + n_in + n_out + (SELECT count(*) FROM alone a WHERE a.exp_id = deg.exp_id AND a.v = deg.name) AS cost FROM deg),
ecost AS (SELECT c.exp_id, c.src, c.tgt, 1 + CAST(a.n_in + a.n_out = CASE WHEN src = tgt THEN 2 ELSE 1 END AS INT) + CAST(b.n_in + b.n_out = CASE WHEN src = tgt THEN 2 ELSE 1 END AS INT) AS cost
  FROM cge c JOIN deg a ON a.exp_id = c.exp_id AND a.name = c.src JOIN deg b ON b.exp_id = c.exp_id AND b.name = c.tgt)"""


@C.add("g_degree", f"{GRAPH} SELECT exp_id, name, n_in, n_out, n_in + n_out AS degree FROM deg")
def _(s, d):
    return G.degrees(*cg(s, d), K)


@C.add("cost_del_node", f"{GRAPH} SELECT exp_id, name, cost FROM ncost")
def _(s, d):
    return G.node_deletion_costs(*cg(s, d), K)


@C.add("cost_del_edge", f"{GRAPH} SELECT exp_id, src, tgt, cost FROM ecost")
def _(s, d):
    return G.edge_deletion_costs(*cg(s, d), K)


@C.add("cost_uc", f"{GRAPH} SELECT exp_id, name, 1 + n_in + n_out + coalesce((SELECT CAST(sum(mult) AS BIGINT) FROM alone a WHERE a.exp_id = deg.exp_id AND a.v = deg.name), 0) AS cost FROM deg")
def _(s, d):
    return G.node_deletion_costs(*cg(s, d), K, reference_uc=True)


_STARS = f"""{GRAPH}, only_ AS (SELECT exp_id, v AS u FROM nb GROUP BY 1, 2 HAVING count(*) = 1), loops AS (SELECT DISTINCT exp_id, src AS u FROM cge WHERE src = tgt),
stars AS (SELECT exp_id, name AS "pivot", name AS member FROM cgn UNION ALL SELECT nb.exp_id, nb.v, nb.u FROM nb WHERE EXISTS (SELECT 1 FROM only_ o WHERE o.exp_id = nb.exp_id AND o.u = nb.u) AND NOT EXISTS (SELECT 1 FROM loops l WHERE l.exp_id = nb.exp_id AND l.u = nb.u))"""


@C.add("g_closed_star", f"{_STARS} SELECT exp_id, \"pivot\", member FROM stars")
def _(s, d):
    return G.closed_stars(*cg(s, d), K)


@C.add("g_state_key", R.with_views("cgn") + """, n AS (SELECT exp_id, array_to_string(list_sort(list(DISTINCT name)), chr(31)) AS ns FROM cgn GROUP BY 1), e AS (SELECT exp_id, array_to_string(list_sort(list(DISTINCT src || chr(31) || tgt || chr(31) || description)), chr(30)) AS es FROM cge GROUP BY 1)
 SELECT exp_id, sha256(ns || chr(29) || coalesce(es, '')) AS state FROM n LEFT JOIN e USING (exp_id)""")
def _(s, d):
    return G.state_keys(*cg(s, d, False), K)


def first_ops(s: SparkSession, d: str, op: str) -> DataFrame:
    """The first edit of found records, where it is an ``op``."""
    return R.ops_view(s, d).where((F.col("seq") == 0) & (F.col("op") == op) & F.col("found"))


_FIRST = f"{GRAPH}, {R.CTE['ops']}, f AS (SELECT exp_id, op, node, src, dst FROM ops WHERE seq = 0 AND found)"


@C.add("g_delete_node", f"""{_FIRST}, g AS (SELECT exp_id, node FROM f WHERE op = 'delete_node'), lost AS (SELECT exp_id, node AS name FROM g UNION SELECT a.exp_id, a.u FROM alone a JOIN g ON g.exp_id = a.exp_id AND g.node = a.v),
 kept AS (SELECT n.exp_id, n.name FROM cgn n WHERE n.exp_id IN (SELECT exp_id FROM g) AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.exp_id = n.exp_id AND l.name = n.name)) SELECT exp_id, name FROM kept""")
def _(s, d):
    """The nodes left in each graph once the record's first deletion is done."""
    nodes, edges = cg(s, d)
    gone = first_ops(s, d, "delete_node").select(K, F.col("node").alias("name"))
    return G.without_nodes(nodes, edges, gone, K)[0].join(gone.select(K), K, "left_semi").select(K, "name")


@C.add("g_delete_edge", f"""{_FIRST}, g AS (SELECT f.exp_id, f.src, f.dst FROM f JOIN cge c ON c.exp_id = f.exp_id AND c.src = f.src AND c.tgt = f.dst WHERE f.op = 'delete_edge'), kept AS (SELECT c.exp_id, c.src, c.tgt FROM cge c JOIN f ON f.exp_id = c.exp_id AND f.op = 'delete_edge' WHERE NOT (c.src = f.src AND c.tgt = f.dst)),
 ends AS (SELECT exp_id, src AS name FROM g UNION SELECT exp_id, dst FROM g), used AS (SELECT exp_id, src AS name FROM kept UNION SELECT exp_id, tgt FROM kept)
 SELECT n.exp_id, n.name FROM cgn n JOIN f ON f.exp_id = n.exp_id AND f.op = 'delete_edge' WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.exp_id = n.exp_id AND e.name = n.name AND NOT EXISTS (SELECT 1 FROM used u WHERE u.exp_id = e.exp_id AND u.name = e.name))""")
def _(s, d):
    nodes, edges = cg(s, d)
    gone = first_ops(s, d, "delete_edge").select(K, "src", F.col("dst").alias("tgt"))
    return G.without_edges(nodes, edges, gone, K)[0].join(gone.select(K), K, "left_semi").select(K, "name")


@C.add("g_add_node", f"{R.with_views('cgn', 'ops')}, a AS (SELECT exp_id, node FROM ops WHERE op = 'add_node' AND found) SELECT exp_id, name FROM cgn WHERE exp_id IN (SELECT exp_id FROM a) UNION SELECT exp_id, node FROM a")
def _(s, d):
    nodes, _e = cg(s, d, False)
    a = R.ops_view(s, d).where("op = 'add_node' AND found").select(K, F.col("node").alias("name"))
    return G.with_nodes(nodes.join(a, K, "left_semi"), a, K)


@C.add("g_add_edge", f"{R.with_views('cgn', 'ops')}, a AS (SELECT exp_id, src, dst FROM ops WHERE op = 'add_edge' AND found) SELECT exp_id, src, tgt FROM cge WHERE exp_id IN (SELECT exp_id FROM a) UNION SELECT exp_id, src, dst FROM a")
def _(s, d):
    _n, edges = cg(s, d, False)
    a = R.ops_view(s, d).where("op = 'add_edge' AND found").select(K, "src", F.col("dst").alias("tgt"))
    return G.with_edges(edges.join(a, K, "left_semi"), a, K)


@C.add("join_neighbors", f"{R.with_views('cgn', 'kge')} SELECT DISTINCT n.exp_id, n.kg_id, n.name AS anchor, e.tgt AS name FROM cgn n JOIN kge e ON e.kg_id = n.kg_id AND e.src = n.name WHERE NOT EXISTS (SELECT 1 FROM cgn m WHERE m.exp_id = n.exp_id AND m.name = e.tgt)")
def kg_frontier(s, d):
    nodes, edges = cg(s, d)
    return G.frontier(nodes, edges.groupBy("kg_id", "src", "tgt").agg(F.count("*").alias("n")), K)


@C.add("join_induced", f"{R.with_views('cgn', 'kge')} SELECT DISTINCT a.exp_id, a.kg_id, e.src, e.tgt FROM cgn a JOIN kge e ON e.kg_id = a.kg_id AND e.src = a.name JOIN cgn b ON b.exp_id = a.exp_id AND b.name = e.tgt")
def _(s, d):
    return G.induced(R.cgn_view(s, d), R.kge_view(s, d), K)


_SEEDS = f"{R.with_views('kge', 'ops')}, seeds AS (SELECT DISTINCT exp_id, kg_id, name FROM (SELECT exp_id, kg_id, unnest([node, src, dst]) AS name FROM ops WHERE found AND op = 'delete_node') WHERE name <> '')"


def deleted_seeds(s: SparkSession, d: str) -> DataFrame:
    return op_operands(R.ops_view(s, d).where("found AND op = 'delete_node'")).select(K, "kg_id", F.col("operand").alias("name")).distinct()


_SYM = "sym AS (SELECT DISTINCT kg_id, a, b FROM (SELECT kg_id, src AS a, tgt AS b FROM kge UNION ALL SELECT kg_id, tgt, src FROM kge))"
_BALL = f"""{_SEEDS}, {_SYM}, h1 AS (SELECT DISTINCT s.exp_id, s.kg_id, y.b AS name FROM seeds s JOIN sym y ON y.kg_id = s.kg_id AND y.a = s.name), n1 AS (SELECT * FROM h1 WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.exp_id = h1.exp_id AND s.name = h1.name)),
h2 AS (SELECT DISTINCT n.exp_id, n.kg_id, y.b AS name FROM n1 n JOIN sym y ON y.kg_id = n.kg_id AND y.a = n.name), n2 AS (SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.exp_id = h2.exp_id AND s.name = h2.name) AND NOT EXISTS (SELECT 1 FROM n1 WHERE n1.exp_id = h2.exp_id AND n1.name = h2.name)),
ball AS (SELECT exp_id, kg_id, name, 0 AS hop FROM seeds UNION ALL SELECT *, 1 FROM n1 UNION ALL SELECT *, 2 FROM n2)"""


@C.add("g_khop", f"{_BALL} SELECT exp_id, kg_id, name, hop FROM ball")
def ball(s, d):
    return G.khop(deleted_seeds(s, d), R.kge_view(s, d), K, 2)


@C.add("set_khop_union", f"{_BALL} SELECT kg_id, name, count(*) AS n FROM ball GROUP BY 1, 2")
def _(s, d):
    return ball(s, d).groupBy("kg_id", "name").agg(F.count("*").alias("n"))


@C.add("g_bfs", f"""{R.with_views('ent', 'kge')}, s0 AS (SELECT exp_id, kg_id, name FROM ent WHERE pos = 0 AND name <> ''), h1 AS (SELECT DISTINCT s.exp_id, s.kg_id, e.tgt AS name FROM s0 s JOIN kge e ON e.kg_id = s.kg_id AND e.src = s.name WHERE e.tgt <> s.name),
 h2 AS (SELECT DISTINCT n.exp_id, n.kg_id, e.tgt AS name FROM h1 n JOIN kge e ON e.kg_id = n.kg_id AND e.src = n.name), n2 AS (SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM s0 s WHERE s.exp_id = h2.exp_id AND s.name = h2.name) AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.exp_id = h2.exp_id AND h1.name = h2.name))
 SELECT exp_id, kg_id, name, 0 AS hop FROM s0 UNION ALL SELECT exp_id, kg_id, name, 1 FROM h1 UNION ALL SELECT exp_id, kg_id, name, 2 FROM n2""")
def _(s, d):
    """Breadth-first search along edges, two steps from each record's first entity."""
    seeds = R.ent_view(s, d).where("pos = 0 AND name <> ''").select(K, "kg_id", "name")
    return G.khop(seeds, R.kge_view(s, d), K, 2, directed=True)


_PAGERANK = R.with_views("kge").replace("WITH ", "WITH RECURSIVE ", 1) + """, kn AS (SELECT kg_id, name FROM (SELECT DISTINCT kg_id, src AS name FROM kge UNION SELECT DISTINCT kg_id, tgt FROM kge)), sz AS (SELECT kg_id, count(*) AS n FROM kn GROUP BY 1), od AS (SELECT kg_id, src AS name, count(*) AS o FROM kge GROUP BY 1, 2),
 b AS MATERIALIZED (SELECT kg_id, name, n, o FROM kn JOIN sz USING (kg_id) LEFT JOIN od USING (kg_id, name)), ke AS MATERIALIZED (SELECT kg_id, src, tgt FROM kge),
 pr AS (SELECT kg_id, name, n, o, 1.0e0 / n AS r, 0 AS round, false AS done FROM b UNION ALL
 SELECT kg_id, name, n, o, new, round + 1, sum(abs(new - r)) OVER (PARTITION BY kg_id) < 1e-6 * n FROM (SELECT p.kg_id, p.name, p.n, p.o, p.r, p.round, 0.15e0 / p.n + 0.85e0 * (coalesce(f.f, 0.0e0) + i.d / p.n) AS new FROM pr p LEFT JOIN (SELECT q.kg_id, e.tgt AS name, sum(q.r / q.o) AS f FROM pr q JOIN ke e ON e.kg_id = q.kg_id AND e.src = q.name WHERE NOT q.done GROUP BY 1, 2) f ON f.kg_id = p.kg_id AND f.name = p.name
 JOIN (SELECT kg_id, sum(CASE WHEN o IS NULL THEN r ELSE 0.0e0 END) AS d FROM pr WHERE NOT done GROUP BY 1) i ON i.kg_id = p.kg_id WHERE NOT p.done AND p.round < 100))
 SELECT kg_id, name, round(arg_max(CASE WHEN done THEN r ELSE 0.0e0 END, round), 8) AS rank FROM pr GROUP BY 1, 2"""


@C.add("g_pagerank", _PAGERANK)
def _(s, d):
    """Ranks of the knowledge graphs' nodes, each graph iterated until it settles."""
    edges = cut(R.kge_view(s, d), "kg-edges")
    nodes = edges.select("kg_id", F.explode(F.array("src", "tgt")).alias("name")).distinct()
    return G.rounded(G.pagerank(nodes, edges, "kg_id"), "rank", 8)


_PARTS = R.with_views("cgn").replace("WITH ", "WITH RECURSIVE ", 1) + """, se AS MATERIALIZED (SELECT DISTINCT exp_id, a, b FROM (SELECT exp_id, src AS a, tgt AS b FROM cge WHERE src <> tgt UNION ALL SELECT exp_id, tgt, src FROM cge WHERE src <> tgt)), nd AS MATERIALIZED (SELECT exp_id, name FROM cgn),
 re AS (SELECT exp_id, name, name AS c FROM nd UNION SELECT re.exp_id, se.b, re.c FROM re JOIN se ON se.exp_id = re.exp_id AND se.a = re.name), co AS (SELECT exp_id, name, min(c) AS component FROM re GROUP BY 1, 2)"""


@C.add("g_star", f"""{_PARTS}, dg AS (SELECT exp_id, a AS name, count(*) AS deg FROM se GROUP BY 1, 2), pc AS (SELECT co.exp_id, component, count(*) AS n, sum(coalesce(deg, 0)) AS ends, max(coalesce(deg, 0)) AS top FROM co LEFT JOIN dg ON dg.exp_id = co.exp_id AND dg.name = co.name GROUP BY 1, 2)
 SELECT exp_id, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(ends) / 2 AS BIGINT) AS n_edges, count(*) AS n_components, bool_and(ends = 2 * (n - 1) AND top = n - 1) AND count(*) = 1 AS is_star, bool_and(ends = 2 * (n - 1) AND top = n - 1) AS is_star_forest FROM pc GROUP BY 1""")
def _(s, d):
    """Whether a context graph is a star or a forest of stars, with its parts."""
    return G.star_shapes(*cg(s, d), K)


@C.add("g_components", f"{_PARTS} SELECT exp_id, name, component FROM co")
def _(s, d):
    return G.components(*cg(s, d), K)


# ---- Vectors. A node's vector is that of its id modulo the number of vectors, a question's that of its record's id.
def vector_count(s: SparkSession, d: str) -> int:
    """By how many vectors ids are taken, so that the whole table takes part."""
    return table(s, d, "embeddings").agg(F.coalesce(F.max("vec_id") + 1, F.lit(1))).first()[0]


def node_vectors(s: SparkSession, d: str, count: int | None = None) -> DataFrame:
    count = count or vector_count(s, d)
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    return R.kgn_view(s, d).withColumn("vec_id", F.col("node_id") % count).join(v, "vec_id").select("kg_id", "name", "vec", "label")


def similarities(s: SparkSession, d: str, nodes: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """exp_id, name, sim of the context nodes that have a vector."""
    count = count or vector_count(s, d)
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("q"))
    n = (R.cgn_view(s, d) if nodes is None else nodes).join(node_vectors(s, d, count), ["kg_id", "name"]).withColumn("vec_id", F.col(K) % count).join(v, "vec_id")
    return n.select(K, "name", rnd(dot(F.col("vec"), F.col("q"))).alias("sim"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
VEC = f"""nv AS (SELECT k.kg_id, k.name, e.embedding AS vec, e.label FROM kgn k JOIN embeddings e ON e.vec_id = k.node_id % {VECTORS}),
sims AS (SELECT n.exp_id, n.name, round({DOT.format(a='nv.vec', b='q.embedding')}, 6) AS sim FROM cgn n JOIN nv ON nv.kg_id = n.kg_id AND nv.name = n.name JOIN embeddings q ON q.vec_id = n.exp_id % {VECTORS})"""
_SIM = f"{GRAPH}, {R.CTE['kgn']}, {VEC}"


@C.add("g_sim_index", f"{_SIM} SELECT exp_id, name, sim FROM sims")
def _(s, d):
    return similarities(s, d)


_PIVOTS = f"{_SIM}, pivots AS (SELECT exp_id, name, sim, rn FROM (SELECT n.exp_id, n.name, coalesce(s.sim, 0.0e0) AS sim, CAST(row_number() OVER (PARTITION BY n.exp_id ORDER BY coalesce(s.sim, 0.0e0) DESC, n.name) AS INT) AS rn FROM cgn n LEFT JOIN sims s ON s.exp_id = n.exp_id AND s.name = n.name) WHERE rn <= 5)"


@C.add("topk_pivots", f"{_PIVOTS} SELECT exp_id, name, sim, rn FROM pivots")
def pivots(s, d, nodes=None):
    nodes = R.cgn_view(s, d) if nodes is None else nodes
    return G.top_pivots(nodes, similarities(s, d, nodes), K, 5)


def needed(s: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    """exp_id, name: the context nodes that the original answer names."""
    a = R.exp_view(s, d, F.col("answers.original").alias("answer"))
    return nodes.join(a, K).where(text.norm_contains(F.col("answer"), F.col("name"))).select(K, "name")


_PROBE = f"""{_PIVOTS}, needed AS (SELECT n.exp_id, n.name FROM cgn n JOIN exp x ON x.exp_id = n.exp_id WHERE {contains_sql('x.answers.original', 'n.name')}),
lost AS (SELECT exp_id, name, name AS gone FROM pivots UNION ALL SELECT p.exp_id, p.name, a.u FROM pivots p JOIN alone a ON a.exp_id = p.exp_id AND a.v = p.name),
probed AS (SELECT p.exp_id, p.name, p.rn, c.cost, EXISTS (SELECT 1 FROM lost l JOIN needed n ON n.exp_id = l.exp_id AND n.name = l.gone WHERE l.exp_id = p.exp_id AND l.name = p.name) AS flipped FROM pivots p JOIN ncost c ON c.exp_id = p.exp_id AND c.name = p.name)"""


@C.add("psp_probe_all", f"{_PROBE} SELECT exp_id, name, rn, cost, flipped FROM probed")
def probed(s, d, graph=None):
    nodes, edges = graph or cg(s, d)
    return G.probe(nodes, edges, pivots(s, d, nodes).select(K, "name", "rn"), needed(s, d, nodes), K)


@C.add("g_psp_probe", f"{_PROBE} SELECT exp_id, name AS pivot, cost FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY cost, rn) AS best FROM probed WHERE flipped) WHERE best = 1")
def _(s, d):
    """The flagship query: the cheapest of the five most similar pivots whose deletion flips the answer."""
    return G.cheapest_flip(probed(s, d), K)


_STARSQL = _STARS[len(GRAPH) :]
_PRUNED = f"{_PROBE}{_STARSQL}, pruned AS (SELECT DISTINCT s.exp_id, s.member AS name FROM stars s JOIN probed p ON p.exp_id = s.exp_id AND p.name = s.\"pivot\" WHERE NOT p.flipped)"


@C.add("set_pruned", f"{_PRUNED} SELECT exp_id, name FROM pruned")
def pruned(s, d, graph=None):
    graph = graph or cg(s, d)
    return G.pruned_stars(*graph, probed(s, d, graph), K)


@C.add("g_expand_del", f"""{_PRUNED} SELECT exp_id, 'delete_node' AS op, name AS node, NULL AS src, NULL AS dst, CAST(cost AS BIGINT) AS cost FROM ncost c WHERE NOT EXISTS (SELECT 1 FROM pruned p WHERE p.exp_id = c.exp_id AND p.name = c.name)
 UNION ALL SELECT exp_id, 'delete_edge', NULL, src, tgt, CAST(cost AS BIGINT) FROM ecost c WHERE NOT EXISTS (SELECT 1 FROM pruned p WHERE p.exp_id = c.exp_id AND p.name IN (c.src, c.tgt))""")
def _(s, d):
    graph = cg(s, d)
    return G.deletion_candidates(*graph, cut(pruned(s, d, graph), "pruned"), K)


# Addition candidates: KG successors of a context node, each with the similarities of the new node and its edge.
_ADD = f"""{_SIM}, {R.CTE['kge']}, cand AS (SELECT DISTINCT n.exp_id, n.kg_id, n.name AS anchor, e.tgt AS name FROM cgn n JOIN kge e ON e.kg_id = n.kg_id AND e.src = n.name WHERE NOT EXISTS (SELECT 1 FROM cgn m WHERE m.exp_id = n.exp_id AND m.name = e.tgt)),
cs AS (SELECT c.exp_id, c.anchor, c.name, round({DOT.format(a='nv.vec', b='q.embedding')}, 6) AS sim_node, coalesce(s.sim, 0.0e0) AS sim_edge FROM cand c JOIN nv ON nv.kg_id = c.kg_id AND nv.name = c.name JOIN embeddings q ON q.vec_id = c.exp_id % {VECTORS} LEFT JOIN sims s ON s.exp_id = c.exp_id AND s.name = c.anchor)"""


def additions(s: SparkSession, d: str) -> DataFrame:
    """exp_id, anchor, name, sim_node, sim_edge; an edge has the similarity of its anchor."""
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("q"))
    count = vector_count(s, d)
    c = kg_frontier(s, d).join(node_vectors(s, d, count), ["kg_id", "name"]).withColumn("vec_id", F.col(K) % count).join(v, "vec_id")
    c = c.select(K, "anchor", "name", rnd(dot(F.col("vec"), F.col("q"))).alias("sim_node"))
    e = similarities(s, d, count=count).select(K, F.col("name").alias("anchor"), F.col("sim").alias("sim_edge"))
    return c.join(e, [K, "anchor"], "left").withColumn("sim_edge", F.coalesce("sim_edge", F.lit(0.0)))


@C.add("cost_adm2", f"{_ADD} SELECT exp_id, anchor, name, round((2.0e0 - sim_node) + (2.0e0 - sim_edge), 6) AS cost FROM cs")
def _(s, d):
    return G.rounded(G.addition_costs(additions(s, d).withColumn("kind", F.lit("node")), 2), "cost").select(K, "anchor", "name", "cost")


@C.add("cost_adm3", f"{_ADD} SELECT exp_id, anchor, name, 2.0e0 AS cost FROM cs")
def _(s, d):
    return G.addition_costs(additions(s, d).withColumn("kind", F.lit("node")), 3).select(K, "anchor", "name", "cost")


_NEAR = f"""{_SIM}, {R.CTE['ops']}, added AS (SELECT DISTINCT o.exp_id, o.node AS name, nv.vec FROM ops o JOIN nv ON nv.kg_id = o.kg_id AND nv.name = o.node WHERE o.op = 'add_node' AND o.found), present AS (SELECT n.exp_id, n.name, nv.vec FROM cgn n JOIN nv ON nv.kg_id = n.kg_id AND nv.name = n.name)"""


@C.add("cost_add_node", f"""{_NEAR} SELECT a.exp_id, a.name, round(1.0e0 + min(CASE WHEN p.name <> a.name THEN 1.0e0 - {DOT.format(a='a.vec', b='p.vec')} END), 6) AS cost FROM added a LEFT JOIN present p ON p.exp_id = a.exp_id GROUP BY 1, 2""")
def _(s, d):
    """Distance cost of each node that a record's edits add; its edge is not counted here."""
    nv = node_vectors(s, d)
    a = R.ops_view(s, d).where("op = 'add_node' AND found").select(K, "kg_id", F.col("node").alias("name")).distinct().join(nv, ["kg_id", "name"]).select(K, "name", "vec")
    p = R.cgn_view(s, d).join(nv, ["kg_id", "name"]).select(K, "name", "vec")
    return G.rounded(G.nearest_costs(a, p, K, "name"), "cost")


@C.add("cost_add_edge", f"""{_NEAR}, ev AS (SELECT c.exp_id, c.src || '->' || c.tgt AS name, nv.vec FROM cge c JOIN nv ON nv.kg_id = c.kg_id AND nv.name = c.tgt), ea AS (SELECT DISTINCT o.exp_id, o.src || '->' || o.dst AS name, nv.vec FROM ops o JOIN nv ON nv.kg_id = o.kg_id AND nv.name = o.dst WHERE o.op = 'add_edge' AND o.found)
 SELECT a.exp_id, a.name, round(coalesce(1.0e0 + min(CASE WHEN p.name <> a.name THEN 1.0e0 - {DOT.format(a='a.vec', b='p.vec')} END), 1.0e0), 6) AS cost FROM ea a LEFT JOIN ev p ON p.exp_id = a.exp_id GROUP BY 1, 2""")
def _(s, d):
    """Distance cost of each added edge, an edge having its target's vector; 1 where there is nothing to compare."""
    nv = node_vectors(s, d)
    name = F.concat("src", F.lit("->"), "tgt").alias("edge")
    to = nv.select("kg_id", F.col("name").alias("tgt"), "vec")
    p = R.cge_view(s, d).join(to, ["kg_id", "tgt"]).select(K, name, "vec")
    a = R.ops_view(s, d).where("op = 'add_edge' AND found").select(K, "kg_id", "src", F.col("dst").alias("tgt")).distinct().join(to, ["kg_id", "tgt"]).select(K, name, "vec")
    c = G.nearest_costs(a, p, K, "edge")
    return c.select(K, F.col("edge").alias("name"), rnd(F.coalesce("cost", F.lit(1.0))).alias("cost"))


@C.add("fn_heap_priority", f"{_ADD}, p AS (SELECT exp_id, anchor, name, (2.0e0 - sim_node) + (2.0e0 - sim_edge) AS cost, sim_node FROM cs) SELECT exp_id, anchor, name, round(0.5e0 * floor(cost / 0.5e0), 6) AS tier, round(cost - 0.5e0 * sim_node, 7) AS blend FROM p")
def _(s, d):
    c = G.addition_costs(additions(s, d).withColumn("kind", F.lit("node")), 2)
    return c.select(K, "anchor", "name", rnd(G.priority(F.col("cost"), F.col("sim_node"), "tier", width=0.5)).alias("tier"), rnd(G.priority(F.col("cost"), F.col("sim_node"), "blend"), 7).alias("blend"))


@C.add("g_expand_add", f"{_ADD} SELECT exp_id, anchor, name, round((2.0e0 - sim_node) + (2.0e0 - sim_edge), 6) AS cost, CAST(row_number() OVER (PARTITION BY exp_id ORDER BY round((2.0e0 - sim_node) + (2.0e0 - sim_edge), 6), name, anchor) AS INT) AS place FROM cs")
def _(s, d):
    """All children by addition of a node with its edge, in the order in which a search takes them."""
    from pyspark.sql import Window

    c = G.rounded(G.addition_costs(additions(s, d).withColumn("kind", F.lit("node")), 2), "cost")
    return c.withColumn("place", F.row_number().over(Window.partitionBy(K).orderBy("cost", "name", "anchor"))).select(K, "anchor", "name", "cost", "place")

"""Nearest-neighbour search over vector tables (id, vec): exact in blocks of queries, or by an index of cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flipgraph.functions.vectors import dot
from flipgraph.operators.aggregates import rnd

#: Queries in one block, which travels to every task as a matrix; and the most that an exact search takes.
BLOCK, MOST_QUERIES = 2_000, 100_000
#: Vectors that the cells of an index are fitted on, at most.
FIT_VECTORS = 20_000


def draw_below(wanted: int, total: int) -> int:
    """The 64-bit hash below which about ``wanted`` of ``total`` rows lie; never so low that nothing is drawn."""
    return -(1 << 63) + min((1 << 64) - 1, (max(wanted, 1) << 64) // max(total, 1))


def _top(df: DataFrame, k: int, largest: bool = True) -> DataFrame:
    order = F.desc("sim") if largest else F.asc("sim")
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(order, "id"))).where(F.col("rn") <= k)


def exact_knn(queries: DataFrame, base: DataFrame, k: int, same: str | None = None, itself: bool = True, largest: bool = True, block: int = BLOCK) -> DataFrame:
    """queries: (qid, vec), base: (id, vec). (qid, id, sim, rn): the k base vectors with the largest (or least) product.

    The query set is stated by the caller and goes over all base rows in blocks; each task keeps its own k best per
    query, so few rows are shuffled. same: a column of both sides that must agree. itself: whether id = qid counts.
    Products are rounded to 6 digits before they are ranked; ties by id.
    """
    cols = ["qid", "vec", *([same] if same else [])]
    rows = queries.select(*cols).orderBy("qid").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError("too many queries for an exact search; build an index")
    spark = base.sparkSession
    parts = []
    for at in range(0, len(rows), block):
        some = rows[at : at + block]
        q = spark.sparkContext.broadcast((np.array([r["qid"] for r in some]), np.array([r["vec"] for r in some], np.float64), np.array([r[same] for r in some]) if same else None))

        def best(frames: Iterator[pd.DataFrame], q=q) -> Iterator[pd.DataFrame]:
            ids, m, kind = q.value
            for f in frames:
                if not len(f):
                    continue
                sim = np.round(m @ np.stack(f["vec"].to_numpy()).astype(np.float64).T, 6) + 0.0
                base_ids = f["id"].to_numpy()
                ok = np.ones(sim.shape, bool)
                if kind is not None:
                    ok &= kind[:, None] == f["same"].to_numpy()[None, :]
                if not itself:
                    ok &= ids[:, None] != base_ids[None, :]
                out = []
                for i in range(len(ids)):
                    c = np.flatnonzero(ok[i])
                    c = c[np.lexsort((base_ids[c], -sim[i, c] if largest else sim[i, c]))[:k]]
                    out.append(pd.DataFrame({"qid": ids[i], "id": base_ids[c], "sim": sim[i, c]}))
                yield pd.concat(out, ignore_index=True)

        kinds = "qid long, id long, sim double"
        parts.append(base.select("id", "vec", *([F.col(same).alias("same")] if same else [])).mapInPandas(best, kinds))
    if not parts:
        return spark.createDataFrame([], "qid long, id long, sim double, rn int")
    return _top(reduce(DataFrame.unionByName, parts), k, largest)


def _sample(base: DataFrame) -> tuple[np.ndarray, int]:
    """About FIT_VECTORS vectors drawn by the hash of the id, in the order of ids, and how many the table has."""
    n = base.count()
    sample = base if n <= FIT_VECTORS else base.where(F.xxhash64("id") < F.lit(draw_below(FIT_VECTORS, n)))
    return np.array([r["vec"] for r in sample.select("id", "vec").orderBy("id").limit(2 * FIT_VECTORS).collect()], np.float64), n


def _centres(x: np.ndarray, cells: int, seed: int, rounds: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-10)
    return c


def fit_cells(base: DataFrame, cells: int, seed: int = 0, rounds: int = 20) -> np.ndarray:
    """Centres of an index, by spherical k-means on a bounded sample."""
    return _centres(_sample(base)[0], cells, seed, rounds)


def cells_for(n: int) -> int:
    """How many cells an index of ``n`` vectors has: about the root of n, from 16 to 4096, so that a cell stays small."""
    return int(min(max(16, n**0.5), 4096))


def fit_index(base: DataFrame, k: int = 10, wanted: float = 0.95, seed: int = 0, rounds: int = 20, asked: int = 200) -> tuple[np.ndarray, int]:
    """(centres, probes): an index fitted on a bounded sample, and the fewest cells a query must probe.

    ``asked`` of the sample's vectors are compared with all of it: their k best lie in the probed cells in a share of at
    least ``wanted``. Vectors without clusters need many probes; with all cells probed the search is exact.
    """
    x, n = _sample(base)
    c = _centres(x, cells_for(n), seed, rounds)
    q = x[np.random.default_rng(seed + 1).choice(len(x), min(asked, len(x)), replace=False)]
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    need = np.take_along_axis(place, (x @ c.T).argmax(1)[best], axis=1)  # how many cells come before that of a neighbour
    return c, int(np.sort(need.ravel())[max(0, int(np.ceil(wanted * need.size)) - 1)]) + 1


def assign_cells(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Adds ``cells``: the ``probes`` nearest centres of each vector. Every row of the table is indexed."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # one row per cell

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        sim = np.stack(v.to_numpy()).astype(np.float64) @ shared.value.T if len(v) else np.zeros((0, 1))
        return pd.Series(list(np.argsort(-sim, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return vectors.withColumn("cells", near("vec"))


def index_vectors(base: DataFrame, centres: np.ndarray) -> DataFrame:
    return assign_cells(base, centres).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def cell_knn(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int, probes: int, parts: int = 16) -> DataFrame:
    """(qid, id, sim, rn): the k best among the vectors of the query's nearest cells.

    Cells are split in ``parts`` by hash, so a cell that holds a third of all vectors is searched by several tasks;
    the query rows, which are few, go to each part. With as many probes as cells the result is exact.
    """
    q = assign_cells(queries.select("qid", "vec"), centres, probes).select("qid", F.col("vec").alias("qvec"), F.explode("cells").alias("cell"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    b = indexed.select("id", "vec", "cell", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    sims = b.join(q, ["cell", "part"]).select("qid", "id", "part", rnd(dot(F.col("qvec"), F.col("vec"))).alias("sim"))
    w = Window.partitionBy("qid", "part").orderBy(F.desc("sim"), "id")
    local = sims.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("qid", "id", "sim")
    return _top(local, k)


def nearest_above(queries: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """(qid, id, sim): the nearest other base vector if its product exceeds the threshold, else a null id."""
    best = exact_knn(queries, base, 1, itself=False)
    j = queries.select("qid").join(best, "qid", "left")
    return j.select("qid", F.when(F.col("sim") > threshold, F.col("id")).alias("id"), "sim")


def prune_subgraph(nodes: DataFrame, edges: DataFrame, key: str, k_nodes: int, k_edges: int) -> tuple[DataFrame, DataFrame]:
    """nodes: (key, name, sim), edges: (key, src, tgt, sim). The best nodes and the ends of the best edges; the best edges."""
    top_e = edges.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sim"), "src", "tgt"))).where(F.col("rn") <= k_edges).select(key, "src", "tgt")
    top_n = nodes.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sim"), "name"))).where(F.col("rn") <= k_nodes).select(key, "name")
    ends = top_e.select(key, F.explode(F.array("src", "tgt")).alias("name"))
    return top_n.unionByName(ends).distinct(), top_e

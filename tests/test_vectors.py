import pytest
import numpy as np

from flipgraph.operators import vectors as V


def made(spark, n=2000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")


def test_exact_and_cells(spark):
    x, base = made(spark)
    q = base.where("id % 50 = 0").withColumnRenamed("id", "qid")
    exact = {(r.qid, r.id) for r in V.exact_knn(q, base, 10, block=7).collect()}
    f = x.astype(np.float32).astype(np.float64)
    for i in range(0, 2000, 50):
        sim = np.round(f[i] @ f.T, 6)
        assert {j for a, j in exact if a == i} == set(np.lexsort((np.arange(2000), -sim))[:10].tolist())
    c = V.fit_cells(base, 20)
    indexed = V.index_vectors(base, c)
    assert indexed.count() == 2000
    assert {(r.qid, r.id) for r in V.cell_knn(q, indexed, c, 10, len(c)).collect()} == exact
    some = {(r.qid, r.id) for r in V.cell_knn(q, indexed, c, 10, 5).collect()}
    assert len(some & exact) / len(exact) >= 0.9


def test_one_cell_with_most_rows(spark):
    rows = [(i, [1.0, 0.001 * (i % 7)]) for i in range(900)] + [(1000, [0.0, 1.0])]
    base = spark.createDataFrame(rows, "id long, vec array<float>")
    c = np.array([[1.0, 0.0], [0.0, 1.0]])
    got = V.cell_knn(base.where("id = 1000").withColumnRenamed("id", "qid"), V.index_vectors(base, c), c, 3, 2).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rn)][0] == 1000 and len(got) == 3


def test_sample_is_never_empty():
    for total in (1, 10**6, 10**12, 10**18):
        at = V.draw_below(20_000, total)
        assert -(1 << 63) < at < 1 << 63
        assert (at + (1 << 63)) / (1 << 64) == pytest.approx(min(1.0, 20_000 / total), rel=1e-3)


def test_recall_of_the_index_on_the_table(spark, sf):
    from flipgraph.plans import evaluation as PE

    assert PE.C.queries["topk_knn_recall"](spark, sf).first().recall >= 0.9

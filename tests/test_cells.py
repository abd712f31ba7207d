"""Metric cells: range join, k nearest, Ward and average linkage over cells."""

import numpy as np
import pytest

from bugsift import session
from bugsift.operators import cells
from bugsift.operators.dbscan import dbscan
from bugsift.operators.pairs import Vectors, epsilon_join, kth_neighbor_distance
from bugsift.operators.ward import average_linkage, ward
from tests import naive


def dense(spark, X):
    return Vectors.dense(spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, v array<double>"), "id", "v")


def sparse(spark, X):
    rows = [(i, [int(j) for j in np.flatnonzero(x)], [float(w) for w in x[x != 0]]) for i, x in enumerate(X)]
    return Vectors(spark.createDataFrame(rows, "id long, idx array<int>, w array<double>"), "id", "sparse", X.shape[1], len(X))


def blobs(seed, n=400, dim=3, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-20, 20, size=(centres, dim))
    X = c[rng.integers(0, centres, n)] + rng.normal(0, 0.7, size=(n, dim))
    X[: n // 10] = X[0]                                   # copies
    return X


def distances(X):
    return np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_range_pairs_and_compared_pairs(spark, kind):
    X = blobs(1, n=320)
    if kind == "sparse":
        X = np.where(np.abs(X) > 6, X, 0.0)
    v = dense(spark, X) if kind == "dense" else sparse(spark, X)
    d = distances(X)
    for eps, pivots in ((0.0, 9), (0.8, 20), (100.0, 3), (0.8, 1)) if kind == "dense" else ((0.8, 20), (5.0, 7)):
        session.LOOP_ROUNDS.clear()
        c = cells.assign(v.df, kind, X.shape[1], len(X), n_pivots=pivots)
        got = {(r.i, r.j): r.dist for r in cells.range_pairs(c, eps).collect()}
        want = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if d[i, j] <= eps}
        border = {(i, j) for i, j in set(got) ^ want if abs(d[i, j] - eps) < 1e-9}
        assert set(got) ^ want == border
        assert all(abs(got[p] - d[p]) < 1e-6 for p in set(got) & want)
        if eps < 1 and pivots > 1:
            assert session.LOOP_ROUNDS["range_pairs.compared"] < 0.5 * len(X) ** 2


@pytest.mark.parametrize("pivots", [1, 25])
def test_nearest(spark, pivots):
    X = blobs(2)
    d = distances(X)
    c = cells.assign(dense(spark, X).df, "dense", 3, len(X), n_pivots=pivots)
    for k in (1, 60):
        got = {r.id: [(round(e.dist, 6), e.other) for e in r.near] for r in cells.nearest(c, k).collect()}
        for i in range(len(X)):
            want = sorted((round(d[i, j], 6), j) for j in range(len(X)) if j != i)[:k]
            assert [x for x, _ in got[i]] == pytest.approx([x for x, _ in want], abs=2e-6)
            assert len({j for _, j in got[i]}) == k and i not in {j for _, j in got[i]}


def test_few_rows_and_none(spark):
    assert epsilon_join(dense(spark, np.zeros((1, 2))), 1.0).collect() == []
    assert [r.core_dist for r in kth_neighbor_distance(dense(spark, np.zeros((3, 2))), 3).collect()] == [0.0] * 3
    assert [r.core_dist for r in kth_neighbor_distance(dense(spark, np.zeros((2, 2))), 9).collect()] == [None] * 2
    none = Vectors.dense(spark.createDataFrame([], "id long, v array<double>"), "id", "v")
    assert epsilon_join(none, 1.0).collect() == [] and ward(none, threshold=1.0).collect() == []


def test_dbscan_by_cells(spark):
    X = blobs(3)
    got = {r.id: r.label for r in dbscan(dense(spark, X), 0.6, 1).collect()}
    want = dict(enumerate(naive.dbscan(X, 0.6, 1)))
    assert naive.partition(got) == naive.partition(want)


@pytest.mark.parametrize("pivots,local", [(1, 20), (7, 3)])
def test_ward_with_cells(spark, pivots, local):
    X = blobs(4, n=60, centres=5)
    v = dense(spark, X)
    got = {r.id: r.label for r in ward(v, threshold=4.0, local_clusters=local, n_pivots=pivots).collect()}
    want, _ = naive.ward(X, threshold=4.0)
    assert naive.partition(got) == naive.partition(want)


def test_ward_of_sparse_rows(spark):
    """Centroids stay sparse; the vocabulary may be far wider than any row."""
    rng = np.random.default_rng(6)
    X = np.zeros((30, 40_000))
    for i in range(30):
        own = rng.choice(40, 6, replace=False) * 997 + (i % 4) * 3
        X[i, own] = rng.uniform(0.2, 1, 6)
    X /= np.sqrt((X ** 2).sum(1, keepdims=True))
    X[5] = 0.0
    X[9] = X[8]
    want, _ = naive.ward(X, threshold=1.6)
    got = {r.id: r.label for r in ward(sparse(spark, X), threshold=1.6, local_clusters=2).collect()}
    assert naive.partition(got) == naive.partition(want)


def test_average_linkage_repairs_left_out_pairs(spark):
    """Clusters wider than the table's radius: sums of far pairs are made when needed."""
    rng = np.random.default_rng(9)
    X = np.concatenate([np.sort(rng.uniform(0, 12, 45)), rng.uniform(20, 23, 25)])[:, None]
    X[3] = X[2]
    for t in (2.1, 5.0):
        got = {r.id: r.label for r in average_linkage(dense(spark, X), threshold=t, local_clusters=2).collect()}
        assert naive.partition(got) == naive.partition(naive.average_linkage(X, threshold=t)), t


def test_state_of_a_loop_keeps_its_true_size(spark):
    from pyspark.sql import functions as F
    df = spark.range(500).select("id", F.array_repeat(F.rand(1), 8).alias("v"))
    size = lambda d: int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    df = session.cut_lineage(df)
    first = size(df)
    for _ in range(20):
        old, df = df, session.cut_lineage(df.join(df.select("id"), "id").join(df.groupBy("id").count().select("id"), "id"))
        session.drop_state(old)
    assert df.count() == 500 and first / 3 < size(df) < first * 3

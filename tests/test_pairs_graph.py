import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugsift.operators import features as feat
from bugsift.operators.dbscan import dbscan, dbscan_from_edges
from bugsift.operators.graph import connected_components, minimum_spanning_forest
from bugsift.operators.pairs import Vectors, epsilon_join, kth_neighbor_distance, pairwise_cosine
from tests import naive


def dense(spark, X, ids=None):
    ids = list(range(len(X))) if ids is None else ids
    df = spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, X)], "id long, v array<double>")
    return Vectors.dense(df, "id", "v")


def brute_pairs(X, eps):
    out = set()
    for i in range(len(X)):
        for j in range(i + 1, len(X)):
            if np.linalg.norm(X[i] - X[j]) <= eps:
                out.add((i, j))
    return out


def test_epsilon_join_equals_brute_force_many_blocks(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 5))
    v = dense(spark, X)
    from bugsift.operators import blocks
    old = blocks.MAX_BLOCK_ROWS
    try:
        blocks.MAX_BLOCK_ROWS = 64  # force many block pairs
        got = {(r.i, r.j) for r in epsilon_join(v, 2.0).collect()}
    finally:
        blocks.MAX_BLOCK_ROWS = old
    assert got == brute_pairs(X, 2.0)
    sims = {(r.i, r.j): r.sim for r in pairwise_cosine(v, 0.5).collect()}
    for (i, j), s in sims.items():
        assert s == pytest.approx(X[i] @ X[j] / np.linalg.norm(X[i]) / np.linalg.norm(X[j]))


def test_zero_rows_and_orthogonal_rows(spark):
    d = spark.createDataFrame([(0, "qq"), (1, "rr"), (2, "aa bb"), (3, "cc")], "doc_id long, text string")
    f = feat.fit_transform(d, feat.VectorizerConfig(min_df=1, max_features=3, use_idf=False))
    # vocabulary (top 3 by count, then term): aa, bb, cc -> docs 0 and 1 are zero rows
    v = Vectors.sparse(f)
    assert {(r.i, r.j) for r in epsilon_join(v, 0.5).collect()} == {(0, 1)}
    with pytest.raises(ValueError):
        epsilon_join(v, 1.0)  # zero rows link to everything: refuse to list n^2 pairs
    assert {r.label for r in dbscan(v, 1.0, 2).collect()} == {0}
    # two orthogonal unit rows: distance sqrt(2)
    o = Vectors.sparse(feat.fit_transform(
        spark.createDataFrame([(0, "aa"), (1, "bb")], "doc_id long, text string"),
        feat.VectorizerConfig(use_idf=False)))
    assert epsilon_join(o, 1.41).count() == 0
    with pytest.raises(ValueError):
        epsilon_join(o, 1.42)  # >= sqrt(2): every pair of unit rows
    e142 = dense(spark, np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert [(r.i, r.j) for r in epsilon_join(e142, 1.42).collect()] == [(0, 1)]
    assert epsilon_join(e142, 1.41).count() == 0


def test_kth_neighbor(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(80, 3))
    got = {r.id: r.core_dist for r in kth_neighbor_distance(dense(spark, X), 5).collect()}
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for i in range(80):
        assert got[i] == pytest.approx(np.sort(d[i])[4])
    assert {r.core_dist for r in kth_neighbor_distance(dense(spark, X), 1).collect()} == {0.0}


@pytest.mark.parametrize("parts", [1, 5])
def test_connected_components_vs_naive(spark, parts):
    rng = np.random.default_rng(parts)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, size=(150, 2))] + [(200 + k, 201 + k) for k in range(15)]
    df = spark.createDataFrame(edges, "i long, j long").repartition(parts)
    ids = spark.range(0, 220)
    got = {r.id: r.component for r in connected_components(df, ids).collect()}
    assert got == naive.components(list(range(220)), edges)
    assert connected_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("with_edges", [False, True])
def test_spanning_forest_weight(spark, with_edges, monkeypatch):
    from bugsift.operators import graph
    monkeypatch.setattr(graph, "TAIL_EDGES", 0 if with_edges else 40)
    rng = np.random.default_rng(11)
    X = rng.normal(size=(60, 3))
    v = dense(spark, X)
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    forest = minimum_spanning_forest(v, edges=epsilon_join(v, 1.0) if with_edges else None)
    cand = [(d[i, j], i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 1.0 or not with_edges]
    want, used = naive.kruskal_weight(60, cand)
    rows = forest.collect()
    assert len(rows) == used
    assert sum(r.dist for r in rows) == pytest.approx(want)


def test_tied_weights_give_one_forest(spark, monkeypatch):
    """A 3 x 3 grid has many spanning trees of weight 8; (dist, i, j) picks one,
    whatever the blocks and partitions, and also from an edge list."""
    from bugsift.operators import blocks, graph
    monkeypatch.setattr(graph, "TAIL_EDGES", 5)
    pts = np.array([[x, y] for x in range(3) for y in range(3)], float)
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    parent = list(range(9))

    def find(x):
        return x if parent[x] == x else find(parent[x])
    want = set()
    for w, i, j in sorted((d[i, j], i, j) for i in range(9) for j in range(i + 1, 9)):
        if find(i) != find(j):
            parent[find(j)] = find(i)
            want.add((i, j))
    got = []
    for rows_per_block in (2, 100):
        monkeypatch.setattr(blocks, "plan_blocks", lambda n, *a, k=rows_per_block: max(1, n // k))
        got.append({(r.i, r.j) for r in minimum_spanning_forest(dense(spark, pts)).collect()})
    edges = spark.createDataFrame([(j, i, float(d[i, j])) for i in range(9) for j in range(i + 1, 9)],
                                  "i long, j long, dist double").repartition(4)
    got.append({(r.i, r.j) for r in minimum_spanning_forest(None, edges=edges).collect()})
    assert got == [want] * 3


def test_unnormalised_rows_are_not_taken_for_unit_rows(spark):
    from bugsift.operators.features import VectorizerConfig, fit_transform
    docs = spark.createDataFrame([(1, "aa " * 9), (2, "bb " * 6), (3, "cc " * 3)], "doc_id long, text string")
    v = Vectors.sparse(fit_transform(docs, VectorizerConfig(norm=None, use_idf=False)))
    assert not v.unit_or_zero
    assert len({r.label for r in dbscan(v, 1.5, 1).collect()}) == 3


def test_copies_are_at_distance_zero(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(6, 40))
    X /= np.linalg.norm(X, axis=1)[:, None]
    v = dense(spark, np.vstack([X, X]))
    zero = {(r.i, r.j) for r in epsilon_join(v, 0.5).collect() if r.dist == 0.0}
    assert zero == {(k, k + 6) for k in range(6)}
    forest = minimum_spanning_forest(v).collect()
    assert sum(r.dist == 0.0 for r in forest) == 6


def test_repeated_ids_are_an_error(spark):
    from bugsift.operators.features import VectorizerConfig, fit_transform
    docs = spark.createDataFrame([(1, "aa bb"), (1, "cc dd")], "doc_id long, text string")
    with pytest.raises(ValueError, match="unique"):
        fit_transform(docs, VectorizerConfig())


@pytest.mark.parametrize("eps,ms", [(0.9, 1), (0.9, 2), (1.1, 4), (0.7, 3)])
def test_dbscan_vs_sequential(spark, eps, ms):
    rng = np.random.default_rng(int(eps * 10) + ms)
    X = np.vstack([rng.normal(0, 0.4, (40, 2)), rng.normal(3, 0.4, (40, 2)), rng.uniform(-2, 5, (20, 2))])
    got = {r.id: r.label for r in dbscan(dense(spark, X), eps, ms).collect()}
    want = naive.dbscan(X, eps, ms)
    assert [got[i] for i in range(len(X))] == list(want)


def test_dbscan_border_and_isolated(spark):
    # cores A={0..3} and B={5..8} (min_samples 4); border 4 is next to a core of each
    pts = np.array([[0.0], [0.1], [0.2], [0.3], [1.1], [1.9], [2.0], [2.1], [2.2], [9.0]])
    v = dense(spark, pts)
    lab = {r.id: r.label for r in dbscan(v, 0.85, 4).collect()}
    assert lab[4] == lab[0] == 0 and lab[5] == 1 and lab[9] == -1
    assert list(naive.dbscan(pts, 0.85, 4)) == [lab[i] for i in range(10)]
    assert {r.id: r.label for r in dbscan(v, 0.05, 1).collect()}[9] != -1
    assert {r.id: r.label for r in dbscan(v, 0.05, 2).collect()}[9] == -1


def test_dbscan_from_edges_duplicates(spark):
    ids = spark.range(0, 3)
    e = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.0), (1, 2, 0.0)], "i long, j long, dist double")
    assert {r.label for r in dbscan_from_edges(ids, e, 2).collect()} == {0}


_ = (F, math)


def test_index_join_equals_blocks(spark):
    from bugsift.operators.dbscan import dbscan
    texts = ["aa bb cc", "aa bb", "bb cc dd", "zz", "aa aa bb cc", "dd ee", "ee ff gg", "qq", "aa cc",
             "ff gg", "bb bb bb", "cc dd ee ff"] * 3
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = feat.fit_transform(d, feat.VectorizerConfig(min_df=2, use_idf=True, sublinear_tf=True))
    v = Vectors.sparse(f)
    for eps in (0.3, 0.95):
        blk = {(r.i, r.j): round(r.dist, 9) for r in epsilon_join(v, eps, "blocks").collect()}
        idx = {(r.i, r.j): round(r.dist, 9) for r in epsilon_join(v, eps, "index").collect()}
        assert blk == idx
    for eps, ms in ((0.7, 2), (0.95, 4)):
        if True:
            a = {r.id: r.label for r in dbscan(v, eps, ms, method="blocks").collect()}
            b = {r.id: r.label for r in dbscan(v, eps, ms, method="index").collect()}
            assert a == b


def test_pairwise_cosine_index_path(spark):
    from bugsift.operators import pairs
    texts = ["aa bb cc", "aa bb", "bb cc dd", "zz", "aa aa bb cc", "dd ee", "ee ff gg", "cc dd ee ff"] * 2
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = Vectors.sparse(feat.fit_transform(d, feat.VectorizerConfig(min_df=2)))
    blk = {(r.i, r.j): round(r.sim, 9) for r in pairwise_cosine(v, 0.3).collect()}
    old = pairs.BLOCKS_MAX_WORK
    try:
        pairs.BLOCKS_MAX_WORK = 0  # force the inverted-index path
        idx = {(r.i, r.j): round(r.sim, 9) for r in pairwise_cosine(v, 0.3).collect()}
    finally:
        pairs.BLOCKS_MAX_WORK = old
    assert blk == idx and len(blk) > 5


@pytest.mark.parametrize("ms", [2, 5, 40])
def test_dbscan_with_a_hot_group_of_copies(spark, ms):
    rng = np.random.default_rng(ms)
    X = np.vstack([np.tile([[0.5, 0.5]], (30, 1)), rng.uniform(0, 3, (40, 2)), np.tile([[2.0, 2.0]], (3, 1))])
    got = {r.id: r.label for r in dbscan(dense(spark, X), 0.4, ms).collect()}
    assert [got[i] for i in range(len(X))] == list(naive.dbscan(X, 0.4, ms))

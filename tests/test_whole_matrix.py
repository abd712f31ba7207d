"""pairwise_cosine and similarity_matrix give every pair, negative and small similarities included."""

import numpy as np
import pytest

import __spark_entry__ as E
from bugsift.operators import blocks
from bugsift.operators.pairs import Vectors, pairwise_cosine, similarity_matrix


def _embeddings(spark, folder, n=70):
    x = np.random.default_rng(5).normal(size=(n, 4)).astype(np.float32)
    x[3] = 0.0
    rows = [(int(k) * 2, [float(y) for y in r]) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    norm = np.linalg.norm(x.astype(float), axis=1)
    norm[norm == 0] = 1.0
    u = x.astype(float) / norm[:, None]
    return u @ u.T


def test_queries_return_every_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "TILE_CELLS", 100)      # many tiles in a block
    want = _embeddings(spark, tmp_path)
    n = len(want)
    got = {(r["i"] // 2, r["j"] // 2): r["sim"] for r in E.queries()["pairwise_cosine"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert all(x == pytest.approx(want[k], abs=2e-6) for k, x in got.items())
    full = E.queries()["similarity_matrix"](spark, str(tmp_path)).collect()
    assert len(full) == n * n
    for r in full:
        i, j = r["i"] // 2, r["j"] // 2
        assert r["sim"] == pytest.approx(1.0 if i == j else want[i, j], abs=2e-6)


def test_matrix_passes_over_the_pairs_once(spark):
    v = Vectors.dense(spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "id long, vec array<double>"), "id", "vec")
    plan = similarity_matrix(pairwise_cosine(v), v.with_ids())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") + plan.count("FlatMapGroupsInArrow") == 1, plan

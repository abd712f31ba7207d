"""Property checks: partition-count invariance, relabelling invariance, hooks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bugsift.functions.text import custom_segmenter
from bugsift.operators import features as feat
from bugsift.operators import metrics as M
from bugsift.operators.dbscan import dbscan
from bugsift.operators.pairs import Vectors, pairwise_cosine, similarity_matrix, similarity_matrix_wide
from bugsift.operators.vectors import attach_embeddings, norms
from tests import naive


def test_partition_count_invariance(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            f = feat.fit_transform(d.repartition(int(parts)), feat.VectorizerConfig(min_df=2, max_features=300))
            top = sorted(tuple(r) for r in feat.top_keywords(f.rows, "doc_id", 3)
                         .select("doc_id", "rank", "term", F.round("w", 9)).collect())
            lab = sorted(tuple(r) for r in dbscan(Vectors.sparse(f), 0.8, 2).collect())
            results.append((top, lab))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-1, 4)), min_size=2, max_size=40),
       st.permutations(list(range(6))))
def test_metrics_relabelling_invariant(pairs, perm):
    t = [a for a, _ in pairs]
    p = [b for _, b in pairs]
    relabel = {k: perm[k + 1] * 10 for k in range(-1, 5)}
    want = naive.metrics(t, p)
    again = naive.metrics(t, [relabel[x] for x in p])
    for k in want:
        assert want[k] == pytest.approx(again[k], abs=1e-12)


def test_metrics_relabelling_spark(spark):
    rng = np.random.default_rng(9)
    t = rng.integers(0, 3, 60)
    p = rng.integers(0, 5, 60)
    rows = [("a", str(x), str(y)) for x, y in zip(t, p)] + [("b", str(x), str(y * 7 + 100)) for x, y in zip(t, p)]
    s = {r.method: r for r in M.scores(spark.createDataFrame(rows, "method string, y_true string, y_pred string"))
         .collect()}
    for m in M.METRICS:
        assert s["a"][m] == pytest.approx(s["b"][m], abs=1e-12)


def test_custom_segmenter_and_encoder_hooks(spark):
    df = spark.createDataFrame([(1, "a-b-c"), (2, None)], "id long, t string")
    seg = custom_segmenter(lambda s: s.split("-"))
    got = {r.id: r.s for r in df.select("id", seg("t").alias("s")).collect()}
    assert got == {1: ["a", "b", "c"], 2: None}

    def factory():
        def encode(texts):
            return np.array([[len(t), 0.0, 1.0] for t in texts])
        return encode
    emb = attach_embeddings(df, id_col="id", text_col="t", encoder_factory=factory, dim=3)
    n = {r.id: round(r.norm, 6) for r in norms(emb, "id", "vec").collect()}
    assert n == {1: round(float(np.sqrt(26)), 6), 2: 1.0}


def test_similarity_matrix_wide(spark):
    X = np.array([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    v = Vectors.dense(df, "id", "v")
    long = similarity_matrix(pairwise_cosine(v, 0.1), v.with_ids())
    wide = similarity_matrix_wide(long).collect()
    assert [round(r["1"], 6) for r in wide] == [0.6, 1.0, 0.8]

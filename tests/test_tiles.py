"""Block pairs in tiles; links and the index join exchange rows per block pair, never pairs."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bugsift.operators import blocks, cells
from bugsift.operators.features import VectorizerConfig, fit_transform
from bugsift.operators.pairs import Vectors, epsilon_join, links


def _pairs(ida, a, idb, b, eps):
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    return {(min(x, y), max(x, y)) for p, x in enumerate(ida) for q, y in enumerate(idb) if d[p, q] <= eps}


def test_kernels_hand_on_tiles(monkeypatch):
    monkeypatch.setattr(blocks, "TILE_CELLS", 200)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 3)), rng.normal(size=(40, 3))
    left, right = pd.DataFrame({"id": range(50)}), pd.DataFrame({"id": range(50, 90)})
    frames = list(blocks.threshold_pairs_kernel(eps=1.0)(left, right, a, b, False))
    assert len(frames) == 10                    # 5 rows x 40 columns each
    got = pd.concat(frames)
    want = _pairs(range(50), a, range(50, 90), b, 1.0)
    assert set(zip(got.i, got.j)) == want and len(got) == len(want)
    stars = blocks.linked_kernel(1.0)(left, right, a, b, False)
    of = blocks.Links(left["id"].to_numpy(), right["id"].to_numpy())
    near = np.zeros((50, 40), bool)
    for i, j in want:
        near[i, j - 50] = True
    of.add(near, slice(None), slice(None))
    assert stars.equals(of.stars()) and len(stars) < len(want)


def test_nearest_keeps_ties_by_id(spark, monkeypatch):
    at = [0.0, 1.0, 1.0, -1.0, 5.0, 5.0, 5.0, 9.0]
    df = spark.createDataFrame([(k, [x]) for k, x in enumerate(at)], "id long, vec array<double>")
    got = {r.id: [(e.dist, e.other) for e in r.near] for r in cells.nearest(cells.assign(df, "dense", 1, len(at)), 2).collect()}
    for k, x in enumerate(at):
        assert got[k] == sorted((abs(x - y), j) for j, y in enumerate(at) if j != k)[:2]


def _vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return Vectors.sparse(fit_transform(df, VectorizerConfig(use_idf=False)))


def test_index_join_makes_no_candidate_rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(150)] + [None, "", "w1 w1"]
    v = _vectors(spark, texts)
    joined = epsilon_join(v, 0.7, "index")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Distinct" not in plan and "distinct" not in plan.lower().split("flatmapgroups")[0]
    other = {(r.i, r.j) for r in epsilon_join(v, 0.7, "blocks").collect()}
    rows = joined.collect()
    assert {(r.i, r.j) for r in rows} == other and len(rows) == len(other) and (150, 151) in other


def test_links_of_the_index_are_stars(spark):
    texts = [f"aa bb cc dd ee ff x{k % 40}" for k in range(120)] + ["far off"]
    v = _vectors(spark, texts)
    got = links(v, 0.6, "index")
    assert got.count() <= 121 and got.count() < epsilon_join(v, 0.6, "index").count()
    from bugsift.operators.dbscan import dbscan
    by = {m: {r.id: r.label for r in dbscan(v, 0.6, 2, method=m).collect()} for m in ("index", "blocks")}
    assert by["index"] == by["blocks"] and by["index"][120] == -1
    assert {r.label for r in dbscan(v, 0.6, 2, method="index").where(F.col("id") < 120).collect()} == {0}


def test_one_meeting_links_every_distance(spark):
    from bugsift.operators.pairs import links_each
    at = np.random.default_rng(5).uniform(0, 4, (400, 2))
    df = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(at)], "id long, vec array<double>")
    v = Vectors.dense(df, "id", "vec")
    eps = [0.1, 0.2]
    edges = links_each(v, eps).cache()
    for level, e in enumerate(eps):
        pairs = [(r.i, r.j) for r in epsilon_join(v, e).collect()]
        own = [(r.i, r.j) for r in edges.where(F.col("level") == level).collect()]
        assert np.array_equal(_components(own, 400), _components(pairs, 400))
    assert edges.where("level = 1").count() < len(pairs)


def _components(edges, n):
    of = list(range(n))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x
    for i, j in edges:
        a, b = sorted((root(i), root(j)))
        of[b] = a
    return [root(x) for x in range(n)]


def test_rare_terms_alone_go_round_by_term(spark, monkeypatch):
    from bugsift.operators import features
    texts = [f"common words here rare{k} pair{k // 2}" for k in range(20)] + [None, "", "alone"]
    df = spark.createDataFrame([*enumerate(texts), (None, "common rare3 other")], "doc_id long, text string")
    cfg = VectorizerConfig(min_df=2, sublinear_tf=True)
    whole = fit_transform(df, cfg)
    want = {r.doc_id: r.vec for r in whole.rows.collect()}
    monkeypatch.setattr(features, "BROADCAST_TERMS", 4)
    assert features.broadcast_df(whole.vocab, cfg) == 16
    split = fit_transform(df, cfg)
    got = {r.doc_id: r.vec for r in split.rows.collect()}
    assert got == want and len(got) == 24 and got[20] == [] and len(got[None]) == 2
    plan = split.rows._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
    monkeypatch.setattr(features, "BROADCAST_TERMS", 0)
    assert {r.doc_id: r.vec for r in fit_transform(df, cfg).rows.collect()} == want


def test_calls_hold_few_messages(spark):
    from bugsift.functions import prompts as P
    from bugsift.operators.complete import CALL_ROWS, batch_complete

    def factory():
        return lambda msgs: [str(len(msgs))] * len(msgs)
    df = spark.range(0, 3 * CALL_ROWS, 1, 1).select("id", P.build_prompt(F.lit("a b c"), "sentence").alias("messages"))
    rows = batch_complete(df, id_col="id", completer_factory=factory).collect()
    assert len(rows) == 3 * CALL_ROWS and {int(r.reply) for r in rows} == {CALL_ROWS}


def test_fixed_length_chunks_need_no_shuffle_of_tokens(spark, tmp_path):
    from bugsift.plans.q_prompts import q_encode_fixed_length
    spark.createDataFrame([(k, "aa bb cc " * 30) for k in range(12)] + [(12, None), (13, "")], "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    enc = q_encode_fixed_length(spark, str(tmp_path))
    rows = {(r.doc_id, r.chunk): r.n_real for r in enc.collect()}
    assert rows[(12, 0)] == rows[(13, 0)] == 0 and rows[(0, 0)] == 50 and rows[(0, 1)] == 40 and len(rows) == 26
    plan = enc._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2

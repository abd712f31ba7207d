"""Truncated SVD, mini-batch k-means, learned segmentation, block-row matrix."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from bugsift.operators import encoder, minibatch, segmentation
from bugsift.operators.pairs import Vectors, similarity_blocks


def sparse(spark, X):
    rows = [(i, [int(j) for j in np.flatnonzero(x)], [float(w) for w in x[x != 0]]) for i, x in enumerate(X)]
    return Vectors(spark.createDataFrame(rows, "id long, idx array<int>, w array<double>"), "id", "sparse", X.shape[1], len(X))


@pytest.mark.parametrize("max_factor", [1 << 30, 0])
def test_truncated_svd(spark, max_factor):
    rng = np.random.default_rng(1)
    X = (rng.normal(size=(90, 8)) * 2.0 ** -np.arange(8)) @ rng.normal(size=(8, 60)) + 0.01 * rng.normal(size=(90, 60))
    X[rng.uniform(size=X.shape) < 0.4] = 0
    X[7] = 0
    u, s, _ = np.linalg.svd(X, full_matrices=False)
    got = encoder.truncated_svd(sparse(spark, X), 5, rounds=4, max_factor=max_factor)
    assert np.allclose(got.values, s[:5], rtol=1e-3)
    vec = np.array([r["vec"] for r in got.vectors.orderBy("id").collect()])
    # coordinates span the leading subspace: its part outside is small
    q = np.linalg.qr(vec)[0]
    assert np.linalg.norm(u[:, :3] - q @ (q.T @ u[:, :3])) < 0.02
    assert np.allclose((vec ** 2).sum(0), got.values ** 2, rtol=1e-6) and np.allclose(vec[7], 0)
    unit = np.array([r["vec"] for r in encoder.encode_texts(sparse(spark, X), 5).orderBy("id").collect()])
    assert np.allclose(np.delete(np.linalg.norm(unit, axis=1), 7), 1) and np.allclose(unit[7], 0)


def test_svd_tasks_take_rows_in_pieces(spark, monkeypatch):
    """A batch of many entries is never unfolded whole, and pieces add up to the product."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(40, 30)) * (rng.uniform(size=(40, 30)) < 0.3)
    X[3], X[9] = 0, 1
    rows = [(i, np.flatnonzero(x), x[x != 0]) for i, x in enumerate(X)]
    whole = pd.DataFrame(rows, columns=["id", "idx", "w"])
    assert max(len(p) for p in encoder._pieces([whole])) == 40
    monkeypatch.setattr(encoder, "PIECE_ENTRIES", 20)
    monkeypatch.setattr(encoder, "FLUSH_TERMS", 25)
    pieces = list(encoder._pieces([whole.iloc[:15], whole.iloc[:0], whole.iloc[15:]]))
    assert [i for p in pieces for i in p["id"]] == list(range(40))
    assert all(sum(map(len, p["idx"])) <= 20 or len(p) == 1 for p in pieces) and len(pieces) > 10

    class Task:                                # one task of mapInPandas
        def __init__(self, pdf):
            self.pdf = pdf

        def select(self, *columns):
            return self

        def mapInPandas(self, go, schema):
            self.out = list(go(iter([self.pdf])))
            return self

        def groupBy(self, *columns):
            return self

        def agg(self, *columns):
            return self

    seen = []
    one = encoder._with_y(Task(whole), lambda terms: (seen.append(len(terms)), encoder._signs(terms, 4, 1))[1])
    assert len(one.out) == len(seen) == len(list(encoder._pieces([whole])))
    got = pd.concat(one.out)
    want = X @ encoder._signs(np.arange(30), 4, 1)
    assert np.allclose(np.vstack(got["y"].values), want) and list(got["id"]) == list(range(40))
    parts = encoder._transposed(Task(got), 4).out
    assert len(parts) > 1 and np.allclose(pd.concat(parts).groupby("term").sum().reindex(range(30), fill_value=0), X.T @ want)


def test_svd_of_fewer_rows_than_columns(spark):
    X = np.array([[1.0, 0, 2, 0], [0, 3.0, 0, 0], [1.0, 0, 2, 0]])
    got = encoder.truncated_svd(sparse(spark, X), 3, oversample=2)
    assert np.allclose(got.values, np.linalg.svd(X)[1], atol=1e-6)


def test_minibatch_kmeans_reference_step(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(200, 3)) + rng.integers(0, 3, 200)[:, None] * 6
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, v array<double>")
    lab, centres = minibatch.minibatch_kmeans(df.repartition(5), id_col="id", vec_col="v", k=4, batch_rows=60, rounds=5)
    one, again = minibatch.minibatch_kmeans(df.repartition(1), id_col="id", vec_col="v", k=4, batch_rows=60, rounds=5)
    assert np.allclose(centres, again)

    def draw(i, t):
        return (i % 1_000_003 * minibatch.STEP + (t * 7919 + 3) * minibatch.TURN) % minibatch.RANGE
    c = X[sorted(range(200), key=lambda i: (draw(i, 0), i))[:4]].copy()
    seen = np.zeros(4)
    for t in range(1, 6):
        batch = [i for i in range(200) if draw(i, t) < -(-60 * minibatch.RANGE // 200)]
        near = {i: int(((X[i] - c) ** 2).sum(1).argmin()) for i in batch}
        for j in range(4):
            for i in (i for i in batch if near[i] == j):        # one row at a time, rate 1 / seen
                seen[j] += 1
                c[j] += (X[i] - c[j]) / seen[j]
    assert np.allclose(centres, c)
    want = {i: int(((X[i] - c) ** 2).sum(1).argmin()) for i in range(200)}
    assert {r["id"]: r["label"] for r in lab.collect()} == want
    assert minibatch.minibatch_kmeans(df.limit(0), id_col="id", vec_col="v")[0].collect() == []


def brute_words(runs, max_len):
    total = sum(n * len(r) for r, n in runs)
    count, before, after = {}, {}, {}
    for r, n in runs:
        for k in range(1, max_len + 1):
            for i in range(len(r) - k + 1):
                w = r[i:i + k]
                count[w] = count.get(w, 0) + n
                for side, c in ((before, r[i - 1:i] if i else ""), (after, r[i + k:i + k + 1])):
                    side.setdefault(w, {}).setdefault(c, 0)
                    side[w][c] += n

    def h(side):
        t = sum(side.values())
        return -sum(x / t * math.log(x / t) for x in side.values())
    return {w: (n, min(math.log(n * total / (count[w[:k]] * count[w[k:]])) for k in range(1, len(w))), min(h(before[w]), h(after[w])))
            for w, n in count.items() if len(w) > 1}, total


def test_learned_segmentation(spark):
    rng = np.random.default_rng(3)
    units = ["登录", "失败", "页面", "崩溃了", "点", "按钮"]
    runs = {}
    for _ in range(400):
        r = "".join(rng.choice(units, rng.integers(1, 5)))
        runs[r] = runs.get(r, 0) + 1
    df = segmentation.runs_of(spark.createDataFrame([(f"x {r} y {r}",) for r, n in runs.items() for _ in range(n)] + [(None,), ("abc",)],
                                                    "t string"), "t")
    assert {r["run"]: r["n"] for r in df.collect()} == {r: 2 * n for r, n in runs.items()}
    stats, total = brute_words([(r, 2 * n) for r, n in runs.items()], 4)
    words = segmentation.learn_words(df)
    got = {r["word"]: r for r in words.collect()}
    want = {w for w, (n, m, e) in stats.items() if n >= 5 and m >= 1.0 and e >= 0.5}
    assert set(got) == want and {"登录", "失败", "页面", "崩溃了", "按钮"} <= want
    for w, r in got.items():
        n, m, e = stats[w]
        assert r["n"] == n and abs(r["mutual"] - m) < 1e-9 and abs(r["entropy"] - e) < 1e-9
    p = {w: math.log(stats[w][0] / total) for w in want}
    alone = math.log(1 / total)
    cut = {r["run"]: r["words"] for r in segmentation.segment_runs(df, words).collect()}
    for run in list(runs)[:60]:
        best = None
        for marks in itertools.product((0, 1), repeat=len(run) - 1):
            ends = [i + 1 for i, m in enumerate(marks) if m] + [len(run)]
            parts = [run[a:b] for a, b in zip([0, *ends], ends)]
            if all(len(x) == 1 or x in p for x in parts):
                score = sum(p[x] if len(x) > 1 else alone for x in parts)
                best = score if best is None else max(best, score)
        assert "".join(cut[run]) == run
        assert abs(sum(p[x] if len(x) > 1 else alone for x in cut[run]) - best) < 1e-9
    assert segmentation.learn_words(df.limit(0)).collect() == []


def test_similarity_blocks(spark):
    pairs = spark.createDataFrame([(3, 8, 0.5), (3, 40, 0.25), (8, 41, 0.75)], "i long, j long, sim double")
    ids = spark.createDataFrame([(i,) for i in (3, 8, 40, 41, 50)], "id long")
    got = {(r["row"], r["block"]): r["vals"] for r in similarity_blocks(pairs, ids, 2).collect()}
    full = np.eye(5)
    for a, b, s in ((0, 1, 0.5), (0, 2, 0.25), (1, 3, 0.75)):
        full[a, b] = full[b, a] = s
    want = {(i, b): full[i, 2 * b:2 * b + 2].tolist() for i in range(5) for b in range(3) if full[i, 2 * b:2 * b + 2].any()}
    assert got == want


def cbow_step(params, examples, rate):
    """One AdaGrad step over all examples, one by one."""
    grad = {k: np.zeros_like(v) for k, (v, _) in params.items()}
    loss = 0.0
    for context, words in examples:
        h = np.mean([params[0, w][0] for w in context], 0)
        for k, w in enumerate(words):
            if k and w == words[0]:
                continue
            y = 1.0 if k == 0 else 0.0
            o = params[1, w][0]
            p = 1 / (1 + np.exp(-h @ o))
            loss -= np.log(p if y else 1 - p)
            grad[1, w] += (y - p) * h
            for c in context:
                grad[0, c] += (y - p) * o / len(context)
    out = {}
    for k, (v, q) in params.items():
        q = q + (grad[k] ** 2).mean()
        out[k] = (v + rate * grad[k] / np.sqrt(q) if q else v, q)
    return out, loss / len(examples)


def test_cbow_step_equals_reference(spark):
    from bugsift.operators import cbow
    rng = np.random.default_rng(4)
    rows = [(0, 0, 0, [1, 2, 2], [3, 0, 0, 3]), (0, 0, 1, [3], [1, 4, 2]), (1, 1, 0, [1, 1], [2, 1, 0]), (2, 5, 7, [4, 0], [0, 3, 1])]
    params = {(s, w): (rng.normal(size=3), 0.5 * w) for s in (0, 1) for w in range(6)}
    df = spark.createDataFrame([(w // 2, s, w, [float(x) for x in v], float(q)) for (s, w), (v, q) in params.items()], cbow._PARAMS)
    want, loss = cbow_step(params, [(c, w) for *_, c, w in rows], 0.2)
    for parts in (1, 2):
        ex = spark.createDataFrame([(b % parts, i, p, c, w) for b, i, p, c, w in rows],
                                   "block long, id long, pos int, context array<long>, words array<long>")
        got, said = cbow.step(df.repartition(parts), ex, 0.2, part_words=2, salts=parts)
        assert abs(said - loss) < 1e-12
        got = {(r["side"], r["word"]): r for r in got.collect()}
        assert set(got) == set(want)
        for k, (v, q) in want.items():
            assert np.allclose(got[k]["vec"], v) and abs(got[k]["square"] - q) < 1e-12


def test_cbow_learns_what_goes_together(spark):
    from bugsift.operators import cbow
    words = [[f"{g}{k}" for k in range(4)] for g in ("red", "sea")]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(words[i % 2][k] for k in rng.integers(4, size=9))) for i in range(60)]
    df = spark.createDataFrame([*rows, (90, None), (91, ""), (92, "alone"), (93, "red1")], "doc_id long, text string")
    model = cbow.train(df, id_col="doc_id", text_col="text", size=8, rounds=6, batch_rows=10_000, rate=0.3, rows_per_block=100)
    assert len(model.losses) == 6 and model.losses[-1] < 0.8 * model.losses[0]
    assert abs(model.losses[0] - 6 * math.log(2)) < 0.9           # output vectors start at zero
    vec = {r["id"]: np.array(r["vec"]) for r in cbow.text_vectors(df, model, id_col="doc_id", text_col="text").collect()}
    assert set(vec) == {*range(60), 93}
    x = np.stack([vec[i] / np.linalg.norm(vec[i]) for i in range(60)])
    near = x @ x.T
    same = np.equal.outer(np.arange(60) % 2, np.arange(60) % 2)
    assert near[same].mean() > near[~same].mean() + 0.2
    none = cbow.train(df.limit(0), id_col="doc_id", text_col="text")
    assert none.losses == [] and cbow.text_vectors(df, none, id_col="doc_id", text_col="text").collect() == []

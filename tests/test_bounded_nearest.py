"""k nearest over cells: what other cells return is bounded by the own cell's k-th distance."""

import numpy as np
import pytest

from bugsift.operators import blocks, cells


def _points(n=300):
    at = np.random.default_rng(5).integers(0, 12, (n, 2)).astype(float)      # a grid: many ties and copies
    at[:20] = at[0]
    return at


def _frame(spark, at):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(at)], "id long, vec array<double>")


@pytest.mark.parametrize("k", [1, 3, 40])
def test_nearest_on_a_grid(spark, k):
    at = _points()
    c = cells.assign(_frame(spark, at), "dense", 2, len(at), n_pivots=9)
    got = {r.id: [(round(e.dist, 9), e.other) for e in r.near] for r in cells.nearest(c, k).collect()}
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    for i in range(len(at)):
        assert got[i] == sorted((round(float(d[i, j]), 9), j) for j in range(len(at)) if j != i)[:k]


def test_other_cells_return_only_what_is_near_enough(spark, monkeypatch):
    """Each visited cell once returned k rows for each visitor, however far."""
    found, meet = [], cells.meet
    monkeypatch.setattr(cells, "meet", lambda *a, **b: found.append(meet(*a, **b)) or found[-1])
    at = np.random.default_rng(6).normal(size=(300, 2))
    cells.nearest(cells.assign(_frame(spark, at), "dense", 2, len(at), n_pivots=9), 3).collect()
    home, far = ([(r.id, r.dist) for r in f.collect()] for f in found)
    most = {}
    for i, dist in home:
        most.setdefault(i, []).append(dist)
    most = {i: sorted(x)[2] for i, x in most.items() if len(x) >= 3}
    assert far and all(dist <= most[i] * (1 + 1e-8) for i, dist in far if i in most)


def test_sq_dists_are_exact_for_equal_rows():
    a = np.random.default_rng(7).normal(size=(50, 8)) * 100
    d2 = blocks.sq_dists(a, a[::-1].copy())[0]
    assert (d2 >= 0).all() and (d2[np.arange(50), 49 - np.arange(50)] == 0).all()
    assert np.allclose(d2, ((a[:, None] - a[::-1][None]) ** 2).sum(2))

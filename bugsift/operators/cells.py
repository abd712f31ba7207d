"""Metric cells: exact neighbour joins that skip what the triangle inequality rules out.

Rows are dealt to the cell of their nearest pivot (a bounded number of rows drawn
by hash, ``MAX_PIVOTS`` at most: they decide the speed, never the result). A row x
visits another cell c only if something there can be near enough:

* ball: |x - pivot_c| - radius_c is at most the distance asked for;
* half-space: rows of c are nearer to pivot_c than to x's own pivot, so
  (|x - pivot_c| - |x - pivot_own|) / 2 is a bound as well.

``meet`` brings the rows of every cell together with its visitors. Both sides of a
cell are split into blocks of ``rows_per_block``, so a heavy cell becomes many
groups and no task holds more than two blocks, their distances in tiles. The pairs compared are noted in
``session.LOOP_ROUNDS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import LOOP_ROUNDS, cut_lineage, default_parallelism
from . import blocks

MAX_PIVOTS = 1024
SPARSE_BLOCK_ROWS = 4096
COLUMN_STEP = 4096


class Rows:
    """Vectors of a pandas frame: a dense matrix, or sorted (index, weight) rows."""

    def __init__(self, pdf: pd.DataFrame, kind: str, dim: int):
        self.kind, self.n = kind, len(pdf)
        if kind == "dense":
            self.matrix = blocks.to_matrix(pdf, "dense", dim)
            self.sq = np.einsum("ij,ij->i", self.matrix, self.matrix)
            return
        size = np.fromiter((len(a) for a in pdf["idx"].values), np.int64, self.n)
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self.row = np.repeat(np.arange(self.n), size)
        join = lambda c, t: np.concatenate([np.asarray(a, t) for a in pdf[c].values] or [np.zeros(0, t)])
        self.idx, self.w = join("idx", np.int64), join("w", np.float64)
        self.sq = np.bincount(self.row, self.w * self.w, minlength=self.n)

    def part(self, lo: int, hi: int) -> "Rows":
        """The rows from lo to hi."""
        out = object.__new__(Rows)
        out.kind, out.n, out.sq = self.kind, hi - lo, self.sq[lo:hi]
        if self.kind == "dense":
            out.matrix = self.matrix[lo:hi]
            return out
        own = slice(self.ptr[lo], self.ptr[hi])
        out.ptr, out.row, out.idx, out.w = self.ptr[lo:hi + 1] - self.ptr[lo], self.row[own] - lo, self.idx[own], self.w[own]
        return out

    def columns(self, cols: np.ndarray) -> np.ndarray:
        """Dense matrix of some (sorted) columns."""
        out = np.zeros((self.n, len(cols)))
        if len(cols):
            at = np.minimum(np.searchsorted(cols, self.idx), len(cols) - 1)
            ok = cols[at] == self.idx
            out[self.row[ok], at[ok]] = self.w[ok]
        return out


def sq_dists(a: Rows, b: Rows) -> np.ndarray:
    """Squared distances. Sparse rows multiply only the columns that both sides
    have, some at a time: memory does not grow with the vocabulary."""
    if a.kind == "dense":
        return blocks.sq_dists(a.matrix, b.matrix)[0]
    g = np.zeros((a.n, b.n))
    shared = np.intersect1d(a.idx, b.idx)
    for lo in range(0, len(shared), COLUMN_STEP):
        cols = shared[lo:lo + COLUMN_STEP]
        g += a.columns(cols) @ b.columns(cols).T
    d2 = a.sq[:, None] + b.sq[None, :] - 2.0 * g
    r, c = np.nonzero(d2 <= 1e-7 * (a.sq[:, None] + b.sq[None, :]))
    for x, y in zip(r, c):          # equal rows are at distance 0
        own, other = slice(a.ptr[x], a.ptr[x + 1]), slice(b.ptr[y], b.ptr[y + 1])
        cols, inv = np.unique(np.concatenate([a.idx[own], b.idx[other]]), return_inverse=True)
        diff = np.bincount(inv, np.concatenate([a.w[own], -b.w[other]]), minlength=len(cols))
        d2[x, y] = diff @ diff
    return np.maximum(d2, 0.0, out=d2)


def value_columns(kind: str) -> list[str]:
    return ["vec"] if kind == "dense" else ["idx", "w"]


@dataclass
class Cells:
    """Rows with their cell, and the pivots. ``bounds``: cell -> (rows, radius, smallest size)."""
    rows: DataFrame            # id, cell, own (distance to the pivot), vector columns, extra columns
    kind: str
    dim: int
    n_rows: int
    pivots: pd.DataFrame
    extra: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return ["id", *value_columns(self.kind), *self.extra]

    def block_rows(self) -> int:
        most = SPARSE_BLOCK_ROWS if self.kind == "sparse" else blocks.tiled_rows(self.dim)
        cores = default_parallelism(self.rows.sparkSession) / max(1, len(self.pivots))
        return max(64, min(most, math.ceil(self.n_rows / max(1.0, math.sqrt(cores)))))

    def stats(self, size_col: str | None = None) -> dict[int, tuple[int, float, float]]:
        """At most MAX_PIVOTS rows."""
        size = F.min(size_col).cast("double") if size_col else F.lit(1.0)
        return {r["cell"]: (r["n"], r["radius"], r["size"]) for r in self.rows.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("own").alias("radius"), size.alias("size")).collect()}


def pivot_count(n_rows: int, least: int = 256) -> int:
    return 1 if n_rows <= least else min(MAX_PIVOTS, max(2, int(math.sqrt(n_rows) / 2)))


def nearest_pivot(pdf: pd.DataFrame, pivots: Rows, kind: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance to its pivot; with a single cell there is nothing to bound."""
    if pivots.n <= 1:
        return np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
    d = np.sqrt(sq_dists(Rows(pdf, kind, dim), pivots))
    cell = d.argmin(1)
    return cell.astype(np.int32), d[np.arange(len(pdf)), cell]


def assign(df: DataFrame, kind: str, dim: int, n_rows: int, extra: tuple[str, ...] = (), n_pivots: int | None = None) -> Cells:
    """Deal the rows (id, vector columns, extra columns) of ``df`` to cells."""
    cols = ["id", *value_columns(kind), *extra]
    base = df.select(F.col("id").cast("long").alias("id"), *cols[1:])
    k = pivot_count(n_rows) if n_pivots is None else n_pivots
    pivots = base.orderBy(F.xxhash64("id"), "id").limit(max(1, min(k, MAX_PIVOTS))).select(*value_columns(kind)).toPandas()

    def go(batches):
        own = Rows(pivots, kind, dim)
        for pdf in batches:
            pdf = pdf.copy()
            pdf["cell"], pdf["own"] = nearest_pivot(pdf, own, kind, dim)
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return Cells(cut_lineage(base.mapInPandas(go, f"{schema}, cell int, own double")), kind, dim, n_rows, pivots, extra)


def visits(cells: Cells, asked: DataFrame, reach, stats: dict, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``asked`` (columns of the cells, ``carry``) with the array ``to`` of
    the cells to visit. ``reach(pdf, lower, other)`` says which: ``lower`` (rows x
    cells) bounds the distance to anything in a cell, ``other`` is true for foreign
    cells; inf in ``lower`` marks cells without rows."""
    kind, dim, pivots = cells.kind, cells.dim, cells.pivots
    k = len(pivots)
    if k <= 1:
        return asked.withColumn("to", F.array(F.lit(0)))
    radius = np.array([stats[c][1] if c in stats else -np.inf for c in range(k)])
    empty = np.array([c not in stats for c in range(k)])
    cols = [*cells.columns, "cell", "own", *carry]

    def go(batches):
        own = Rows(pivots, kind, dim)
        for pdf in batches:
            pdf = pdf.copy()
            rows = Rows(pdf, kind, dim)
            d = np.sqrt(sq_dists(rows, own))
            half = (d - pdf["own"].to_numpy()[:, None]) / 2
            # rounding of the products: far below any distance that matters, above their error
            slack = 1e-9 + 1e-7 * (np.sqrt(rows.sq)[:, None] + np.sqrt(own.sq)[None, :])
            lower = np.maximum(np.maximum(d - radius[None, :], half), 0) - slack
            lower[:, empty] = np.inf
            other = np.arange(lower.shape[1])[None, :] != pdf["cell"].to_numpy()[:, None]
            ok = reach(pdf, np.where(other, np.maximum(lower, 0), 0.0), other) & ~empty[None, :]
            pdf["to"] = [np.flatnonzero(x).astype(np.int32) for x in ok]
            yield pdf[[*cols, "to"]]

    fields = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    return asked.select(*cols).mapInPandas(go, ", ".join(f"`{c}` {fields[c]}" for c in cols) + ", to array<int>")


def stored(cells: Cells, going: DataFrame) -> DataFrame:
    """Visits are read twice, unless there is one cell to visit."""
    return cut_lineage(going) if len(cells.pivots) > 1 else going


def meet(cells: Cells, visitors: DataFrame, kernel, schema: str, stats: dict, *, carry: tuple[str, ...] = (),
         note: str | None = None, coming: int | None = None) -> DataFrame:
    """``kernel(visitors_pdf, rows_pdf, tiles)``, a frame or an iterator of frames, for
    every block of visitors and of rows of a cell: ``tiles`` gives (lo, hi, sq_dists of
    these visitors). ``visitors`` is a stored result of ``visits``; ``coming`` says how
    many visit a single cell, where they are not all its rows."""
    size = cells.block_rows()
    going = visitors.select("*", F.explode("to").alias("_cell")).drop("to")
    if len(cells.pivots) <= 1:            # one cell: its rows bound the visitors as well
        nv = nh = max(1, math.ceil(cells.n_rows / size))
        if coming is not None:          # few visitors: more blocks of rows keep all cores busy
            nv = max(1, math.ceil(coming / size))
            nh = max(nh, min(math.ceil(default_parallelism(cells.rows.sparkSession) / nv), cells.n_rows // 64))
        planned = lambda df: df.withColumn("_nh", F.lit(nh)).withColumn("_nv", F.lit(nv))
        if note:
            LOOP_ROUNDS[note] = LOOP_ROUNDS.get(note, 0) + cells.n_rows * (cells.n_rows if coming is None else coming)
    else:
        coming = {r["_cell"]: r["n"] for r in going.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = visitors.sparkSession.createDataFrame(
            [(c, math.ceil(stats[c][0] / size), math.ceil(n / size)) for c, n in sorted(coming.items())],
            "_cell int, _nh int, _nv int")       # one row per cell
        planned = lambda df: df.join(F.broadcast(plan), "_cell")
        if note:
            LOOP_ROUNDS[note] = LOOP_ROUNDS.get(note, 0) + sum(n * stats[c][0] for c, n in coming.items())
    hashed = F.xxhash64("id", F.lit(1))
    mine = F.col("cell").alias("_home")
    value = cells.columns
    home = (planned(cells.rows.select(*value, mine, F.col("cell").alias("_cell")))
            .withColumn("_h", F.pmod(hashed, "_nh").cast("int")).withColumn("_v", F.explode(F.sequence(F.lit(0), F.col("_nv") - 1)))
            .withColumn("_visitor", F.lit(False)))
    for c in carry:
        home = home.withColumn(c, F.lit(None).cast(dict(visitors.dtypes)[c]))
    guest = (planned(going.select(*value, *carry, mine, "_cell"))
             .withColumn("_v", F.pmod(hashed, "_nv").cast("int")).withColumn("_h", F.explode(F.sequence(F.lit(0), F.col("_nh") - 1)))
             .withColumn("_visitor", F.lit(True)))
    kind, dim = cells.kind, cells.dim

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        a = pdf[pdf["_visitor"]].sort_values("id", kind="stable")
        b = pdf[~pdf["_visitor"]].sort_values("id", kind="stable")
        if not len(a) or not len(b):
            return
        x, y = Rows(a, kind, dim), Rows(b, kind, dim)
        out = kernel(a, b, ((lo, hi, sq_dists(x.part(lo, hi), y)) for lo, hi in blocks.tiles(len(a), len(b))))
        yield from [out] if isinstance(out, pd.DataFrame) else out

    both = home.unionByName(guest.select(*home.columns)).drop("_nh", "_nv")
    return both.groupBy("_cell", "_h", "_v").applyInPandas(group, schema)


# ---------------------------------------------------------------- joins on cells

def _within(cells: Cells, eps: float, kernel, schema: str) -> DataFrame:
    """Meet everything within ``eps``; each pair of cells meets once."""
    stats = cells.stats()

    def reach(pdf, lower, other):
        cell = pdf["cell"].to_numpy()[:, None]
        return (lower <= eps) & (np.arange(lower.shape[1])[None, :] >= cell)

    going = stored(cells, visits(cells, cells.rows, reach, stats))
    return meet(cells, going, kernel, schema, stats, note="range_pairs.compared")


def range_links_each(cells: Cells, eps: list[float]) -> DataFrame:
    """``(level, i, j)``: star edges with the components of the graph of each distance
    ``eps[level]``, at most one per row of a meeting: no group of close rows is listed
    pair by pair."""
    def kernel(a, b, tiles):
        links = [blocks.Links(a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)) for _ in eps]
        for lo, hi, d2 in tiles:
            for own, e in zip(links, eps):
                own.add(d2 <= e * e, slice(lo, hi), slice(None))
        for level, own in enumerate(links):
            yield own.stars().assign(level=np.int32(level))[["level", "i", "j"]]

    return _within(cells, max(eps), kernel, "level int, i long, j long")


def range_links(cells: Cells, eps: float) -> DataFrame:
    """Star edges ``(i, j)`` with the components of the eps-graph."""
    return range_links_each(cells, [eps]).select("i", "j")


def range_pairs(cells: Cells, eps: float) -> DataFrame:
    """All pairs i < j within ``eps``: ``(i, j, dist)``."""
    def kernel(a, b, tiles):
        ida, idb = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        homes, home = a["_home"].to_numpy(), b["_home"].to_numpy()
        for lo, hi, d2 in tiles:
            same = homes[lo:hi, None] == home[None, :]
            x, y = np.nonzero((d2 <= eps * eps) & (~same | (ida[lo:hi, None] < idb[None, :])))
            i, j = ida[lo:hi][x], idb[y]
            yield pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "dist": np.sqrt(d2[x, y])})

    return _within(cells, eps, kernel, "i long, j long, dist double")


def nearest(cells: Cells, k: int) -> DataFrame:
    """``(id, near)``: per row its k nearest other rows as sorted (dist, other). The
    k-th distance within the own cell bounds the search in the others: it says which
    cells are visited, and only rows within it are put in order there."""
    stats = cells.stats()

    def least(ida, idb, d2, kk):
        d2 = np.where(ida[:, None] == idb[None, :], np.inf, d2)
        if kk < len(idb):        # the k least and their ties stay; the others need no order
            d2[d2 > np.partition(d2, kk - 1, axis=1)[:, kk - 1:kk]] = np.inf
            width = int(np.isfinite(d2).sum(1).max(initial=0))
        else:
            width = len(idb)
        width = max(kk, width)
        if width < len(idb):
            cols = np.sort(np.argpartition(d2, width - 1, axis=1)[:, :width], axis=1)
            d2 = np.take_along_axis(d2, cols, 1)
        else:
            cols = np.broadcast_to(np.arange(len(idb)), d2.shape)
        order = np.argsort(d2, axis=1, kind="stable")[:, :kk]       # rows sorted by id: ties by id
        d = np.take_along_axis(d2, order, 1).ravel()
        ok = np.isfinite(d)
        return pd.DataFrame({"id": np.repeat(ida, kk)[ok],
                             "other": idb[np.take_along_axis(cols, order, 1).ravel()][ok], "dist": np.sqrt(d[ok])})

    def kernel(a, b, tiles):
        ida, idb = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        kk = min(k, len(idb))
        if "most" not in a:
            for lo, hi, d2 in tiles:
                yield least(ida[lo:hi], idb, d2, kk)
            return
        most = a["most"].to_numpy(np.float64)
        # a little more than the bound: rounding loses none, and `best` takes the k least
        bound = np.where(np.isnan(most), np.finfo(np.float64).max, most * most * (1 + 1e-9))
        for lo, hi, d2 in tiles:
            near = d2 <= bound[lo:hi, None]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > kk)
            if len(many):            # copies, or rows whose own cell is too small to bound them
                yield least(ida[lo:hi][many], idb, d2[many], kk)
                near[many] = False
            x, y = np.nonzero(near)
            other = ida[lo:hi][x] != idb[y]
            x, y = x[other], y[other]
            yield pd.DataFrame({"id": ida[lo:hi][x], "other": idb[y], "dist": np.sqrt(d2[x, y])})

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "other"))), 1, k).alias("near"))

    def run(going: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        return meet(cells, stored(cells, going), kernel, "id long, other long, dist double", stats, carry=carry, note="nearest.compared")

    home = best(run(visits(cells, cells.rows, lambda pdf, lower, other: ~other, stats)))
    if len(cells.pivots) <= 1:
        return home
    home = cut_lineage(home)
    asked = cells.rows.join(home.select("id", F.when(F.size("near") >= k, F.element_at("near", k)["dist"]).alias("most")), "id", "left")
    going = visits(cells, asked, lambda pdf, lower, other: other & ~(lower > pdf["most"].to_numpy()[:, None]), stats,
                   carry=("most",))
    far = run(going, ("most",))
    return best(home.select("id", F.explode("near").alias("e")).select("id", "e.other", "e.dist").unionByName(far))

"""Block-pair kernels for exact all-pairs work on bounded-dimension vectors.

Spark has no matrix multiply, and a theta join on a distance predicate plans
as a nested-loop join. Here rows are hashed into ``B`` blocks; each row is
sent to the ``B`` block pairs it belongs to and every block pair is one
``applyInPandas`` group holding at most ``2 * rows_per_block`` rows. Inside a
group numpy does one matrix product and returns only what the kernel keeps
(pairs under a threshold, star edges, a forest): output is bounded by
the answer, never by the n^2 candidate set.

Memory per task is bounded by ``rows_per_block`` (chosen from the dimension);
work is n^2 * dim / 2 in total, spread over B(B+1)/2 tasks. Pairs and links are
taken tile by tile (``TILE_CELLS`` products at a time, handed on before the next).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import default_parallelism

# target size of one dense block (rows x dim doubles)
BLOCK_BYTES = 32 * 1024 * 1024
MAX_BLOCK_ROWS = 4096
# products of one tile: a few matrices of 8 MB at a time, however large the block
TILE_CELLS = 1 << 20
# block rows of kernels that work in tiles: a row is sent to few blocks
MAX_TILED_ROWS = 16384
# sparse rows stay sparse in a block and become dense a tile at a time: large blocks, so
# that a row is sent to few of them
SPARSE_BLOCK_ROWS = 32768


def plan_blocks(n_rows: int, dim: int, parallelism: int, rows_per_block: int | None = None) -> int:
    """Number of blocks: enough for memory, and enough block pairs to fill the cores."""
    if rows_per_block is None:
        rows_per_block = max(64, min(MAX_BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    by_memory = math.ceil(max(1, n_rows) / rows_per_block)
    by_cores = math.ceil((math.sqrt(8 * parallelism + 1) - 1) / 2)  # B(B+1)/2 >= parallelism
    return max(1, by_memory, min(by_cores, max(1, n_rows // 64)))


def tiled_rows(dim: int) -> int:
    """Rows of a block of a kernel that works in tiles."""
    return max(64, min(MAX_TILED_ROWS, BLOCK_BYTES // (8 * max(1, dim))))


def replicate_to_block_pairs(df: DataFrame, id_col: str, n_blocks: int) -> DataFrame:
    """Add ``_pa <= _pb`` (the block pair) and ``_blk`` (the row's own block)."""
    blk = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    return (df.withColumn("_blk", blk)
            .withColumn("_oth", other)
            .withColumn("_pa", F.least("_blk", "_oth"))
            .withColumn("_pb", F.greatest("_blk", "_oth"))
            .drop("_oth"))


def to_matrix(pdf: pd.DataFrame, kind: str, dim: int) -> np.ndarray:
    """Rows of a pandas frame to a dense float64 matrix."""
    n = len(pdf)
    if kind == "dense":
        if n == 0:
            return np.zeros((0, dim))
        return np.concatenate(pdf["vec"].values).astype(np.float64, copy=False).reshape(n, dim)
    mat = np.zeros((n, dim))
    if n:
        lens = np.fromiter((len(a) for a in pdf["idx"].values), dtype=np.int64, count=n)
        if lens.sum():
            rows = np.repeat(np.arange(n), lens)
            cols = np.concatenate([np.asarray(a, dtype=np.int64) for a in pdf["idx"].values])
            vals = np.concatenate([np.asarray(a, dtype=np.float64) for a in pdf["w"].values])
            mat[rows, cols] = vals
    return mat


def split_pair(pdf: pd.DataFrame):
    """(left rows, right rows, is_diagonal), each sorted by id."""
    pa, pb = int(pdf["_pa"].iloc[0]), int(pdf["_pb"].iloc[0])
    if pa == pb:
        left = pdf.sort_values("id", kind="stable")
        return left, left, True
    left = pdf[pdf["_blk"] == pa].sort_values("id", kind="stable")
    right = pdf[pdf["_blk"] == pb].sort_values("id", kind="stable")
    return left, right, False


def sq_dists(a: np.ndarray, b: np.ndarray):
    """Squared Euclidean distances and dot products between the rows of a and b."""
    g = a @ b.T
    na = np.einsum("ij,ij->i", a, a)
    nb = np.einsum("ij,ij->i", b, b)
    norms = na[:, None] + nb[None, :]
    d2 = g * -2.0
    d2 += norms
    # the expansion loses what is small against the norms: those few are taken by difference,
    # so equal rows are at distance 0
    norms *= 1e-7
    r, c = np.nonzero(d2 <= norms)
    for at in range(0, len(r), 20_000):
        x, y = r[at:at + 20_000], c[at:at + 20_000]
        d2[x, y] = np.einsum("ij,ij->i", a[x] - b[y], a[x] - b[y])
    np.maximum(d2, 0.0, out=d2)
    return d2, g, na, nb


def tiles(rows: int, columns: int, cells: int | None = None) -> list[tuple[int, int]]:
    """Ranges of ``rows`` whose products with all ``columns`` are one tile."""
    step = max(1, (cells or TILE_CELLS) // max(1, columns))
    return [(lo, min(rows, lo + step)) for lo in range(0, rows, step)]


class Links:
    """Components of the rows of a block pair, joined tile by tile: a link inside a
    component known by then is not looked at again."""

    def __init__(self, ida: np.ndarray, idb: np.ndarray):
        self.ids, at = np.unique(np.concatenate([ida, idb]), return_inverse=True)
        self.a, self.b = at[:len(ida)], at[len(ida):]
        self.of = np.arange(len(self.ids))      # component: place of its smallest id

    def add(self, near: np.ndarray, rows: slice, columns: slice) -> None:
        from .graph import min_label_components
        own, other = self.of[self.a[rows]], self.of[self.b[columns]]
        r, c = np.nonzero(near & (own[:, None] != other[None, :]))
        if len(r):
            link = np.unique(own[r] * len(self.of) + other[c])
            v, top = min_label_components(link // len(self.of), link % len(self.of))
            to = np.arange(len(self.of))
            to[v] = top
            self.of = to[self.of]

    def stars(self) -> pd.DataFrame:
        """Edges (smallest id of the component, id), at most one per row."""
        v = np.flatnonzero(self.of != np.arange(len(self.of)))
        return pd.DataFrame({"i": self.ids[self.of[v]], "j": self.ids[v]})


def run(df: DataFrame, *, id_col: str, kind: str, dim: int, kernel, schema: str,
        extra_cols: tuple[str, ...] = (), n_rows: int | None = None,
        rows_per_block: int | None = None) -> DataFrame:
    """Run ``kernel(left_pdf, right_pdf, A, B, diagonal)``, a frame or an iterator of
    frames, on every block pair."""
    spark = df.sparkSession
    value_cols = ["vec"] if kind == "dense" else ["idx", "w"]
    base = df.select(F.col(id_col).cast("long").alias("id"), *value_cols, *extra_cols)
    if n_rows is None:
        n_rows = base.count()
    n_blocks = plan_blocks(n_rows, dim, default_parallelism(spark), rows_per_block)
    pairs = replicate_to_block_pairs(base, "id", n_blocks)

    def group_fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, diag = split_pair(pd.concat(list(batches), ignore_index=True))
        if len(left) == 0 or len(right) == 0:
            return
        a = to_matrix(left, kind, dim)
        b = a if diag else to_matrix(right, kind, dim)
        out = kernel(left, right, a, b, diag)
        yield from [out] if isinstance(out, pd.DataFrame) else out

    return pairs.groupBy("_pa", "_pb").applyInPandas(group_fn, schema)


# ---------------------------------------------------------------- kernels

PAIR_SCHEMA = "i long, j long, dist double, sim double"


def threshold_pairs_kernel(eps: float):
    """Pairs (i < j) with distance <= eps."""
    def kernel(left, right, a, b, diag):
        ida = left["id"].to_numpy(np.int64)
        idb = right["id"].to_numpy(np.int64)
        for lo, hi in tiles(len(ida), len(idb)):
            d2, g, na, nb = sq_dists(a[lo:hi], b)
            mask = d2 <= eps * eps
            if diag:
                mask &= ida[lo:hi, None] < idb[None, :]
            r, c = np.nonzero(mask)
            i, j = ida[lo:hi][r], idb[c]
            denom = np.sqrt(na)[r] * np.sqrt(nb)[c]
            sim = np.where(denom > 0, g[r, c] / np.where(denom > 0, denom, 1.0), 0.0)
            yield pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "dist": np.sqrt(d2[r, c]), "sim": sim})
    return kernel


COSINE_SCHEMA = "i long, j long, sim double"


def cosine_pairs_kernel(min_sim: float | None = None):
    """Pairs (i < j) with their cosine similarity, 0 for a row of zeros: every pair,
    or those >= min_sim. A tile's pairs are handed on before the next tile."""
    def kernel(left, right, a, b, diag):
        ida = left["id"].to_numpy(np.int64)
        idb = right["id"].to_numpy(np.int64)
        na, nb = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
        for lo, hi in tiles(len(ida), len(idb)):
            denom = na[lo:hi, None] * nb[None, :]
            sim = np.where(denom > 0, (a[lo:hi] @ b.T) / np.where(denom > 0, denom, 1.0), 0.0)
            mask = np.ones(sim.shape, bool) if min_sim is None else sim >= min_sim
            if diag:
                mask &= ida[lo:hi, None] < idb[None, :]
            r, c = np.nonzero(mask)
            i, j = ida[lo:hi][r], idb[c]
            yield pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "sim": sim[r, c]})
    return kernel


LINK_SCHEMA = "i long, j long"


def linked_kernel(eps: float):
    """Star edges (smallest id of the component, id) of the eps-graph of a block
    pair: the same components as all its pairs, at most one edge per row."""
    def kernel(left, right, a, b, diag):
        links = Links(left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64))
        for lo, hi in tiles(len(left), len(right)):
            links.add(sq_dists(a[lo:hi], b)[0] <= eps * eps, slice(lo, hi), slice(None))
        return links.stars()
    return kernel


def run_pairs(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(left_pdf, right_pdf, diagonal)``, an iterator of frames, on every block
    pair of sparse rows (id, idx, w, _blk, _pa, _pb)."""
    def group_fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, diag = split_pair(pd.concat(list(batches), ignore_index=True))
        if len(left) and len(right):
            yield from kernel(left, right, diag)
    return rows.groupBy("_pa", "_pb").applyInPandas(group_fn, schema)


def _sparse_tiles(left: pd.DataFrame, right: pd.DataFrame, diag: bool, dim: int):
    """(rows, columns, sq_dists) of the tiles of a block pair; on the diagonal those
    on or above it (rows are sorted by id)."""
    from .cells import COLUMN_STEP, Rows, sq_dists as sparse_sq_dists
    a = Rows(left, "sparse", dim)
    b = a if diag else Rows(right, "sparse", dim)
    step = int(math.sqrt(TILE_CELLS))
    for top in range(0, a.n, step):
        x = a.part(top, min(a.n, top + step))
        # columns of zeros add nothing to a distance
        cols = np.unique(x.idx)
        wide = len(cols) > COLUMN_STEP
        dense = None if wide else x.columns(cols)
        for lo in range(top if diag else 0, b.n, step):
            y = b.part(lo, min(b.n, lo + step))
            at = slice(top, top + x.n), slice(lo, lo + y.n)
            yield *at, sparse_sq_dists(x, y) if wide else _sq_dists_on(x, y, cols, dense)


def _sq_dists_on(x, y, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Squared distances of sparse rows; ``dense``: those of x on all the columns they use."""
    other = y.columns(cols)
    d2 = x.sq[:, None] + y.sq[None, :] - 2.0 * (dense @ other.T)
    rest = y.sq - np.einsum("ij,ij->i", other, other)       # what y has outside these columns
    r, c = np.nonzero(d2 <= 1e-7 * (x.sq[:, None] + y.sq[None, :]))
    for at in range(0, len(r), 4096):
        i, j = r[at:at + 4096], c[at:at + 4096]
        diff = dense[i] - other[j]
        d2[i, j] = np.einsum("ij,ij->i", diff, diff) + np.where(rest[j] > 1e-12, rest[j], 0.0)
    return np.maximum(d2, 0.0, out=d2)


def sparse_pairs_kernel(dim: int, eps: float):
    """Pairs (i < j) of sparse rows with distance <= eps, a frame per tile."""
    def kernel(left, right, diag):
        ida, idb = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        for rows, columns, d2 in _sparse_tiles(left, right, diag, dim):
            near = d2 <= eps * eps
            if diag:
                near &= ida[rows, None] < idb[None, columns]
            r, c = np.nonzero(near)
            i, j, d2 = ida[rows][r], idb[columns][c], d2[r, c]
            yield pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "dist": np.sqrt(d2), "sim": 1.0 - d2 / 2.0})
    return kernel


def sparse_links_kernel(dim: int, eps: float):
    """Star edges of the components of a block pair of sparse rows."""
    def kernel(left, right, diag):
        links = Links(left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64))
        for rows, columns, d2 in _sparse_tiles(left, right, diag, dim):
            links.add(d2 <= eps * eps, rows, columns)
        yield links.stars()
    return kernel


FOREST_SCHEMA = "i long, j long, dist double"


def forest_kernel(mutual_reachability: bool = False):
    """Minimum spanning forest of a block pair's own edges: all pairs inside a
    block, or all pairs between two blocks. Prim's rule on the distance matrix,
    ties by (distance, smaller id, larger id). With ``mutual_reachability`` the
    distance is max(d, core_a, core_b), the rows carrying a ``core`` column."""
    def kernel(left, right, a, b, diag):
        none = pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "dist": np.zeros(0)})
        d2, _, _, _ = sq_dists(a, b)
        if mutual_reachability:
            ka, kb = left["core"].to_numpy(np.float64), right["core"].to_numpy(np.float64)
            d2 = np.maximum(d2, np.maximum(ka[:, None] ** 2, kb[None, :] ** 2))
        ida, idb = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        n, m = d2.shape
        ids = ida if diag else np.concatenate([ida, idb])
        total = len(ids)
        if total < 2:
            return none
        out_w = np.full(total, np.inf)          # best edge from the tree to each row
        out_lo = np.zeros(total, np.int64)
        out_hi = np.zeros(total, np.int64)
        done = np.zeros(total, bool)
        edges_i, edges_j, edges_d = [], [], []
        cur = 0
        for _ in range(total - 1):
            done[cur] = True
            if diag:
                reach, w = np.arange(n), d2[cur]
            elif cur < n:
                reach, w = np.arange(n, n + m), d2[cur]
            else:
                reach, w = np.arange(n), d2[:, cur - n]
            lo, hi = np.minimum(ids[reach], ids[cur]), np.maximum(ids[reach], ids[cur])
            better = ~done[reach] & ((w < out_w[reach]) | ((w == out_w[reach]) & (
                (lo < out_lo[reach]) | ((lo == out_lo[reach]) & (hi < out_hi[reach])))))
            at = reach[better]
            out_w[at], out_lo[at], out_hi[at] = w[better], lo[better], hi[better]
            open_w = np.where(done, np.inf, out_w)
            least = open_w.min()
            if not np.isfinite(least):
                break
            tied = np.flatnonzero(open_w == least)
            cur = int(tied[np.lexsort((out_hi[tied], out_lo[tied]))[0]])
            edges_i.append(out_lo[cur])
            edges_j.append(out_hi[cur])
            edges_d.append(least)
        return pd.DataFrame({"i": np.array(edges_i, np.int64), "j": np.array(edges_j, np.int64),
                             "dist": np.sqrt(np.array(edges_d, np.float64))})
    return kernel

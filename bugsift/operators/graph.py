"""Graph operators on edge tables: connected components and minimum spanning forest.

Both are iterative DataFrame jobs. Each round's state is cut with a reliable
checkpoint (so a lost executor recomputes one round, not the whole history),
the loop stops on a fixed point, and a round cap raises instead of returning
a partial answer. No step gathers the graph in one task: tasks first reduce
what they hold (components or a forest of their own edges), rounds do the rest,
and inputs of every size take the same path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import count_round, cut_lineage, drop_state

# The last edges of a forest, few of which join few components, are finished in one
# task (a constant, far below any input's size).
TAIL_EDGES = 4096


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).collect()[0]
    return (row["n"], row["h"])


def min_label_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and their component (smallest vertex id) for edges a-b, by
    vectorised hooking + pointer jumping."""
    verts, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a):]
    lab = np.arange(len(verts))
    while True:
        m = np.minimum(lab[ia], lab[ib])
        new = lab.copy()
        np.minimum.at(new, lab[ia], m)
        np.minimum.at(new, lab[ib], m)
        np.minimum.at(new, ia, m)
        np.minimum.at(new, ib, m)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, lab):
            break
        lab = new
    return verts, verts[lab]


def _contract_partitions(e: DataFrame) -> DataFrame:
    """Replace each partition's edges by star edges to local component minima
    (same connectivity, at most one edge per vertex of the partition, which is
    also all that is held)."""
    def run(batches):
        v = c = np.zeros(0, np.int64)
        for pdf in batches:
            v, c = min_label_components(np.concatenate([v, pdf["hi"].to_numpy(np.int64)]),
                                        np.concatenate([c, pdf["lo"].to_numpy(np.int64)]))
        keep = v != c
        yield pd.DataFrame({"hi": v[keep], "lo": c[keep]})
    return e.mapInPandas(run, "hi long, lo long")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, *,
                         src: str = "i", dst: str = "j", vertex_col: str = "id",
                         max_rounds: int = 64) -> DataFrame:
    """``(id, component)`` with component = smallest vertex id of the component.

    Each partition first contracts its own edges to star edges; alternating
    large-star / small-star rounds (Kiveris et al., 2014) over the whole edge
    table follow, each checkpointed, until nothing changes. Vertices without
    edges (from ``vertices``) are their own component.
    """
    e = (edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
         .where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    e = cut_lineage(_contract_partitions(e).distinct())
    prev = _fingerprint(e)
    for _ in range(max_rounds):
        count_round("components")
        # large star: link every larger neighbour of u to m(u) = min(N(u) + u)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(m, "u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # small star: link u and its smaller neighbours to the smallest of them
        sm = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(sm, "hi")
                 .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
                         F.col("m").alias("lo"))
                 .where(F.col("hi") != F.col("lo")).distinct())
        old, e = e, cut_lineage(small)
        drop_state(old)
        cur = _fingerprint(e)
        if cur == prev:
            break
        prev = cur
    else:
        raise RuntimeError(f"connected_components did not converge in {max_rounds} rounds")
    out = e.select(F.col("hi").alias(vertex_col), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias(vertex_col), F.col("lo").alias("component")).distinct())
    if vertices is not None:
        v = vertices.select(F.col(vertex_col).cast("long").alias(vertex_col)).distinct()
        out = v.join(out, vertex_col, "left").select(
            vertex_col, F.coalesce("component", F.col(vertex_col)).alias("component"))
    return cut_lineage(out)  # consumed more than once downstream


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, i: np.ndarray | None = None,
                    j: np.ndarray | None = None) -> np.ndarray:
    """Positions of the edges (a < b) in the minimum spanning forest; ties by
    (weight, a, b), or by (weight, i, j) where a and b are components that the
    edges' ends i and j are part of. Borůvka rounds on arrays."""
    verts, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a):]
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b if j is None else j, a if i is None else i, w))] = np.arange(len(a))
    lab = np.arange(len(verts))
    keep = np.zeros(len(a), bool)
    live = np.arange(len(a))
    while True:
        live = live[lab[ia[live]] != lab[ib[live]]]
        if not len(live):
            return np.flatnonzero(keep)
        best = np.full(len(verts), len(a), np.int64)
        np.minimum.at(best, lab[ia[live]], rank[live])
        np.minimum.at(best, lab[ib[live]], rank[live])
        chosen = live[np.isin(rank[live], best)]
        keep[chosen] = True
        v, c = min_label_components(lab[ia[chosen]], lab[ib[chosen]])
        to = np.arange(len(verts))
        to[v] = c
        lab = to[lab]


def _last_forest(edges: DataFrame) -> DataFrame:
    """The forest of at most ``TAIL_EDGES`` contracted edges, in one task."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ci, cj, i, j = (pdf[c].to_numpy(np.int64) for c in ("ci", "cj", "i", "j"))
        return pdf.iloc[spanning_forest(ci, cj, pdf["dist"].to_numpy(np.float64), i, j)][["i", "j", "dist"]]
    return edges.groupBy(F.lit(0).alias("_g")).applyInPandas(run, "i long, j long, dist double")


def _forest_partitions(edges: DataFrame) -> DataFrame:
    """Each partition's edges reduced to their own minimum spanning forest (an
    edge left out of it closes a cycle of smaller edges, so it is in no forest)."""
    def run(batches):
        a = b = np.zeros(0, np.int64)
        w = np.zeros(0)
        for pdf in batches:
            a = np.concatenate([a, pdf["i"].to_numpy(np.int64)])
            b = np.concatenate([b, pdf["j"].to_numpy(np.int64)])
            w = np.concatenate([w, pdf["dist"].to_numpy(np.float64)])
            own = spanning_forest(a, b, w)
            a, b, w = a[own], b[own], w[own]
        yield pd.DataFrame({"i": a, "j": b, "dist": w})
    return edges.mapInPandas(run, "i long, j long, dist double")


def minimum_spanning_forest(vectors, *, edges: DataFrame | None = None, core: DataFrame | None = None,
                            max_rounds: int = 64) -> DataFrame:
    """Exact Euclidean minimum spanning forest ``(i, j, dist)``, i < j.

    With ``edges`` (``i, j, dist``), the forest of that graph; otherwise of the
    complete graph over ``vectors``. With ``core`` (``id, core_dist``) the
    weights are mutual reachability distances max(d, core_i, core_j). Ties are
    broken by (dist, i, j), so the forest is unique.

    The complete graph is never listed: one pass over block pairs returns each
    pair's own forest (at most its rows), whose union holds the whole forest.
    Borůvka rounds then run on the remaining edge table."""
    from .blocks import FOREST_SCHEMA, forest_kernel
    from .pairs import _run
    if edges is None:
        v = vectors.df.withColumnRenamed(vectors.id_col, "id") if vectors.id_col != "id" else vectors.df
        extra = ()
        if core is not None:
            v, extra = v.join(core.select("id", F.col("core_dist").alias("core")), "id"), ("core",)
        from dataclasses import replace
        edges = _run(replace(vectors, df=v, id_col="id"), forest_kernel(core is not None), FOREST_SCHEMA, extra=extra)
    else:
        edges = edges.where(F.col("i") != F.col("j")).select(
            F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"),
            F.col("dist").cast("double").alias("dist"))
    left = cut_lineage(_forest_partitions(edges).groupBy("i", "j").agg(F.min("dist").alias("dist")))
    forest = None
    comp = None
    for _ in range(max_rounds):
        count_round("boruvka")
        ends = left.select("i", "j", "dist", F.col("i").alias("ci"), F.col("j").alias("cj")) if comp is None else (
            left.join(comp.select(F.col("id").alias("i"), F.col("component").alias("ci")), "i")
            .join(comp.select(F.col("id").alias("j"), F.col("component").alias("cj")), "j")
            .where(F.col("ci") != F.col("cj")).select("i", "j", "dist", "ci", "cj"))
        size = Observation()
        left = cut_lineage(ends.observe(size, F.count(F.lit(1)).alias("n")))
        if size.get["n"] <= TAIL_EDGES:
            last = _last_forest(left)
            return cut_lineage(last if forest is None else forest.unionByName(last))
        both = left.select(F.col("ci").alias("c"), "i", "j", "dist").unionByName(
            left.select(F.col("cj").alias("c"), "i", "j", "dist"))
        new = cut_lineage(both.groupBy("c").agg(F.min(F.struct("dist", "i", "j")).alias("e"))
                          .select("e.i", "e.j", "e.dist").distinct())
        forest = new if forest is None else cut_lineage(forest.unionByName(new))
        ids = left.select(F.col("i").alias("id")).unionByName(left.select(F.col("j").alias("id"))).distinct()
        comp = connected_components(forest, ids)
        left = left.select("i", "j", "dist")
    else:
        raise RuntimeError("minimum_spanning_forest did not converge")

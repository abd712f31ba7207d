"""Pair operators: cosine similarities, epsilon (range) joins, k-th neighbour.

Vectors come in two shapes:

* ``Vectors.dense(df, id, array_col)``: fixed-length arrays (embeddings);
* ``Vectors.sparse(features)``: weight rows from ``features.fit_transform``
  (sorted term indices + weights over a vocabulary of known size).

Both run through the block-pair kernels (``blocks.py``): exact results, work
spread over B(B+1)/2 tasks, output bounded by the answer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks, cells
from .features import Features
from ..session import cut_lineage, default_parallelism
from .ranking import ordered_index

# Block kernels do n^2 * dim / 2 multiply-adds; above this the sparse
# inverted-index join (prefix filtering) is used instead.
BLOCKS_MAX_WORK = 1e12
# Most ids whose positions are broadcast, and rows of a column block that one task takes.
BROADCAST_IDS = 2_000_000
CHUNK_ROWS = 1 << 16


@dataclass
class Vectors:
    df: DataFrame      # id, vec | (idx, w)
    id_col: str
    kind: str          # 'dense' | 'sparse'
    dim: int
    n_rows: int
    unit_or_zero: bool = False   # sparse L2 rows: every row has norm 1 or 0
    vocab: DataFrame | None = None  # sparse: term_idx, df (for the index join's term order)

    @staticmethod
    def dense(df: DataFrame, id_col: str, vec_col: str) -> "Vectors":
        v = df.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("vec"))
        row = v.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("lo"),
                    F.max(F.size("vec")).alias("hi")).collect()[0]
        if row["n"] and row["lo"] != row["hi"]:
            raise ValueError("vectors must all have the same length")
        return Vectors(v, id_col, "dense", int(row["hi"] or 0), int(row["n"]))

    @staticmethod
    def sparse(features: Features) -> "Vectors":
        rows = features.rows.select(
            F.col(features.id_col),
            F.transform("vec", lambda e: e["term_idx"]).alias("idx"),
            F.transform("vec", lambda e: e["w"]).alias("w"))
        dim = features.vocab.count()
        unit = features_are_unit(features)
        return Vectors(rows, features.id_col, "sparse", dim, features.n_docs, unit_or_zero=unit,
                       vocab=features.vocab.select("term_idx", "df"))

    def where_ids(self, cond) -> "Vectors":
        """Same vectors restricted by a row condition (row count recomputed)."""
        from dataclasses import replace
        sub = self.df.where(cond)
        return replace(self, df=sub, n_rows=sub.count())

    def with_ids(self) -> DataFrame:
        return self.df.select(F.col(self.id_col).alias("id"))


def collapse_duplicates(v: Vectors, exact_count: bool = True) -> tuple[Vectors, DataFrame, DataFrame]:
    """Identical rows -> one representative (smallest id) with a weight.

    Returns (representative vectors, ``(id, w)`` weights, ``(id, rep)`` for
    every row). A group of copies -- even a third of all rows -- becomes one
    row: partial aggregation absorbs the hot key, and the member mapping is a
    join whose skewed side AQE splits."""
    key = ["vec"] if v.kind == "dense" else ["idx", "w"]
    rows = v.df.select(F.col(v.id_col).alias("id"), *key)
    groups = cut_lineage(rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    reps_df = groups.select(F.col("rep").alias(v.id_col), *key)
    # without exact_count the input row count stands in as an upper bound (block planning)
    reps = replace(v, df=reps_df, n_rows=groups.count() if exact_count else v.n_rows)
    weights = groups.select(F.col("rep").alias("id"), F.col("n").alias("w"))
    members = rows.join(groups.select(*key, "rep"), key).select("id", "rep")
    return reps, weights, members


def features_are_unit(features: Features) -> bool:
    """Whether every row has norm 1 or 0 (L2-normalised features)."""
    return features.norm == "l2"


def _run(v: Vectors, kernel, schema: str, extra=(), rows_per_block: int | None = None):
    return blocks.run(v.df.withColumnRenamed(v.id_col, "id") if v.id_col != "id" else v.df,
                      id_col="id", kind=v.kind, dim=max(1, v.dim), kernel=kernel, schema=schema,
                      extra_cols=extra, n_rows=v.n_rows, rows_per_block=rows_per_block)


def _cells(v: Vectors) -> cells.Cells:
    df = v.df.withColumnRenamed(v.id_col, "id") if v.id_col != "id" else v.df
    return cells.assign(df, v.kind, max(1, v.dim), v.n_rows)


def complete_graph(v: Vectors, eps: float) -> bool:
    """True when every pair is within eps without looking at the data: unit/zero
    rows with eps >= sqrt(2), or eps >= 1 with at least one zero row (it links
    to everything, and zero rows link to each other)."""
    if not v.unit_or_zero:
        return False
    if eps >= math.sqrt(2.0):
        return True
    if eps >= 1.0:
        return v.df.where(F.size("idx") == 0).limit(1).count() > 0
    return False


def choose_method(v: Vectors) -> str:
    if v.kind == "dense":
        return "cells"
    if not v.unit_or_zero or v.vocab is None:
        return "blocks"
    work = float(v.n_rows) * float(v.n_rows) * max(1, v.dim) / 2.0
    return "blocks" if work <= BLOCKS_MAX_WORK else "index"


def epsilon_join(v: Vectors, eps: float, method: str = "auto") -> DataFrame:
    """All pairs (i < j) with Euclidean distance <= eps: ``(i, j, dist)``.

    ``method``: ``cells`` (metric cells that skip what lies too far, any vectors),
    ``blocks`` (block-pair matrix products, any vectors) or ``index`` (sparse unit
    rows: inverted-index join with prefix filtering, output-sensitive). ``auto``:
    cells for dense rows, for sparse ones by the n^2 * dim work."""
    if complete_graph(v, eps):
        raise ValueError(f"eps={eps} links every pair of these rows; "
                         "use dbscan(on_complete_graph='single_cluster') instead of listing n^2 pairs")
    m = choose_method(v) if method == "auto" else method
    if m == "cells":
        return cells.range_pairs(_cells(v), eps)
    if m == "blocks":
        out = _run(v, blocks.threshold_pairs_kernel(eps=eps), blocks.PAIR_SCHEMA, rows_per_block=blocks.tiled_rows(v.dim))
        return out.select("i", "j", "dist")
    if m != "index":
        raise ValueError(f"unknown method {method!r}")
    return _index_join(v, eps).select("i", "j", "dist")


def _index_join(v: Vectors, eps: float, kernel=None, schema: str = blocks.PAIR_SCHEMA) -> DataFrame:
    """Exact eps-join of L2-normalised sparse rows (norm 1, or 0 for rows with
    no term), after Bayardo et al. (2007) with an L2 suffix bound.

    Terms are ordered globally by (df, term_idx), rare first. A row indexes
    its entries while the norm of the remaining suffix is >= s = 1 - eps^2/2;
    two rows with cos >= s must share an indexed term (the shared terms
    outside both prefixes lie in one row's suffix, whose norm is < s). Rows are
    cut into blocks in the order of their rarest indexed term, and only blocks
    that share an indexed term meet: what is exchanged is rows per block pair,
    never a candidate pair, and a block pair takes its products tile by tile
    (``kernel``: ``blocks.sparse_pairs_kernel`` or ``sparse_links_kernel``)."""
    if v.kind != "sparse" or v.vocab is None or not v.unit_or_zero:
        raise ValueError("the index method needs L2-normalised sparse rows")
    s = 1.0 - eps * eps / 2.0
    order = ordered_index(v.vocab.select("term_idx", "df"), ["df", "term_idx"], "ord")
    rows = v.df.select(F.col(v.id_col).cast("long").alias("id"), "idx", "w").where(F.col("id").isNotNull())
    long = rows.select("id", F.explode(F.arrays_zip("idx", "w")).alias("e")) \
               .select("id", F.col("e.idx").alias("term_idx"), F.col("e.w").alias("w"))
    long = long.join(order.select("term_idx", "ord"), "term_idx")
    suffix = Window.partitionBy("id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    post = long.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(suffix))) \
               .where(F.col("rest") >= s - 1e-9).groupBy("id").agg(F.sort_array(F.collect_list("ord")).alias("indexed"))
    # rows without a term are equal to each other and meet in the blocks before the first term
    at = ordered_index(rows.join(post, "id", "left").select(
        "id", "idx", "w", F.coalesce("indexed", F.array(F.lit(-1).cast("long"))).alias("indexed")),
        [F.col("indexed")[0], "id"], "at")
    n_blocks = blocks.plan_blocks(v.n_rows, v.dim, default_parallelism(v.df.sparkSession), blocks.SPARSE_BLOCK_ROWS)
    at = at.withColumn("_blk", F.least(F.floor(F.col("at") * n_blocks / max(1, v.n_rows)), F.lit(n_blocks - 1)).cast("int"))
    of = at.select(F.explode("indexed").alias("term"), "_blk").groupBy("term").agg(F.collect_set("_blk").alias("in"))
    meet = (of.groupBy("in").agg(F.count(F.lit(1)))         # few different sets of blocks
            .select("in", F.explode("in").alias("_pa")).select("_pa", F.explode("in").alias("_pb"))
            .where("_pa <= _pb").distinct())
    meet = cut_lineage(meet.select("_pa", "_pb", F.explode(F.array_distinct(F.array("_pa", "_pb"))).alias("_blk")))
    both = at.select("id", "idx", "w", "_blk").join(F.broadcast(meet), "_blk")      # a row per pair of blocks
    return blocks.run_pairs(both, kernel or blocks.sparse_pairs_kernel(v.dim, eps), schema)


def links_each(v: Vectors, eps: list[float]) -> DataFrame:
    """``(level, i, j)``: for every distance ``eps[level]`` edges with the components of
    its graph, from one meeting of the cells; its pairs are not listed."""
    return cells.range_links_each(_cells(v), eps)


def links(v: Vectors, eps: float, method: str = "auto") -> DataFrame:
    """``(i, j)``: edges with the components of the eps-graph, star edges of each meeting
    of blocks instead of its pairs. Methods as in ``epsilon_join``."""
    m = choose_method(v) if method == "auto" else method
    if m == "cells":
        return cells.range_links(_cells(v), eps)
    if m == "blocks":
        return _run(v, blocks.linked_kernel(eps), blocks.LINK_SCHEMA, rows_per_block=blocks.tiled_rows(v.dim))
    if m != "index":
        raise ValueError(f"unknown method {method!r}")
    return _index_join(v, eps, blocks.sparse_links_kernel(v.dim, eps), blocks.LINK_SCHEMA)


def pairwise_cosine(v: Vectors, min_similarity: float | None = None) -> DataFrame:
    """Pairs (i < j) with their cosine similarity: ``(i, j, sim)``, all n(n-1)/2 of them
    as in the reference's matrix, or those >= min_similarity. A row of zeros has
    similarity 0 with every row. Blocks meet in tasks of bounded memory; the list
    of all pairs is quadratic."""
    if min_similarity is not None and min_similarity <= 0:
        raise ValueError("min_similarity must be > 0; leave it out for all pairs")
    if min_similarity is not None and choose_method(v) == "index" and min_similarity <= 1.0:
        # unit rows: cos >= s  <=>  distance <= sqrt(2 - 2s); rows without terms have cos 0
        nonzero = v.where_ids(F.size("idx") > 0)
        eps = math.sqrt(max(0.0, 2.0 - 2.0 * min_similarity))
        return _index_join(nonzero, eps).select(
            "i", "j", (F.lit(1.0) - F.col("dist") * F.col("dist") / 2.0).alias("sim"))
    return _run(v, blocks.cosine_pairs_kernel(min_similarity), blocks.COSINE_SCHEMA, rows_per_block=blocks.tiled_rows(v.dim))


def similarity_matrix(pairs: DataFrame, ids: DataFrame, value: str = "sim") -> DataFrame:
    """Long form of the symmetric matrix: both orientations, taken from one pass over
    the pairs, plus the diagonal."""
    diag = ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias(value))
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col(value).alias(value)),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias(value)))))
    return both.unionByName(diag)


def similarity_matrix_wide(long: DataFrame, value: str = "sim") -> DataFrame:
    """Square matrix with one column per id (``groupBy(i).pivot(j)``); only for
    small n: refuses more columns than ``spark.sql.pivotMaxValues``."""
    spark = long.sparkSession
    cap = int(spark.conf.get("spark.sql.pivotMaxValues", "10000"))
    ids = [r[0] for r in long.select("j").distinct().orderBy("j").limit(cap + 1).collect()]
    if len(ids) > cap:
        raise ValueError(f"more than {cap} columns; keep the long (i, j, {value}) form")
    return long.groupBy("i").pivot("j", ids).agg(F.first(value)).orderBy("i")


def similarity_blocks(pairs: DataFrame, ids: DataFrame, block: int = 256, value: str = "sim") -> DataFrame:
    """The square matrix as chunks ``(row_id, row, block, vals)``: of each row the values of
    ``block`` columns in id order (0 where the long form has no pair, 1 on the
    diagonal). Any number of columns: a chunk is one short array, and chunks without a
    value are left out. Write it partitioned by ``block`` to read column blocks alone."""
    at = cut_lineage(ordered_index(ids.select("id").distinct(), ["id"], "p"))
    n = at.count()
    # ids become (position, id) before the matrix is made, so only its entries are shuffled, once
    place = at.select("id", F.struct("p", "id").alias("at"))
    if n <= BROADCAST_IDS:
        place = F.broadcast(place)
    placed = (pairs.join(place.select(F.col("id").alias("i"), F.col("at").alias("ai")), "i")
              .join(place.select(F.col("id").alias("j"), F.col("at").alias("aj")), "j")
              .select(F.col("ai").alias("i"), F.col("aj").alias("j"), value))
    long = similarity_matrix(placed, ids.join(place, "id").select(F.col("at").alias("id")), value).select(
        F.col("i.id").alias("row_id"), F.col("i.p").alias("row"), F.floor(F.col("j.p") / block).alias("block"),
        F.struct((F.col("j.p") % block).cast("int").alias("k"), F.coalesce(value, F.lit(0.0)).alias("x")).alias("e"))
    # a column block lies in one task (CHUNK_ROWS rows of it at most) and is written as one
    # file; chunks are put in order as their entries, before they are filled up with zeros
    chunks = (long.withColumn("_part", F.floor(F.col("row") / CHUNK_ROWS))
              .repartition(default_parallelism(pairs.sparkSession), "block", "_part")
              .groupBy("block", "_part", "row", "row_id").agg(F.sort_array(F.collect_list("e")).alias("es"))
              .sortWithinPartitions("block"))
    width = F.least(F.lit(block), F.lit(n) - F.col("block") * block).cast("int")

    def zeros(count):
        return F.array_repeat(F.lit(0.0), count)

    def after_gap(e, t):
        gap = e["k"] - F.when(t > 0, F.get("es", t - 1)["k"]).otherwise(F.lit(-1)) - 1
        return F.when(gap < 0, F.raise_error(F.lit("similarity_blocks: a pair or an id comes twice")).cast("array<double>")) \
                .otherwise(F.concat(zeros(gap), F.array(e["x"])))
    return chunks.select("row_id", "row", "block", F.concat(
        F.flatten(F.transform("es", after_gap)), zeros(width - F.element_at("es", -1)["k"] - 1)).alias("vals"))


def kth_neighbor_distance(v: Vectors, k: int) -> DataFrame:
    """``(id, core_dist)``: distance to the k-th nearest point, the point itself
    counted first (so k=1 gives 0 with no join at all)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    ids = v.with_ids()
    if k == 1:
        return ids.select("id", F.lit(0.0).alias("core_dist"))
    near = cells.nearest(_cells(v), k - 1)
    kth = near.where(F.size("near") >= k - 1).select("id", F.element_at("near", k - 1)["dist"].alias("core_dist"))
    return ids.join(kth, "id", "left")

"""Distributed ordinal numbering.

A window ``row_number() OVER (ORDER BY k)`` without ``PARTITION BY`` runs in one
task. ``ordered_index`` numbers rows 0..n-1 in key order instead with a range
partitioning (sampled bounds), a sort inside each range, a reliable checkpoint
that freezes the ranges, and a tiny table of per-range counts turned into
offsets. Only that table (one row per partition) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, default_parallelism


def ordered_index(df: DataFrame, order_cols: list[str | Column], index_col: str = "idx",
                  num_partitions: int | None = None) -> DataFrame:
    """Append ``index_col`` = 0-based position of each row in ``order_cols`` order."""
    parts = num_partitions or default_parallelism(df.sparkSession)
    ranged = (
        df.repartitionByRange(parts, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by num_partitions, safe to broadcast
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(index_col, (F.col("_off") + pos).cast("long"))
        .drop("_pid", "_mono", "_off")
    )


def dense_index(df: DataFrame, key_cols: list[str], index_col: str = "idx",
                group_cols: list[str] | None = None) -> DataFrame:
    """Dense rank (0-based) of the distinct ``key_cols``; restarts per ``group_cols``.

    Returns one row per distinct (group_cols, key_cols) with ``index_col``.
    """
    group_cols = group_cols or []
    keys = df.select(*group_cols, *key_cols).distinct()
    idx = ordered_index(keys, [*group_cols, *key_cols], index_col)
    if not group_cols:
        return idx
    first = idx.groupBy(*group_cols).agg(F.min(index_col).alias("_first"))
    return (idx.join(first, group_cols)
            .withColumn(index_col, F.col(index_col) - F.col("_first")).drop("_first"))


def range_groups(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` range-partitioned by (group, order) and stored, its partition as ``_pid``:
    a group of any size is spread over partitions in order."""
    parts = default_parallelism(df.sparkSession)
    return cut_lineage(df.repartitionByRange(parts, group, order).withColumn("_pid", F.spark_partition_id()))


def running(ranged: DataFrame, group: str, order: str, *, sums: dict[str, str] | None = None,
            lasts: dict[str, str] | None = None) -> DataFrame:
    """Over the rows before each row of its group, by ``order`` (unique in a group): the
    sum of a column (``sums``: new name -> column) and its last value that is not null
    (``lasts``). ``ranged`` comes from ``range_groups``: windows stay within a
    partition, and what a group holds in earlier partitions is one row for each."""
    sums, lasts = sums or {}, lasts or {}
    inside = Window.partitionBy("_pid", group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()],
                          *[F.last(c, ignorenulls=True).over(inside).alias(f"_in_{n}") for n, c in lasts.items()])
    whole = ranged.groupBy("_pid", group).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("_o"), F.col(c).alias("_v"))))["_v"].alias(n)
          for n, c in lasts.items()])
    before = whole.select("_pid", group, *[F.sum(n).over(earlier).alias(f"_pre_{n}") for n in sums],
                          *[F.last(n, ignorenulls=True).over(earlier).alias(f"_pre_{n}") for n in lasts])
    out = local.join(before, ["_pid", group])
    for n in sums:
        out = out.withColumn(n, F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_pre_{n}", F.lit(0)))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(f"_in_{n}", f"_pre_{n}"))
    return out.drop(*[f"_{k}_{n}" for k in ("in", "pre") for n in (*sums, *lasts)])

"""Batched processing with resumable snapshots.

The reference submits reports 100 at a time and, after every batch, writes a
file holding all results so far. Here a result table is written once,
partitioned by ``batch_id``; snapshot *i* is a read with ``batch_id <= i``
(partition pruning), and resuming is an anti join against finished ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ordered_index


def assign_batches(df: DataFrame, id_col: str, size: int = 100) -> DataFrame:
    """Adds ``batch_id`` and ``pos`` (0-based order by id) in chunks of ``size``."""
    if size < 1:
        raise ValueError("size must be >= 1")
    idx = ordered_index(df, [id_col], "pos")
    return idx.withColumn("batch_id", F.floor(F.col("pos") / size).cast("long"))


def snapshot_sizes(batched: DataFrame) -> DataFrame:
    """``(snapshot_id, n_rows)``: rows visible in snapshot i (batches 0..i).

    Batches are contiguous runs of positions, so snapshot i ends at the
    largest position of batch i: no running sum is needed."""
    return batched.groupBy(F.col("batch_id").alias("snapshot_id")).agg(
        (F.max("pos") + 1).cast("long").alias("n_rows"))


def write_batch_snapshots(results: DataFrame, path: str, mode: str = "append") -> None:
    """Append results partitioned by batch; re-running a batch replaces nothing
    else (use ``mode='overwrite'`` with dynamic partition overwrite)."""
    results.write.mode(mode).partitionBy("batch_id").parquet(path)


def read_snapshot(spark: SparkSession, path: str, snapshot_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("batch_id") <= snapshot_id)


def resume_pending(todo: DataFrame, finished: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``todo`` whose id is not in ``finished`` (left anti join)."""
    return todo.join(finished.select(id_col).distinct(), id_col, "left_anti")

"""Stratified train / validation / test split.

Per label with n rows: test = ceil(n / 10), validation = ceil(2/9 of the
rest), train = the remainder (70 / 20 / 10), in integer arithmetic. Rows are
ordered inside a label by md5(seed || id), then id: deterministic and
independent of partitioning.

Ranking does not use ``Window.partitionBy(label)``: one label may hold a third
of all rows, which would be one task. Rows are numbered by a range-partitioned
global sort on (label, hash key, id) and each label's first position is
subtracted (see ``ranking.dense_index``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ordered_index


def stratified_split(df: DataFrame, *, id_col: str, label_col: str, seed: str = "0") -> DataFrame:
    """Adds ``split`` in {'train', 'validation', 'test'}."""
    # only the key columns are sorted and checkpointed; the rest joins back by id
    keyed = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"),
                      F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))).alias("_k"))
    idx = ordered_index(keyed, ["_label", "_k", "_id"], "_g")
    per_label = idx.groupBy("_label").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    test = F.floor((n + 9) / 10)
    rest = n - test
    val = F.floor((2 * rest + 8) / 9)
    rank = F.col("_g") - F.col("_first")  # 0-based within the label
    split = (F.when(rank < test, F.lit("test"))
             .when(rank < test + val, F.lit("validation"))
             .otherwise(F.lit("train")))
    per_label = per_label.withColumnRenamed("_label", "_of")
    drawn = idx.join(per_label, F.col("_label").eqNullSafe(F.col("_of"))).select("_id", split.alias("split"))
    return df.join(drawn, F.col(id_col) == F.col("_id")).drop("_id")


def split_counts(split_df: DataFrame, label_col: str) -> DataFrame:
    return split_df.groupBy(label_col, "split").agg(F.count(F.lit(1)).alias("n"))


def concat_splits(split_df: DataFrame) -> dict[str, DataFrame]:
    """The three pieces as separate frames (stack them with ``unionByName``)."""
    return {s: split_df.where(F.col("split") == s) for s in ("train", "validation", "test")}

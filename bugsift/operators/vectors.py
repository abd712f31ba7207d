"""Dense vector columns: norms, per-dimension standardisation, attaching encodings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def norms(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return df.select(id_col, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


def dimension_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """``(dim, mean, std)`` with the population std; one row per dimension."""
    ex = df.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "x"))
    return ex.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardize_long(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, dim, z)`` with z = (x - mean) / std per dimension (std 0 -> divide by 1).

    The statistics table has one row per dimension (the vector length), so it
    is broadcast under that bound."""
    stats = dimension_stats(df, vec_col)
    ex = df.select(id_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "x"))
    scale = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return ex.join(F.broadcast(stats), "dim").select(id_col, "dim", ((F.col("x") - F.col("mean")) / scale).alias("z"))


def standardize(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Array form of ``standardize_long``: ``(id, vec)``. The per-dimension
    statistics (vector length entries) are inlined as literal arrays."""
    rows = dimension_stats(df, vec_col).orderBy("dim").collect()
    means = F.array(*[F.lit(float(r["mean"])) for r in rows])
    scales = F.array(*[F.lit(float(r["std"]) if r["std"] else 1.0) for r in rows])
    v = F.col(vec_col).cast("array<double>")
    z = F.zip_with(F.zip_with(v, means, lambda x, m: x - m), scales, lambda d, s: d / s)
    return df.select(id_col, z.alias("vec"))


def attach_embeddings(df: DataFrame, *, id_col: str, text_col: str,
                      encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> DataFrame:
    """``(id, vec array<float>)`` from a user encoder, loaded once per task.

    ``encoder_factory()`` returns ``encode(texts) -> (n, dim) array``; the
    encoder runs on Arrow batches inside ``mapInPandas``."""
    def run(batches):
        encode = encoder_factory()
        for pdf in batches:
            mat = np.asarray(encode(pdf[text_col].fillna("").tolist()), dtype=np.float32).reshape(len(pdf), dim)
            yield pd.DataFrame({id_col: pdf[id_col].values, "vec": list(mat)})
    id_type = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, vec array<float>")

"""Mini-batch k-means (Sculley, 2010): centres move by hash-drawn batches, each with
a learning rate that falls with the rows it has seen. Only the k centres leave the
tasks; sums of a batch are made where its rows are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, TURN, RANGE = 2_654_435_761, 40_503, 1 << 32


def draw(id_col: Column, turn: int, seed: int) -> Column:
    """A number below 2 ** 32 for every row and turn."""
    return (F.pmod(id_col.cast("long"), F.lit(1_000_003)) * STEP + (turn * 7_919 + seed) * TURN) % RANGE


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)


def minibatch_kmeans(df: DataFrame, *, id_col: str, vec_col: str, k: int = 7, batch_rows: int = 1024, rounds: int = 10,
                     seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """``(id, label)`` of all rows and the centres. The first centres are the rows of
    smallest draw; a round's batch is every row whose draw falls below
    ``batch_rows / rows``. Ties go to the smaller label; null vectors are refused."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    n, bad = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec").isNull(), 1))).first()
    if bad:
        raise ValueError("null vectors")
    first = rows.orderBy(draw(F.col("id"), 0, seed), "id").limit(k).collect()
    out = df.sparkSession
    if not first:
        return rows.select("id", F.lit(0).alias("label")), np.zeros((0, 0))
    centres = np.array([r["vec"] for r in first], float)
    seen = np.zeros(len(centres))
    most = min(RANGE, -(-batch_rows * RANGE // n))
    for turn in range(1, rounds + 1):
        shared = out.sparkContext.broadcast(centres)

        def sums(batches):
            own = shared.value
            total, count = np.zeros_like(own), np.zeros(len(own), np.int64)
            for pdf in batches:
                if len(pdf):
                    x = np.vstack([np.asarray(v) for v in pdf["vec"].values])
                    lab = _closest(x, own)
                    np.add.at(total, lab, x)
                    np.add.at(count, lab, 1)
            used = np.flatnonzero(count)
            yield pd.DataFrame({"label": used, "n": count[used], "total": pd.Series(list(total[used]), dtype=object)})

        part = (rows.where(draw(F.col("id"), turn, seed) < most).mapInPandas(sums, "label long, n long, total array<double>")
                .select("label", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "at")
                .agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())         # k * dimension numbers
        total, count = np.zeros_like(centres), np.zeros(len(centres))
        for r in part:
            total[r["label"], r["at"]] = r["x"]
            count[r["label"]] = r["n"]
        seen += count
        hit = count > 0
        # the mean over all rows seen: each row moves its centre by 1 / (rows seen so far)
        centres[hit] += (total[hit] - count[hit, None] * centres[hit]) / seen[hit, None]
    shared_end = out.sparkContext.broadcast(centres)

    def label(batches):
        for pdf in batches:
            x = np.vstack([np.asarray(v) for v in pdf["vec"].values]) if len(pdf) else np.zeros((0, centres.shape[1]))
            yield pd.DataFrame({"id": pdf["id"], "label": _closest(x, shared_end.value).astype(np.int32)})

    return rows.mapInPandas(label, "id long, label int"), centres

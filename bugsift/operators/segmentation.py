"""Segmentation learned from the corpus: words of scripts without blanks.

A stretch of up to ``max_len`` code points is a word if it is frequent, if it holds
together (its least mutual information over all cuts into two parts) and if what
stands before and after it varies (the smaller of both branching entropies). All
three are aggregates over the corpus. Runs are then cut along the most probable path
over the words found (Viterbi); a single code point is always a word.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HAN_PATTERN

MAX_WORDS = 200_000


def runs_of(df: DataFrame, text_col: str, pattern: str = f"{HAN_PATTERN}+") -> DataFrame:
    """``(run, n)``: the distinct runs of the pattern in all texts, and their places."""
    return (df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("run"))
            .groupBy("run").agg(F.count(F.lit(1)).alias("n")))


def learn_words(runs: DataFrame, *, max_len: int = 4, min_count: int = 5, min_mutual: float = 1.0,
                min_entropy: float = 0.5) -> DataFrame:
    """``(word, n, mutual, entropy, log_p)`` of the words of two code points or more.
    The least count rises with the corpus so that at most ``MAX_WORDS`` stretches can
    reach it (counts add up to the places)."""
    total = runs.agg(F.sum(F.col("n") * F.length("run"))).first()[0] or 0
    if not total:
        return runs.sparkSession.createDataFrame([], "word string, n long, mutual double, entropy double, log_p double")
    least = max(min_count, -(-total * (max_len - 1) // MAX_WORDS))

    def cuts(size: int):
        def cut(i):
            return F.struct(F.col("run").substr(i, F.lit(size)).alias("word"),
                            F.when(i > 1, F.col("run").substr(i - 1, F.lit(1))).otherwise(F.lit("")).alias("before"),
                            F.col("run").substr(i + size, F.lit(1)).alias("after"))
        return F.when(F.length("run") >= size, F.transform(F.sequence(F.lit(1), F.length("run") - size + 1), cut)).otherwise(
            F.array().cast("array<struct<word: string, before: string, after: string>>"))

    places = runs.select("n", F.inline(F.flatten(F.array(*[cuts(k) for k in range(1, max_len + 1)])))) \
        .groupBy("word", "before", "after").agg(F.sum("n").alias("n"))
    counts = places.groupBy("word").agg(F.sum("n").alias("n"))
    frequent = counts.where((F.length("word") > 1) & (F.col("n") >= least))

    def entropy(side: str) -> DataFrame:
        one = places.groupBy("word", side).agg(F.sum("n").cast("double").alias("m"))
        return one.groupBy("word").agg((F.log(F.sum("m")) - F.sum(F.col("m") * F.log("m")) / F.sum("m")).alias(f"h_{side}"))

    parts = frequent.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select(
        "word", "n", F.expr("substring(word, 1, k)").alias("x"), F.expr("substring(word, k + 1)").alias("y"))
    nx, ny = (counts.select(F.col("word").alias(c), F.col("n").alias(f"n{c}")) for c in "xy")
    mutual = parts.join(nx, "x").join(ny, "y").groupBy("word").agg(
        F.min(F.log(F.col("n") * F.lit(float(total)) / (F.col("nx").cast("double") * F.col("ny")))).alias("mutual"))
    found = (frequent.join(mutual, "word").join(entropy("before"), "word").join(entropy("after"), "word")
             .withColumn("entropy", F.least("h_before", "h_after")))
    return found.where((F.col("mutual") >= min_mutual) & (F.col("entropy") >= min_entropy)).select(
        "word", "n", "mutual", "entropy", F.log(F.col("n") / F.lit(float(total))).alias("log_p"))


def best_path(run: str, log_p: dict[str, float], alone: float, max_len: int) -> list[str]:
    """Most probable cut into known words and single code points (ties: longer last word)."""
    best, step = [0.0], [0]
    for end in range(1, len(run) + 1):
        score, size = max((best[end - k] + (log_p.get(run[end - k:end], alone) if k == 1 else log_p[run[end - k:end]]), k)
                          for k in range(1, min(max_len, end) + 1) if k == 1 or run[end - k:end] in log_p)
        best.append(score)
        step.append(size)
    out, end = [], len(run)
    while end:
        out.append(run[end - step[end]:end])
        end -= step[end]
    return out[::-1]


def segment_runs(runs: DataFrame, words: DataFrame, *, max_len: int = 4) -> DataFrame:
    """``(run, n, words)``: every run cut along its best path. The words (at most
    ``MAX_WORDS``) are broadcast."""
    total = runs.agg(F.sum(F.col("n") * F.length("run"))).first()[0] or 1
    shared = runs.sparkSession.sparkContext.broadcast({r["word"]: r["log_p"] for r in words.select("word", "log_p").collect()})
    alone = math.log(1.0 / total)

    def go(batches):
        for pdf in batches:
            yield pd.DataFrame({"run": pdf["run"], "n": pdf["n"],
                                "words": [best_path(r, shared.value, alone, max_len) for r in pdf["run"]]})
    return runs.select("run", "n").mapInPandas(go, "run string, n long, words array<string>")

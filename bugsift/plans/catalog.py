"""Query catalogue: one Spark query per operator, each paired (where SQL can
state it) with an independent DuckDB oracle over the same parquet tables.

Every query reads whole tables from ``sf_dir``. Floating results are rounded to
6 places on both sides; counts are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> "F.Column":
    return F.round(c, 6)


# importing the query modules fills QUERIES / ORACLE
from . import q_text, q_features, q_pairs, q_metrics, q_sources, q_prompts, q_split, q_ensemble, q_cluster, q_model  # noqa: E402,F401

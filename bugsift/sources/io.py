"""Report tables in and out: parquet / csv / json with an explicit blank policy."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Largest stop-word list inlined into expressions (stop lists are word lists).
MAX_STOPWORDS = 100_000


def read_reports(spark: SparkSession, path: str, *, fmt: str = "parquet", schema=None,
                 blank: str = "empty", text_cols: Iterable[str] | None = None,
                 options: dict | None = None, id_col: str | None = None) -> DataFrame:
    """Load a report table. ``blank``: ``'empty'`` turns null text into '' (rows
    kept), ``'drop'`` removes rows whose text is null or blank, ``'keep'`` leaves nulls.
    With ``id_col`` the ids are checked (no null, no duplicate: one aggregation)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    df = reader.load(path)
    if id_col is not None:
        check_ids(df, id_col)
    return apply_blank_policy(df, blank=blank, text_cols=text_cols)


def apply_blank_policy(df: DataFrame, *, blank: str = "empty", text_cols: Iterable[str] | None = None) -> DataFrame:
    cols = list(text_cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)])
    if blank == "empty":
        return df.na.fill("", subset=cols)
    if blank == "drop":
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
        return df.where(cond)
    if blank == "keep":
        return df
    raise ValueError(f"blank must be 'empty', 'drop' or 'keep', not {blank!r}")


def check_ids(df: DataFrame, id_col: str) -> None:
    """Raise if ``id_col`` has nulls or duplicates (one aggregation job)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("nn"),
                 F.countDistinct(id_col).alias("nd")).collect()[0]
    if row["nn"] != row["n"]:
        raise ValueError(f"{id_col} has null values")
    if row["nd"] != row["n"]:
        raise ValueError(f"{id_col} has duplicate values")


def slice_columns(df: DataFrame, start: int | None = None, stop: int | None = None,
                  positions: Iterable[int] | None = None) -> DataFrame:
    """Positional projection: ``df.columns[start:stop]`` or explicit positions."""
    cols = df.columns
    chosen = [cols[p] for p in positions] if positions is not None else cols[start:stop]
    return df.select(*chosen)


def read_stopwords(spark: SparkSession, paths: str | list[str], *, strip: bool = True,
                   extra: Iterable[str] = ()) -> DataFrame:
    """One-column ``word`` table from word-per-line files (+ ``extra`` words)."""
    lines = spark.read.text(paths)
    word = F.trim("value") if strip else F.col("value")
    words = lines.select(word.alias("word")).where(F.col("word") != "")
    if extra:
        words = words.unionByName(spark.createDataFrame([(w,) for w in extra], "word string"))
    return words.distinct()


def stopword_list(words: DataFrame, limit: int = MAX_STOPWORDS) -> list[str]:
    """Bring a word list to the driver for inlining; refuses lists above ``limit``
    (use ``remove_stopwords_join`` for those)."""
    got = [r["word"] for r in words.limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"stop-word list exceeds {limit} words; use a join instead")
    return got


def remove_stopwords_join(tokens: DataFrame, words: DataFrame, *, id_col: str,
                          tokens_col: str = "tokens") -> DataFrame:
    """Stop-word removal for unbounded lists: explode with position, anti-join
    the word table, rebuild in order (per-document regrouping)."""
    ex = tokens.select(id_col, F.posexplode(tokens_col).alias("pos", "word"))
    kept = ex.join(words.select("word"), "word", "left_anti")
    rebuilt = kept.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda e: e["word"]).alias(tokens_col))
    return (tokens.select(id_col).join(rebuilt, id_col, "left")
            .select(id_col, F.coalesce(tokens_col, F.array().cast("array<string>")).alias(tokens_col)))


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, options: dict | None = None) -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    w.save(path)

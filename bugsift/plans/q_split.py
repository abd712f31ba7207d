"""Split and accuracy queries (label = document language)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import accuracy
from ..operators.split import concat_splits, split_counts, stratified_split
from .catalog import query, r6, table

SPLIT_SQL = """sp0 AS (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang) AS n,
       row_number() OVER (PARTITION BY lang ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk
    FROM documents),
  sp AS (SELECT doc_id, lang, source, CASE WHEN rk < (n + 9) // 10 THEN 'test'
        WHEN rk < (n + 9) // 10 + (2 * (n - (n + 9) // 10) + 8) // 9 THEN 'validation' ELSE 'train' END AS split
    FROM sp0)"""


def _split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return stratified_split(d, id_col="doc_id", label_col="lang", seed="42")


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, lang, split FROM sp")
def q_stratified_split(spark, sf):
    return _split(spark, sf).select("doc_id", "lang", "split")


@query("split_counts", f"WITH {SPLIT_SQL} SELECT lang, split, count(*) AS n FROM sp GROUP BY ALL")
def q_split_counts(spark, sf):
    return split_counts(_split(spark, sf), "lang")


@query("concat_splits", f"""WITH {SPLIT_SQL}
SELECT 'train' AS part, doc_id, lang FROM sp WHERE split = 'train'
UNION ALL SELECT 'validation', doc_id, lang FROM sp WHERE split = 'validation'
UNION ALL SELECT 'test', doc_id, lang FROM sp WHERE split = 'test'""")
def q_concat_splits(spark, sf):
    parts = concat_splits(_split(spark, sf))
    out = None
    for name, df in parts.items():
        piece = df.select(F.lit(name).alias("part"), "doc_id", "lang")
        out = piece if out is None else out.unionByName(piece)
    return out


@query("accuracy", f"""WITH {SPLIT_SQL},
  votes AS (SELECT source, lang, count(*) AS c FROM sp WHERE split = 'train' GROUP BY ALL),
  maj AS (SELECT source, lang AS pred FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, lang) AS r
                                            FROM votes) WHERE r = 1)
SELECT split, count(*) AS n, round(avg(CASE WHEN pred = lang THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM sp LEFT JOIN maj USING (source) GROUP BY split""")
def q_accuracy(spark, sf):
    """Majority language of the training rows of the same source, scored per split."""
    sp = _split(spark, sf)
    votes = sp.where(F.col("split") == "train").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))
    maj = votes.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("c"), F.col("lang"))).alias("pred"))
    scored = sp.join(maj, "source", "left").withColumn("pred", F.coalesce("pred", F.lit("")))
    return accuracy(scored, "lang", "pred", by=["split"]).select("split", "n", r6("accuracy").alias("accuracy"))

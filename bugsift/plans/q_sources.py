"""Source / sink queries: blank policy, positional projection, batches, resume."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..session import ensure_checkpoint_dir
from ..sources import batches as B
from ..sources.io import read_stopwords, remove_stopwords_join, slice_columns, write_table
from .catalog import query, table
from .sqlgen import TOKENS


@query("read_reports", """SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
       coalesce(source, '') AS source, n_chars FROM documents""")
def q_read_reports(spark, sf):
    from ..sources.io import read_reports
    return read_reports(spark, f"{sf}/documents.parquet", blank="empty", id_col="doc_id")


@query("slice_columns", "SELECT text, lang, source FROM documents")
def q_slice_columns(spark, sf):
    return slice_columns(table(spark, sf, "documents"), 1, 4)


@query("batch_assign", """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos,
       ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch_id FROM documents""")
def q_batch_assign(spark, sf):
    return B.assign_batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 100).select(
        "doc_id", "pos", "batch_id")


@query("batch_snapshots", """WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_id FROM documents)
SELECT batch_id::BIGINT AS snapshot_id, n_rows::BIGINT AS n_rows FROM
  (SELECT batch_id, sum(count(*)) OVER (ORDER BY batch_id) AS n_rows FROM b GROUP BY batch_id)""")
def q_batch_snapshots(spark, sf):
    batched = B.assign_batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)
    return B.snapshot_sizes(batched)


@query("resume_pending", """SELECT doc_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_resume_pending(spark, sf):
    return B.resume_pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


def _scratch(spark, name: str) -> str:
    """A fresh folder in the shared storage of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_FREQUENT = f"""SELECT w FROM (SELECT w, count(DISTINCT doc_id) AS n FROM
    (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) GROUP BY w) WHERE n * 2 > (SELECT count(*) FROM documents)"""


@query("stopword_files", f"""WITH stop AS ({_FREQUENT} UNION SELECT 'est'),
  t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
  ex AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM t),
  k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept FROM ex WHERE w NOT IN (SELECT w FROM stop) GROUP BY doc_id)
SELECT t.doc_id, coalesce(kept, '') AS kept FROM t LEFT JOIN k USING (doc_id)""")
def q_stopword_files(spark, sf):
    """Words of more than half of the reports, written as a word-per-line file,
    read back (stripped, with one extra word) and removed by a join."""
    tokens = table(spark, sf, "documents").select("doc_id", word_tokens("text").alias("tokens"))
    n = tokens.count()
    frequent = (tokens.select("doc_id", F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w")
                .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 > n))
    path = _scratch(spark, "stopwords")
    write_table(frequent.select(F.concat(F.lit("  "), "w", F.lit(" ")).alias("value")), path, fmt="text")
    words = read_stopwords(spark, path, extra=["est"])
    out = remove_stopwords_join(tokens, words, id_col="doc_id")
    return out.select("doc_id", F.array_join("tokens", " ").alias("kept"))


@query("write_table", """SELECT f.fmt, doc_id, text, lang FROM documents,
  (SELECT unnest(['parquet', 'json', 'csv']) AS fmt) f""")
def q_write_table(spark, sf):
    """Reports written in three formats (partitioned by language) and read back."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = None
    for fmt in ("parquet", "json", "csv"):
        path = _scratch(spark, f"reports-{fmt}")
        options = {"escape": '"', "multiLine": "true", "header": "true"} if fmt == "csv" else {}
        write_table(d, path, fmt=fmt, partition_by=["lang"], options=options)
        reader = spark.read.schema("doc_id long, text string, lang string").options(**options)
        back = reader.format(fmt).load(path).select(F.lit(fmt).alias("fmt"), "doc_id", "text", "lang")
        out = back if out is None else out.unionByName(back)
    return out

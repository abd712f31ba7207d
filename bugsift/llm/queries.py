"""Registered queries of the operators, and SQL where it can state them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, html_extract, ngram_join, periodic_runs, quality_qda, quality_rules, secret_scan,
               sentencepiece_bpe, sharding, spelling_variants, substring_dedup, toxicity)
from .common import table


def piece_model() -> str:
    """Path of the 32k BPE model; BUGSIFT_PIECE_MODEL names another place."""
    own = os.environ.get("BUGSIFT_PIECE_MODEL")
    if own:
        return own
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), piece_model())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weights = html_extract.train(html_extract.labelled_pages(pages, table(spark, sf_dir, "documents")))
    return html_extract.extract(pages, weights)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def chat_events(conversations: DataFrame) -> DataFrame:
    """The conversations as an event log: a row is a message; assistant rows
    arrive as an empty message and two streamed deltas."""
    from pyspark.sql import Window
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(
        "conv_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
        F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", text)).alias("turn"))
    half = F.floor(F.length("text") / 2).cast("int")
    streamed = F.array(
        F.struct(F.lit("message").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit("delta").alias("kind"), F.substring("text", F.lit(1), half).alias("text")),
        F.struct(F.lit("delta").alias("kind"), F.expr("substring(text, floor(length(text) / 2) + 1)").alias("text")))
    whole = F.array(F.struct(F.lit("message").alias("kind"), F.col("text")))
    parts = F.when(F.col("role") == chat_format.LOSS_ROLE, streamed).otherwise(whole)
    return rows.select("conv_id", "turn", "role", F.posexplode(parts).alias("_k", "_e")).select(
        "conv_id", (F.col("turn").cast("long") * 3 + F.col("_k")).alias("seq"), F.col("_e.kind").alias("kind"),
        "turn", "role", F.col("_e.text").alias("text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = chat_format.fold_events(chat_events(c.unionByName(probe)))
    return chat_format.digests(chat_format.render(turns))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = periodic_runs.looped(F.coalesce("text", F.lit("")), seed)
    return periodic_runs.digests(periodic_runs.runs(docs.select("doc_id", text.alias("text"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), slip_every=97)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_html_extract": op8_html_extract,
    "op9_sharding": op9_sharding,
    "op10_chat_format": op10_chat_format,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_SYM = "regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')"

ORACLE = {
    "op6_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM
      (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS s FROM d),
m AS (SELECT d.doc_id, d.t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length({_SYM.replace("coalesce(text, '')", "t")})::BIGINT AS n_symbols,
  (len(l.s) - len(list_distinct(l.s)))::BIGINT AS n_dup_lines, len(l.s) AS n_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
       OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
       OR 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 50 * word_chars
       OR 100 * length(regexp_replace(t, '[^!]+', '', 'g')) > 30 * n_words
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m""",
    "op10_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(regexp_replace(role, '[^\\<#:]+', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^\\<#]+', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
}

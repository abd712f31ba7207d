"""Bag-of-n-grams features: term counts, vocabulary, TF / TF-IDF, L2, keywords.

Plan shape (one corpus, ``P`` partitions):

* the corpus ``(id, text)`` is hash-partitioned by id once (skip with
  ``partitioned=True`` when the table is already bucketed by id). After that
  every per-document step -- tokens, term counts, weights, norms, top-k -- is
  a narrow transformation or an aggregate that reuses the id partitioning,
  so it plans without another exchange;
* the vocabulary is the only term-keyed shuffle (partial + final hash
  aggregate, so a hot term costs one row per map task, not one per document);
* the vocabulary goes back to the documents by a broadcast hash join when its
  size is bounded by ``max_features``; otherwise its frequent terms, as many as
  a measured size allows, are broadcast, and only rows of rare terms are
  shuffled by term and back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, ngrams, remove_stopwords, segment, word_tokens
from ..session import default_parallelism
from .ranking import ordered_index

# Largest vocabulary shipped to every task by an explicit broadcast hint.
BROADCAST_TERMS = 2_000_000
# Largest measured vocabulary (estimated bytes) broadcast without a known bound.
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class VectorizerConfig:
    """Vectoriser settings; semantics of the classic TF-IDF vectoriser."""
    ngram_range: tuple[int, int] = (1, 1)
    min_df: int | float = 1          # int: document count, float: fraction
    max_df: int | float = 1.0        # float: fraction, int: document count
    max_features: int | None = None  # top terms by total count
    sublinear_tf: bool = False       # 1 + ln(tf)
    use_idf: bool = True
    smooth_idf: bool = True          # ln((1+N)/(1+df)) + 1
    norm: str | None = "l2"
    binary: bool = False
    lowercase: bool = True


@dataclass
class Features:
    """Everything a fit produces; all members are lazy DataFrames."""
    n_docs: int
    tokens: DataFrame     # id, terms array<string>
    counts: DataFrame     # id, term, tf        (term null for token-less docs)
    vocab: DataFrame      # term, df, ctf, idf, term_idx
    rows: DataFrame       # id, vec array<struct<term_idx,term,w>>, sorted by term_idx
    id_col: str
    norm: str | None = "l2"

    def release(self) -> None:
        """Drop the cached term counts once every result has been consumed."""
        self.counts.unpersist()

    @property
    def weights(self) -> DataFrame:
        """Long form ``(id, term_idx, term, w)``; token-less documents absent."""
        return self.rows.select(self.id_col, F.inline("vec"))


def prepare_corpus(df: DataFrame, id_col: str, text_col: str,
                   num_partitions: int | None = None, partitioned: bool = False) -> DataFrame:
    """Project ``(id, text)`` and hash-partition it by id (one shuffle)."""
    corpus = df.select(id_col, text_col)
    if partitioned:
        return corpus
    parts = num_partitions or default_parallelism(df.sparkSession)
    return corpus.repartition(parts, id_col)


def tokenize(corpus: DataFrame, id_col: str, text_col: str, *, ngram_range=(1, 1),
             stopwords=None, method: str | None = None, lowercase: bool = True) -> DataFrame:
    """``(id, terms)``: words (or segments), minus stop words, as n-grams."""
    if method is None:
        toks = word_tokens(text_col, lowercase=lowercase)
    else:
        toks = segment(F.lower(F.col(text_col)) if lowercase else F.col(text_col), method)
    if stopwords:
        toks = remove_stopwords(toks, stopwords)
    terms = ngrams(toks, *ngram_range)
    return corpus.select(id_col, F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))


def term_counts(tokens: DataFrame, id_col: str, terms_col: str = "terms",
                binary: bool = False) -> DataFrame:
    """``(id, term, tf)``; a document with no term keeps one ``(id, null, 0)`` row.

    Grouping on (id, term) reuses the id partitioning of the corpus.
    """
    exploded = tokens.select(id_col, F.explode_outer(terms_col).alias("term"))
    tf = F.count("term")
    if binary:
        tf = F.least(tf, F.lit(1))
    return exploded.groupBy(id_col, "term").agg(tf.cast("long").alias("tf"))


def _doc_bounds(n_docs: int, min_df, max_df) -> tuple[int, float]:
    lo = min_df if isinstance(min_df, int) else min_df * n_docs
    hi = max_df * n_docs if isinstance(max_df, float) else max_df
    if hi < lo:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    return lo, hi


def vocabulary(counts: DataFrame, n_docs: int, cfg: VectorizerConfig) -> DataFrame:
    """``(term, df, ctf, idf, term_idx)``: df/ctf filter, top ``max_features``
    by total count (ties: term), then indices in term order."""
    lo, hi = _doc_bounds(n_docs, cfg.min_df, cfg.max_df)
    stats = (counts.where(F.col("term").isNotNull())
             .groupBy("term")
             .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
             .where((F.col("df") >= F.lit(float(lo))) & (F.col("df") <= F.lit(float(hi)))))
    if cfg.max_features is not None:
        stats = stats.orderBy(F.desc("ctf"), F.asc("term")).limit(cfg.max_features)
    if cfg.use_idf:
        s = 1 if cfg.smooth_idf else 0
        idf = F.log((F.lit(n_docs + s)) / (F.col("df") + s)) + F.lit(1.0)
    else:
        idf = F.lit(1.0)
    stats = stats.withColumn("idf", idf.cast("double"))
    return ordered_index(stats, ["term"], "term_idx").withColumn("term_idx", F.col("term_idx").cast("int"))


def broadcast_df(vocab: DataFrame, cfg: VectorizerConfig) -> float:
    """Document frequency from which terms are broadcast: every term under a bound known
    before running (``max_features``); else as many of the frequent ones, by powers of
    two of their df, as stay under ``BROADCAST_TERMS`` and ``BROADCAST_BYTES`` (one
    small aggregation over the materialised vocabulary). 0 if that is all of them."""
    if cfg.max_features is not None and cfg.max_features <= BROADCAST_TERMS:
        return 0
    sizes = (vocab.groupBy(F.floor(F.log2("df")).cast("int").alias("p"))      # a row per power of two
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("chars")).collect())
    terms = bytes_ = 0
    least = float("inf")
    for row in sorted(sizes, key=lambda r: -r["p"]):
        terms += row["n"]
        bytes_ += (row["chars"] or 0) * 2 + row["n"] * 48
        if terms > BROADCAST_TERMS or bytes_ > BROADCAST_BYTES:
            return least
        least = float(2 ** row["p"])
    return 0


def _tf_weight(cfg: VectorizerConfig):
    tf = F.col("tf").cast("double")
    if cfg.sublinear_tf and not cfg.binary:
        tf = F.lit(1.0) + F.log(tf)
    return tf


def sparse_rows(counts: DataFrame, vocab: DataFrame, cfg: VectorizerConfig, id_col: str) -> DataFrame:
    """One row per document: ``vec`` sorted by term_idx, L2-normalised if asked.

    Documents with no vocabulary term get an empty ``vec`` (zero rows)."""
    entry = F.when(F.col("term_idx").isNotNull(),
                   F.struct(F.col("term_idx"), F.col("term"),
                            (_tf_weight(cfg) * F.col("idf")).alias("w")))
    least = broadcast_df(vocab, cfg)
    v = vocab.select("term", "term_idx", "idf", "df")
    # frequent terms, which most of the (doc, term) rows hold, come to the documents: no
    # shuffle of these rows. A document without a term keeps an empty row
    head = F.broadcast(v.where(F.col("df") >= least).drop("df"))
    rows = counts.join(head, "term", "left").groupBy(id_col).agg(F.collect_list(entry).alias("vec"))
    if least:
        # rare terms go round by term, and only those in the vocabulary come back
        tail = (counts.where(F.col("term").isNotNull()).join(head.select("term"), "term", "left_anti")
                .join(v.where(F.col("df") < least).drop("df"), "term")
                .groupBy(id_col).agg(F.collect_list(entry).alias("rare")))
        known = rows.where(F.col(id_col).isNotNull()).join(tail, id_col, "left")
        # ids are unique: one row at most has none
        other = rows.where(F.col(id_col).isNull()).join(
            F.broadcast(tail.where(F.col(id_col).isNull()).select("rare")), F.lit(True), "left")
        rows = known.unionByName(other).select(id_col, F.concat("vec", F.coalesce(
            "rare", F.slice("vec", 1, 0))).alias("vec"))
    rows = rows.select(id_col, F.array_sort("vec").alias("vec"))
    if cfg.norm == "l2":
        rows = rows.withColumn("vec", let(F.col("vec"), _l2))
    elif cfg.norm is not None:
        raise ValueError(f"unsupported norm {cfg.norm!r}")
    return rows


def _l2(vec):
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
    return let(norm, lambda n: F.when(n > 0, F.transform(
        vec, lambda e: F.struct(e["term_idx"].alias("term_idx"), e["term"].alias("term"),
                                (e["w"] / n).alias("w")))).otherwise(vec))


def fit_transform(df: DataFrame, cfg: VectorizerConfig, *, id_col: str = "doc_id",
                  text_col: str = "text", stopwords=None, method: str | None = None,
                  num_partitions: int | None = None, partitioned: bool = False) -> Features:
    corpus = prepare_corpus(df, id_col, text_col, num_partitions, partitioned)
    tokens = tokenize(corpus, id_col, text_col, ngram_range=cfg.ngram_range,
                      stopwords=stopwords, method=method, lowercase=cfg.lowercase)
    # term counts feed both the vocabulary and the weight rows: keep them so the
    # text is scanned and tokenized once (lost blocks are recomputed from lineage;
    # release with ``spark.catalog.clearCache()`` / ``Features.release()``)
    counts = term_counts(tokens, id_col, binary=cfg.binary).persist(StorageLevel.MEMORY_AND_DISK)
    n_docs = counts.select(id_col).distinct().count()
    n_rows = df.count()
    if n_rows != n_docs:
        counts.unpersist()
        raise ValueError(f"{id_col} must be unique: {n_rows} rows, {n_docs} ids")
    vocab = vocabulary(counts, n_docs, cfg)
    rows = sparse_rows(counts, vocab, cfg, id_col)
    return Features(n_docs, tokens, counts, vocab, rows, id_col, cfg.norm)


def top_keywords(rows: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """``(id, rank, term, w)``: top-k non-zero terms per row by weight desc, then
    vocabulary order. Row-local array sort: no shuffle, no window."""
    ranked = F.transform(
        F.filter("vec", lambda e: e["w"] != 0),
        lambda e: F.struct((-e["w"]).alias("nw"), e["term_idx"].alias("term_idx"),
                           e["term"].alias("term"), e["w"].alias("w")))
    top = F.slice(F.array_sort(ranked), 1, k)
    return (rows.select(id_col, F.posexplode(top).alias("pos", "e"))
            .select(id_col, (F.col("pos") + 1).alias("rank"), F.col("e.term").alias("term"),
                    F.col("e.w").alias("w")))


def top_keywords_joined(rows: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """``(id, keywords)``: the top-k terms joined by spaces (empty row: '')."""
    ranked = F.transform(
        F.filter("vec", lambda e: e["w"] != 0),
        lambda e: F.struct((-e["w"]).alias("nw"), e["term_idx"].alias("term_idx"),
                           e["term"].alias("term")))
    top = F.slice(F.array_sort(ranked), 1, k)
    return rows.select(id_col, F.array_join(F.transform(top, lambda e: e["term"]), " ").alias("keywords"))


def l2_norms(counts: DataFrame, vocab: DataFrame, cfg: VectorizerConfig, id_col: str) -> DataFrame:
    """``(id, n_terms, norm)`` of the un-normalised weight rows."""
    raw = sparse_rows(counts, vocab, VectorizerConfig(**{**cfg.__dict__, "norm": None}), id_col)
    return raw.select(id_col, F.size("vec").alias("n_terms"),
                      F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, e: a + e["w"] * e["w"])).alias("norm"))

r"""Quality rules as a short-circuit cascade (native: SQL functions only).

Base measures of the whole text (words are ``[^\x20\x09-\x0D]+``): n_words,
word_chars, n_symbols, n_dup_lines and n_repeat_words. A text fails the base
rules with fewer than 50 words or more than half of its words in repeated
three-word windows. The further rules (``RULES``) are ordered by rejected rows
per second, both estimated on a sample of at most ``SAMPLE_ROWS`` rows, and
tried one after the other inside a CASE that stops at the first rejection. The
order changes the work, never the verdict.

Nulls are empty texts (no words, rejected); ties in the order keep the rules'
own order; repeated rows get the same verdict; an empty table gives no rows.
Equal three-word windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import prepare

SAMPLE_ROWS = 2000      # bound of the sample that costs and selectivities come from
SYMBOLS = "#*$%&|<>"
FEW = 64                # repeated windows up to which they are looked up one by one
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
# Fixed thresholds of the further rules, in per cent
MAX_SYMBOL_PCT = 10     # symbols per word
MAX_DUP_LINE_PCT = 30   # lines equal to an earlier line
MAX_UPPER_PCT = 50      # A-Z among the characters of words
MAX_SHOUT_PCT = 30      # exclamation marks per word
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long"))


def repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in ``w``."""
    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def many(h: Column) -> Column:
        def repeated(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                                              | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
            return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)
        rows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return let(F.sort_array(rows), repeated)

    def few(h: Column, twice: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i)))
        return let(at, covered)

    def by_hash(h: Column) -> Column:
        # the same positions either way: looked up among few repeated hashes, or by sorting all
        def pick(s: Column) -> Column:
            twice = F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False))))
            return let(twice, lambda d: F.when(F.size(d) <= FEW, few(h, d)).otherwise(many(h)))
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .otherwise(let(F.sort_array(h), pick)))

    at = F.sequence(F.lit(0), F.size(w) - 3)
    windows = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(windows, by_hash))


def _upper(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", ""))


def _shouts(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


# name -> whether the text is rejected; m gives the measures, evaluated where used
RULES = {
    "symbols": lambda t, m: 100 * m["n_symbols"]() > MAX_SYMBOL_PCT * m["n_words"](),
    "dup_lines": lambda t, m: 100 * m["n_dup_lines"]() > MAX_DUP_LINE_PCT * n_lines(t),
    "upper_case": lambda t, m: 100 * _upper(t) > MAX_UPPER_PCT * m["word_chars"](),
    "shouting": lambda t, m: 100 * _shouts(t) > MAX_SHOUT_PCT * m["n_words"](),
    "word_length": lambda t, m: ((m["word_chars"]() < MIN_WORD_CHARS * m["n_words"]())
                                 | (m["word_chars"]() > MAX_WORD_CHARS * m["n_words"]())),
}


def _rules(text: Column, w: Column | None = None, **known: Column) -> dict[str, Column]:
    """The rules over a text, from its words ``w`` or from measures already known."""
    measures = {"n_symbols": lambda: n_symbols(text), "n_dup_lines": lambda: dup_lines(text)}
    if w is not None:
        measures |= {"n_words": lambda: F.size(w).cast("long"), "word_chars": lambda: word_chars(w)}
    measures |= {k: (lambda c=c: c) for k, c in known.items()}
    return {k: f(text, measures) for k, f in RULES.items()}


def rule_order(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Names of the further rules by rejected rows per second on the sample."""
    total = docs.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    taken = docs.select(text.alias("_t"))
    if total > SAMPLE_ROWS:
        taken = taken.sample(fraction=0.9 * SAMPLE_ROWS / total, seed=11).limit(SAMPLE_ROWS)
    taken = taken.withColumn("_w", words(F.col("_t"))).cache()
    try:
        rules = _rules(F.col("_t"), F.col("_w"))
        rows = max(taken.count(), 1)
        rate = {}
        for k, rejects in rules.items():
            began = time.perf_counter()
            hits = taken.agg(F.count_if(rejects)).first()[0]
            rate[k] = (hits + 1) / rows / (time.perf_counter() - began)
    finally:
        taken.unpersist()
    return sorted(rules, key=lambda k: -rate[k])


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """False at the first rule that rejects; later ones are not evaluated."""
    first, *rest = order
    out = F.when(rules[first], F.lit(False))
    for k in rest:
        out = out.when(rules[k], F.lit(False))
    return out.otherwise(F.lit(True))


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           order: list[str] | None = None) -> DataFrame:
    """(id, base measures, base_failed, kept) of every whole text."""
    prepare(docs.sparkSession)
    order = order or rule_order(docs, text_col)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measures = let(words(F.col("_t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), word_chars(w).alias("chars"), repeat_words(w).alias("rep")))
    base = docs.select(F.col(id_col).alias("_id"), t.alias("_t")).select(
        "_id", "_t", measures.alias("_w"), n_symbols(F.col("_t")).alias("n_symbols"),
        dup_lines(F.col("_t")).alias("n_dup_lines"))
    failed = (F.col("_w.n") < MIN_WORDS) | (100 * F.col("_w.rep") > MAX_REPEAT_PCT * F.col("_w.n"))
    rules = _rules(F.col("_t"), n_words=F.col("_w.n"), word_chars=F.col("_w.chars"),
                   n_symbols=F.col("n_symbols"), n_dup_lines=F.col("n_dup_lines"))
    return base.select(
        F.col("_id").alias(id_col), F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("_w.rep").alias("n_repeat_words"), failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(cascade(rules, order)).alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows whose text passes, all columns unchanged. Cheap tests come
    first: word count, then the ordered rules, then the repeated windows."""
    prepare(docs.sparkSession)
    order = order or rule_order(docs, text_col)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def verdict(w: Column) -> Column:
        n = F.size(w).cast("long")
        return (F.when(n < MIN_WORDS, F.lit(False))
                .when(~cascade(_rules(t, w), order), F.lit(False))
                .otherwise(100 * repeat_words(w) <= MAX_REPEAT_PCT * n))

    return docs.where(let(words(t), verdict))

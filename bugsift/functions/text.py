"""Column functions for report text: tokens, segmentation, stop words, n-grams.

All are built-in Spark SQL expressions (regex, higher-order array functions),
so they run inside the JVM next to the scan; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of two or more Unicode letters, digits or '_'
# (the classic vectoriser token rule, written with explicit Unicode classes:
# Java's plain \w is ASCII-only).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Fixed value: Han characters, split into overlapping character bigrams.
HAN_PATTERN = r"\p{IsHan}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Without this the optimizer may inline an expensive expression (e.g. the
    tokenizer) into every lambda call that references it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_tokens(text: str | Column, lowercase: bool = True) -> Column:
    """Words of >= 2 characters, lower-cased; null text gives null."""
    t = _col(text)
    if lowercase:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(WORD_PATTERN), 0)


def segment(text: str | Column, method: str = "words") -> Column:
    """Word segmentation.

    ``words``: spaced scripts, case kept. ``cjk_bigrams``: a dictionary-free
    stand-in for a Chinese segmenter; text is cut into runs of Han characters
    and words of other scripts, Han runs become their overlapping character
    bigrams (a single character stays), other words are kept as in ``words``.
    """
    if method == "words":
        return word_tokens(text, lowercase=False)
    if method != "cjk_bigrams":
        raise ValueError(f"unknown segmentation method {method!r}")
    runs = F.regexp_extract_all(_col(text), F.lit(f"{HAN_PATTERN}+|[\\p{{L}}\\p{{N}}_&&[^{HAN_PATTERN}]]{{2,}}"), 0)

    def split(w):
        n = F.length(w)
        bigrams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(w, i, 2))
        return F.when(w.rlike(HAN_PATTERN) & (n > 2), bigrams).otherwise(F.array(w))
    return F.flatten(F.transform(runs, split))


def custom_segmenter(fn):
    """Wrap a user segmenter ``fn(text) -> list[str]`` (e.g. a dictionary
    segmenter) as an Arrow-batched Column function: ``seg(col) -> array<string>``.
    Per-row Python is the user's own code; the batch transfer is vectorised."""
    @F.pandas_udf("array<string>")
    def _seg(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(fn(t)))
    return _seg


def remove_stopwords(tokens: str | Column, stopwords: Iterable[str]) -> Column:
    """Drop exact (case-sensitive) stop words; order and duplicates kept.

    ``array_except`` would de-duplicate, so this is a ``filter``. The list is
    inlined as an IN-set (hash lookup), so it must be a bounded word list.
    """
    stop = sorted(set(stopwords))
    if not stop:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(stop))


def join_tokens(tokens: str | Column, sep: str = " ") -> Column:
    return F.array_join(_col(tokens), sep)


def ngrams(tokens: str | Column, lo: int = 1, hi: int = 1) -> Column:
    """All space-joined n-grams for n in [lo, hi]; short arrays yield none."""
    if lo < 1 or hi < lo:
        raise ValueError("need 1 <= lo <= hi")
    toks = _col(tokens)
    if lo == hi == 1:
        return toks
    return let(toks, lambda t: F.flatten(F.array(*[t if k == 1 else _kgrams(t, k)
                                                   for k in range(lo, hi + 1)])))


def _kgrams(toks: Column, k: int) -> Column:
    # element access is O(1); no per-gram slice arrays are built
    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - k + 1),
                        lambda i: F.concat_ws(" ", *[F.element_at(toks, i + j) for j in range(k)]))
    return F.when(F.size(toks) >= k, grams).otherwise(F.array().cast("array<string>"))

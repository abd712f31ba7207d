"""Report preprocessing: segment, drop stop words, join (one column chain)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_tokens, remove_stopwords, segment


def preprocess_reports(df: DataFrame, *, id_col: str, text_col: str, label_col: str | None = None,
                       stopwords=(), method: str = "words") -> DataFrame:
    """``(id, [label,] tokens, normalized)``. Segmentation keeps case, as the
    segmenter of the reference does; the vectoriser lower-cases later."""
    toks = remove_stopwords(segment(F.col(text_col), method), stopwords)
    cols = [F.col(id_col)] + ([F.col(label_col).alias("label")] if label_col else [])
    return df.select(*cols, toks.alias("tokens")).withColumn("normalized", join_tokens("tokens"))

import math

import pytest
from pyspark.sql import functions as F

from bugsift.operators import features as feat


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_idf_term_everywhere_keeps_weight(spark):
    d = docs(spark, ["aa bb", "aa cc", "aa"])
    f = feat.fit_transform(d, feat.VectorizerConfig())
    w = {(r.doc_id, r.term): r.w for r in f.weights.collect()}
    assert w[(2, "aa")] == pytest.approx(1.0)  # idf(aa) = ln(4/4) + 1 = 1, then L2
    raw = 1.0 * (math.log(4 / 2) + 1)
    assert w[(0, "bb")] == pytest.approx(raw / math.sqrt(1 + raw * raw))


def test_zero_rows_and_vocabulary_rules(spark):
    d = docs(spark, ["aa aa bb", "bb cc", "zz", "aa bb cc"])
    cfg = feat.VectorizerConfig(min_df=2, max_df=1.0, max_features=2, use_idf=False)
    f = feat.fit_transform(d, cfg)
    vocab = {r.term: (r.df, r.ctf, r.term_idx) for r in f.vocab.collect()}
    # df: aa 2, bb 3, cc 2; ctf: aa 3, bb 3, cc 2 -> top 2 by ctf then term: aa, bb
    assert vocab == {"aa": (2, 3, 0), "bb": (3, 3, 1)}
    rows = {r.doc_id: r.vec for r in f.rows.collect()}
    assert rows[2] == []  # zero row kept
    n = math.sqrt(4 + 1)
    assert [(e.term, round(e.w, 9)) for e in rows[0]] == [("aa", round(2 / n, 9)), ("bb", round(1 / n, 9))]


def test_max_df_below_min_df_raises(spark):
    d = docs(spark, ["aa", "bb"])
    with pytest.raises(ValueError):
        feat.fit_transform(d, feat.VectorizerConfig(min_df=2, max_df=1))


def test_top_keywords_ties_by_term(spark):
    d = docs(spark, ["bb aa cc cc", "aa"])
    f = feat.fit_transform(d, feat.VectorizerConfig(use_idf=False))
    top = feat.top_keywords(f.rows, "doc_id", 2).where(F.col("doc_id") == 0).orderBy("rank").collect()
    assert [r.term for r in top] == ["cc", "aa"]
    joined = {r.doc_id: r.keywords for r in feat.top_keywords_joined(f.rows, "doc_id", 3).collect()}
    assert joined == {0: "cc aa bb", 1: "aa"}

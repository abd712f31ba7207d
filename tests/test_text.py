from pyspark.sql import functions as F

from bugsift.functions import text as tx


def rows(spark, data, schema="id int, t string"):
    return spark.createDataFrame(data, schema)


def test_word_tokens_unicode_and_nulls(spark):
    df = rows(spark, [(1, "Été à la MER x_1"), (2, "登录 界面"), (3, ""), (4, None)])
    got = {r.id: r.k for r in df.select("id", tx.word_tokens("t").alias("k")).collect()}
    assert got[1] == ["été", "la", "mer", "x_1"]
    assert got[2] == ["登录", "界面"]
    assert got[3] == []
    assert got[4] is None


def test_remove_stopwords_keeps_order_duplicates_case(spark):
    df = spark.createDataFrame([(["a", "b", "a", "C"],)], "k array<string>")
    got = df.select(tx.remove_stopwords("k", ["b", "c"]).alias("x")).first().x
    assert got == ["a", "a", "C"]


def test_ngrams_lengths(spark):
    data = [([],), (["a"],), (["a", "b"],), (["a", "b", "c", "d", "e"],)]
    df = spark.createDataFrame(data, "k array<string>")
    got12 = [r.x for r in df.select(tx.ngrams("k", 1, 2).alias("x")).collect()]
    assert got12 == [[], ["a"], ["a", "b", "a b"], ["a", "b", "c", "d", "e", "a b", "b c", "c d", "d e"]]
    got14 = [len(r.x) for r in df.select(tx.ngrams("k", 1, 4).alias("x")).collect()]
    assert got14 == [0, 1, 3, 5 + 4 + 3 + 2]
    only3 = df.select(tx.ngrams("k", 3, 3).alias("x")).collect()[3].x
    assert only3 == ["a b c", "b c d", "c d e"]


def test_cjk_bigrams(spark):
    df = rows(spark, [(1, "登录界面 ok Test")])
    got = df.select(tx.segment("t", "cjk_bigrams").alias("s")).first().s
    assert got == ["登录", "录界", "界面", "ok", "Test"]


def test_mixed_scripts(spark):
    df = rows(spark, [(1, "点击login按钮 用 x 录a界bb")])
    got = df.select(tx.segment("t", "cjk_bigrams").alias("s")).first().s
    assert got == ["点击", "login", "按钮", "用", "录", "界", "bb"]


def test_let_binds_once(spark):
    df = rows(spark, [(1, "a b c")])
    out = df.select(tx.let(F.split("t", " "), lambda a: F.size(a) + F.size(a)).alias("n")).first().n
    assert out == 6

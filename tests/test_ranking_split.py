from collections import Counter

from pyspark.sql import functions as F

from bugsift.operators.ranking import dense_index, ordered_index
from bugsift.operators.split import split_counts, stratified_split


def test_ordered_index_any_partitioning(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(13)
    for parts in (1, 3, 17):
        got = ordered_index(df, ["k"], "idx", num_partitions=parts).select("k", "idx").collect()
        assert sorted((r.k, r.idx) for r in got) == [(k, k) for k in range(1000)]


def test_dense_index_per_group(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", -1), ("b", 2), ("b", 9)], "g string, v int")
    got = {(r.g, r.v): r.idx for r in dense_index(df, ["v"], "idx", group_cols=["g"]).collect()}
    assert got == {("a", -1): 0, ("a", 5): 1, ("b", 2): 0, ("b", 9): 1}


def test_stratified_split_sizes(spark):
    sizes = {"a": 1, "b": 2, "c": 9, "d": 10, "e": 11, "f": 100}
    data = []
    k = 0
    for lab, n in sizes.items():
        for _ in range(n):
            data.append((k, lab))
            k += 1
    df = spark.createDataFrame(data, "id long, lab string")
    sp = stratified_split(df, id_col="id", label_col="lab", seed="1")
    ids = [r.id for r in sp.collect()]
    assert sorted(ids) == list(range(k))
    counts = {(r.lab, r.split): r.n for r in split_counts(sp, "lab").collect()}
    for lab, n in sizes.items():
        test = (n + 9) // 10
        val = (2 * (n - test) + 8) // 9
        assert counts.get((lab, "test"), 0) == test
        assert counts.get((lab, "validation"), 0) == val
        assert counts.get((lab, "train"), 0) == n - test - val
    # deterministic and partition independent
    again = stratified_split(df.repartition(7), id_col="id", label_col="lab", seed="1")
    assert Counter((r.id, r.split) for r in again.collect()) == Counter((r.id, r.split) for r in sp.collect())

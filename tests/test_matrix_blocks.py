"""Block rows of the similarity matrix: values, files per column block, repeated pairs."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from bugsift.operators import pairs as P
from bugsift.operators.pairs import similarity_blocks


def _matrix(spark, n=60):
    rows = [(i * 3, j * 3, ((i * 7 + j) % 10 + 1) / 16.0) for i in range(n) for j in range(i + 1, n) if (i + j) % 4 == 0]
    ids = spark.createDataFrame([(i * 3,) for i in range(n)], "id long")
    return rows, ids, spark.createDataFrame(rows, "i long, j long, sim double")


def _brute(rows, n, block):
    full = [[0.0] * n for _ in range(n)]
    for k in range(n):
        full[k][k] = 1.0
    for i, j, x in rows:
        full[i // 3][j // 3] = full[j // 3][i // 3] = x
    return {(r, c // block): full[r][c:c + block] for r in range(n) for c in range(0, n, block) if any(full[r][c:c + block])}


@pytest.mark.parametrize("ids_cap,part_rows", [(P.BROADCAST_IDS, P.CHUNK_ROWS), (1, 7)])
def test_blocks_equal_the_matrix(spark, monkeypatch, ids_cap, part_rows):
    monkeypatch.setattr(P, "BROADCAST_IDS", ids_cap)
    monkeypatch.setattr(P, "CHUNK_ROWS", part_rows)
    rows, ids, pairs = _matrix(spark)
    got = {(r["row"], r["block"]): r["vals"] for r in similarity_blocks(pairs, ids, 8).collect()}
    assert got == _brute(rows, 60, 8)


def test_a_column_block_is_one_file(spark, tmp_path):
    """Written by column block, every task once opened a file in every block."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows, ids, pairs = _matrix(spark)
        folder = str(tmp_path / "m")
        similarity_blocks(pairs, ids, 4).write.partitionBy("block").parquet(folder)
        files = collections.Counter(d for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))
        assert len(files) == 15 and set(files.values()) == {1}
        back = spark.read.parquet(folder).select("row", F.col("block").cast("long").alias("block"), "vals").collect()
        assert {(r["row"], r["block"]): r["vals"] for r in back} == _brute(rows, 60, 4)
    finally:
        spark.conf.set(key, old)


def test_no_sort_of_filled_chunks(spark, tmp_path):
    """The order by block is made on the entries: the write sorts no filled rows."""
    rows, ids, pairs = _matrix(spark)
    plan = similarity_blocks(pairs, ids, 4)._jdf.queryExecution().optimizedPlan()
    assert "block" in plan.outputOrdering().mkString(",")


def test_repeated_pairs_are_refused(spark):
    rows, ids, pairs = _matrix(spark, 6)
    with pytest.raises(Exception, match="comes twice"):
        similarity_blocks(pairs.unionByName(pairs), ids, 4).collect()


def test_null_values_are_zeros(spark):
    ids = spark.createDataFrame([(1,), (2,), (5,)], "id long")
    pairs = spark.createDataFrame([(1, 2, None), (2, 5, 0.5)], "i long, j long, sim double")
    got = {(r["row_id"], r["block"]): r["vals"] for r in similarity_blocks(pairs, ids, 2).collect()}
    assert got == {(1, 0): [1.0, 0.0], (2, 0): [0.0, 1.0], (2, 1): [0.5], (5, 0): [0.0, 0.5], (5, 1): [1.0]}

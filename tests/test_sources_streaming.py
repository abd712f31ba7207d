import os
import tempfile

import pytest
from pyspark.sql import functions as F

from bugsift.sources import batches as B
from bugsift.sources.export import export_clusters, write_clusters
from bugsift.sources.io import (apply_blank_policy, check_ids, read_reports, read_stopwords,
                                remove_stopwords_join, slice_columns, write_table)


def test_read_reports_checks_ids(spark):
    path = tempfile.mkdtemp(prefix="bugsift-ids-", dir="/tmp")
    spark.createDataFrame([(1, "a"), (None, "b")], "id long, text string").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        read_reports(spark, path, id_col="id")
    assert read_reports(spark, path).count() == 2


def test_blank_policy_and_slice(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, " ", "y"), (3, "ok", None)], "id long, a string, b string")
    assert [r.a for r in apply_blank_policy(df, blank="empty").orderBy("id").collect()] == ["", " ", "ok"]
    assert [r.id for r in apply_blank_policy(df, blank="drop", text_cols=["a"]).collect()] == [3]
    assert slice_columns(df, 1, 3).columns == ["a", "b"]
    assert slice_columns(df, positions=[0, 2]).columns == ["id", "b"]
    with pytest.raises(ValueError):
        check_ids(spark.createDataFrame([(1,), (1,)], "id long"), "id")


def test_round_trip_formats(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "id long, text string")
    for fmt in ("parquet", "json", "csv"):
        path = tempfile.mkdtemp(prefix=f"bugsift-{fmt}-", dir="/tmp")
        write_table(df, path, fmt=fmt, options={"header": "true"} if fmt == "csv" else None)
        back = read_reports(spark, path, fmt=fmt, schema="id long, text string",
                            options={"header": "true"} if fmt == "csv" else None)
        assert sorted(back.collect()) == sorted(df.collect())


def test_batches_snapshots_resume(spark):
    df = spark.range(0, 250).withColumnRenamed("id", "doc_id")
    b = B.assign_batches(df, "doc_id", 100)
    assert {r.batch_id: r.c for r in b.groupBy("batch_id").agg(F.count("*").alias("c")).collect()} == \
        {0: 100, 1: 100, 2: 50}
    sizes = {r.snapshot_id: r.n_rows for r in B.snapshot_sizes(b).collect()}
    assert sizes == {0: 100, 1: 200, 2: 250}
    path = tempfile.mkdtemp(prefix="bugsift-snap-", dir="/tmp")
    B.write_batch_snapshots(b.where(F.col("batch_id") < 2), os.path.join(path, "out"))
    done = B.read_snapshot(spark, os.path.join(path, "out"), 1)
    assert done.count() == 200
    assert sorted(r.doc_id for r in B.resume_pending(df, done, "doc_id").collect()) == list(range(200, 250))


def test_stopword_files_and_join_removal(spark):
    d = tempfile.mkdtemp(prefix="bugsift-stop-", dir="/tmp")
    with open(os.path.join(d, "s.txt"), "w") as fh:
        fh.write(" the \nand\n\nthe\n")
    words = read_stopwords(spark, os.path.join(d, "s.txt"), extra=["x"])
    assert sorted(r.word for r in words.collect()) == ["and", "the", "x"]
    toks = spark.createDataFrame([(1, ["the", "cat", "and", "the", "hat"]), (2, [])], "id long, tokens array<string>")
    got = {r.id: r.tokens for r in remove_stopwords_join(toks, words, id_col="id").collect()}
    assert got == {1: ["cat", "hat"], 2: []}


def test_export_clusters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    lab = spark.createDataFrame([(1, 0), (2, -1), (3, 0)], "id long, label int")
    ex = export_clusters(docs, lab, id_col="id", text_col="text")
    assert {(r.name, r.id) for r in ex.collect()} == {("Cluster 1", 1), ("Noise:", 2), ("Cluster 1", 3)}
    path = os.path.join(tempfile.mkdtemp(prefix="bugsift-exp-", dir="/tmp"), "clusters")
    write_clusters(ex, path)
    assert spark.read.json(path).count() == 3


def test_streaming_extraction_idempotent(spark):
    from bugsift.operators.complete import echo_completer_factory
    from bugsift.streaming.extraction import start_extraction_stream
    root = tempfile.mkdtemp(prefix="bugsift-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two")], schema).write.parquet(os.path.join(src, "f1"))
    spark.createDataFrame([(3, "red green blue")], schema).write.parquet(os.path.join(src, "f2"))
    q = start_extraction_stream(spark, source=os.path.join(src, "*"), schema=schema, sink=os.path.join(root, "out"),
                                checkpoint=os.path.join(root, "ck"), completer_factory=echo_completer_factory(),
                                trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(root, "out"))
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]
    assert {r.id: r.triple_status for r in out.collect()}[2] in ("ok", "error")
    # a restart on the same checkpoint processes only new files: no duplicates
    spark.createDataFrame([(4, "new report here")], schema).write.parquet(os.path.join(src, "f3"))
    q = start_extraction_stream(spark, source=os.path.join(src, "*"), schema=schema, sink=os.path.join(root, "out"),
                                checkpoint=os.path.join(root, "ck"), completer_factory=echo_completer_factory(),
                                trigger_once=True)
    q.awaitTermination(120)
    again = spark.read.parquet(os.path.join(root, "out"))
    assert sorted(r.id for r in again.collect()) == [1, 2, 3, 4]


def test_stream_of_requests_retries_and_restarts(spark):
    """No report is lost or doubled: repeated reports, failing calls, a run that dies
    after its log is written and before its epoch is committed."""
    from bugsift.operators.complete import EchoCompleter
    from bugsift.streaming import requests as R
    root = tempfile.mkdtemp(prefix="bugsift-requests-", dir="/tmp")
    src, log, ck = (os.path.join(root, x) for x in ("in", "log", "ck"))
    rows = [(i, f"alpha{i} beta gamma") for i in range(40)] + [(41, None), (3, "alpha3 beta gamma")]
    spark.createDataFrame(rows, "id long, text string").write.parquet(os.path.join(src, "f1"))

    def reports():
        return spark.readStream.schema("id long, text string").parquet(os.path.join(src, "*"))

    how = dict(log=log, checkpoint=ck, completer_factory=lambda: EchoCompleter(4), retries=2)
    R.start_requests(reports(), **how).awaitTermination()
    assert R.waiting(spark, log) > 0
    # the epoch's commit is lost: it runs again, finds its log and adds nothing
    first = sorted(R.attempts(spark, log).collect(), key=str)
    last = max(f for f in os.listdir(os.path.join(ck, "commits")) if f.isdigit())
    for name in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(ck, "commits", name)):
            os.remove(os.path.join(ck, "commits", name))
    spark.createDataFrame([(50, "one more report"), (7, "alpha7 beta gamma")], "id long, text string").write.parquet(
        os.path.join(src, "f2"))
    out = R.complete_stream(reports, **how).collect()
    assert first == sorted((r for r in R.attempts(spark, log).collect() if r["epoch"] <= int(last)), key=str)
    assert sorted(r["id"] for r in out) == [*range(40), 41, 50]
    import hashlib
    from bugsift.functions import prompts as P
    said = spark.read.parquet(os.path.join(src, "*")).select(
        "id", F.element_at(P.build_prompt(F.coalesce("text", F.lit("")), "prefix_one_shot"), -1)["content"].alias("m"))
    kind = {r["id"]: int(hashlib.md5(r["m"].encode()).hexdigest()[:8], 16) % 4 for r in said.collect()}
    assert {r["id"]: (r["status"], r["attempts"]) for r in out} == {
        i: ("failed", 3) if h == 1 else ("ok", 2 if h == 0 else 1) for i, h in kind.items()}
    assert {0, 1} <= set(kind.values()) and R.waiting(spark, log) == 0


def test_attempts_made_are_keys_of_the_jvm_state(spark):
    """Admission deals no report to Python by itself: its state is Spark's own table of
    (id, attempt), one key for each attempt made."""
    from bugsift.operators.complete import EchoCompleter
    from bugsift.streaming import requests as R
    root = tempfile.mkdtemp(prefix="bugsift-requests-", dir="/tmp")
    src, log, ck = (os.path.join(root, x) for x in ("in", "log", "ck"))
    spark.createDataFrame([(i % 30, f"alpha{i % 30} beta gamma") for i in range(60)], "id long, text string").write.parquet(
        os.path.join(src, "f1"))
    how = dict(log=log, checkpoint=ck, completer_factory=lambda: EchoCompleter(4), retries=1)
    open_table = lambda: spark.readStream.schema("id long, text string").parquet(os.path.join(src, "*"))
    for _ in range(2):
        q = R.start_requests(open_table(), **how)
        q.awaitTermination()
        ops = [o for p in q.recentProgress for o in p["stateOperators"]]
        assert ops and {o["operatorName"] for o in ops} == {"dedupe"}
        tried = R.attempts(spark, log).select("id", "attempts").collect()
        assert len(tried) == len(set(tried)) == ops[-1]["numRowsTotal"] and len({r["id"] for r in tried}) == 30
    assert R.waiting(spark, log) == 0

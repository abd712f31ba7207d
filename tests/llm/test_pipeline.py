import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bugsift.llm import decontaminate, secret_scan
from bugsift.llm.queries import ORACLE, QUERIES, piece_model

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name]).df()
    got = df.toPandas()[list(want.columns)]
    key = want.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert got.astype(str).equals(want.astype(str))


def test_pipeline_equals_brute_force(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in QUERIES["op6_quality_rules"](spark, SF).where("kept").collect()}
    comp = brute.jaccard_components([(d, docs[d]) for d in kept])
    kept = {d for d in kept if comp[d][1] == d}
    items = [(r["text"] or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = lambda t: [x.lower().strip(decontaminate._EDGE) for x in brute.WORD.findall(t)]
    leaked = set()
    for d in kept:
        w = clean(docs[d])
        own = set(w)
        for q in map(clean, items):
            e = len(q) * decontaminate.MAX_EDIT_PCT // 100
            if sum(x in own for x in q) >= len(q) - e and brute.edit_distance_to_any_window(q, w) <= e:
                leaked.add(d)
    kept -= leaked
    want = {}
    for d in kept:
        text = secret_scan.masked(docs[d], "[SECRET]")
        ids = lib.encode(text)
        want[d] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
           for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and leaked


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("id", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs.limit(0), docs.limit(20).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))):
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
            assert out.count() <= df.count()

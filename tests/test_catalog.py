import __spark_entry__ as E


def test_contract_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 60
    assert set(sql) <= set(qs)
    for name in sql:
        assert "SELECT" in sql[name].upper()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["doc_id", "rank", "term", "w"]

import __spark_entry__ as E


def test_contract(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.count() > 0
    assert "product_id" in df.columns


SMALL = "/root/testdata/sf0.001"


def test_every_query_runs(spark):
    """Each registered query, to its last row, with columns that SQL can name.  Those of the
    training-data operators run in tests/llm."""
    for name, fn in E.queries().items():
        if name.startswith(("op", "pipeline")):
            continue
        df = fn(spark, SMALL)
        assert len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()

import pytest
from pyspark.sql import functions as F

from opinio.operators import status as st


def test_each_product_has_its_status(spark):
    read = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 9)], "product_id string, v int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "product_id string")
    got = {r.product_id: (r.n_read, r.n_kept, r.status, r.message) for r in st.product_status(
        asked, [("read", read), ("kept", read.where("v > 1"))]).collect()}
    assert got == {"a": (2, 1, "ok", None), "b": (1, 0, "none_after_kept", st.NONE_LEFT),
                   "c": (0, 0, "no_reviews", st.NO_REVIEWS), None: (1, 1, "ok", None)}


def test_counts_come_with_the_job(spark):
    counts = st.StageCounts()
    df = counts.through(spark.range(100).toDF("n"), "read")
    kept = counts.through(df.where("n % 10 = 0"), "kept")
    assert kept.agg(F.sum("n")).first()[0] == 450
    assert counts.counts() == {"read": 100, "kept": 10}


def test_require_rows(spark):
    df = spark.range(3)
    assert st.require_rows(df) is df
    with pytest.raises(st.NoRows, match="No reviews remain after filtering"):
        st.require_rows(df.where("id > 5"))
    with pytest.raises(st.NoRows, match="input file"):
        st.require_rows(df.where("false"), st.NO_REVIEWS)

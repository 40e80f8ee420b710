"""Each registered operator query and the pipeline, run to the last row on the smallest tables."""

import pytest

from opinio.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_runs(spark, name):
    docs, rows = spark.read.parquet(f"{SMALL}/documents.parquet").count(), queries.QUERIES[name](spark, SMALL).count()
    if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op10", "op13"):
        assert rows == docs
    assert rows > 0

from pyspark.sql import functions as F

from opinio.operators import hooks


def test_entity_names_mixed(spark):
    df = spark.createDataFrame([('["battery life", {"entity": "grip"}, "", {"entity": "grip"}]',)], "x string")
    assert df.select(hooks.entity_names("x").alias("n")).first().n == ["battery life", "grip", "grip"]


def test_parse_summary_response(spark):
    df = spark.createDataFrame([('{"summary": "S1", "entities": ["a"]}',),
                                ('Sure! {"summary": "S2", "entities": [{"entity": "b"}]} thanks',),
                                ("plain text",)], "x string")
    got = [tuple(r.p) for r in df.select(hooks.parse_summary_response("x").alias("p")).collect()]
    assert got == [("S1", ["a"]), ("S2", ["b"]), ("plain text", [])]


def test_summary_by_udf_errors_are_rows(spark):
    prompts = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "boom")], "product_id string, prompt string")

    def gen(p):
        if p == "boom":
            raise RuntimeError("bad")
        return p.upper()
    got = {r.product_id: (r.summary, r.error) for r in hooks.summary_by_udf(prompts, gen).collect()}
    assert got["a"] == ("X", None)
    assert got["b"] == (hooks.MSG_NO_REVIEWS, None)
    assert got["c"][0] is None and got["c"][1].startswith("RuntimeError")


def test_encoder_hook(spark):
    def factory():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [r.v for r in df.select(hooks.encoder_udf(factory)(F.col("t")).alias("v")).collect()]
    assert got == [[2.0, 1.0], [0.0, 1.0]]

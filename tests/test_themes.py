from pyspark.sql import functions as F

from opinio.operators import themes as th


def strings(spark, counts):
    df = spark.createDataFrame([(counts,)], "c array<struct<theme:string,theme_idx:int,n:int>>")
    c, p = th.theme_strings(F.col("c"))
    return df.select(c.alias("cs"), p.alias("ps")).first()


def test_ties_in_dictionary_order(spark):
    r = strings(spark, [("value", 1, 2), ("quality", 0, 2), ("fit", 2, 0)])
    assert r.cs == "Quality (2), Value (2)"
    assert r.ps == "Quality 50%, Value 50%"


def test_half_even_rounding(spark):
    # shares 12.5 and 13.5 -> 12 and 14
    r = strings(spark, [("a", 0, 25), ("b", 1, 27), ("c", 2, 148)])
    assert r.ps == "C 74%, B 14%, A 12%"


def test_none_is_na(spark):
    r = strings(spark, [("a", 0, 0)])
    assert r.cs == "N/A" and r.ps == "N/A"

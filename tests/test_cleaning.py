from opinio.operators import cleaning as cl
from opinio.operators import report as rp


def test_dedupe_runs_before_strict(spark):
    text = "This is the same review text, long enough to pass."
    df = spark.createDataFrame([("A", None, text, "5", False, "0", 1), ("A", None, text, "5", True, "0", 2)],
                               "parent_asin string, title string, text string, rating string, "
                               "verified_purchase boolean, helpful_vote string, pos long")
    assert cl.clean_corpus(df, "strict").count() == 0
    assert cl.clean_corpus(df, "inclusive").count() == 1


def test_credibility_clamped(spark):
    df = spark.createDataFrame([(True, 100.0, "x" * 400), (False, 0.0, "short")],
                               "verified boolean, helpful_vote double, review_text string")
    got = [r.c for r in df.select(cl.credibility().alias("c")).collect()]
    assert got == [1.0, 0.5]


def test_resume_adds_nothing_second_time(spark):
    todo = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "parent_asin string, avg_rating double")
    done = spark.createDataFrame([("A", 9.0)], "parent_asin string, avg_rating double")
    first = rp.resume_anti_join(todo, done)
    assert [r.parent_asin for r in first.collect()] == ["B"]
    out = rp.upsert_keep_last(done, first)
    assert rp.resume_anti_join(todo, out).count() == 0

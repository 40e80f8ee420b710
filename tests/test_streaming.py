import datetime as dt
import tempfile

from pyspark.sql import functions as F

from opinio.streaming import refresh as st

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_three_batches_late_and_repeated_rows(spark):
    src, run = (tempfile.mkdtemp(prefix="opinio-stream-") for _ in range(2))
    day = dt.datetime(2024, 3, 1, 12)
    batches = [[(1, 7, day, 1.0), (2, 7, day, 2.0)],
               [(3, 8, day + dt.timedelta(days=40), 1.0), (1, 7, day + dt.timedelta(days=31), 1.0)],
               [(4, 8, day - dt.timedelta(days=90), 5.0), (3, 8, day, 1.0)]]
    for rows in batches:
        feed(spark, src, "b", rows)
        stream = st.review_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
        st.stage_reviews(stream, f"{run}/staged", f"{run}/checkpoint").awaitTermination()
    staged = st.staged_reviews(spark, f"{run}/staged")
    assert {(r.product_id, r.new_reviews) for r in st.review_counts(staged).collect()} == {("7", 2), ("8", 2)}
    assert sum(r.new_reviews for r in st.daily_counts(staged).collect()) == 4


def test_refresh_repeats_after_n_more(spark):
    src, run = (tempfile.mkdtemp(prefix="opinio-refresh-") for _ in range(2))
    day = dt.datetime(2024, 3, 1)
    done, ran = None, []
    for k in range(3):
        feed(spark, src, "b", [(k * 10 + i, 7 if k != 1 or i < 2 else 8, day, 1.0) for i in range(3)])
        stream = st.review_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
        st.stage_reviews(stream, f"{run}/staged", f"{run}/checkpoint").awaitTermination()
        due = st.refresh_after_n(spark, f"{run}/staged", done, 3, lambda p: p.withColumn("v", F.lit(k)),
                                 f"{run}/out", f"{run}/done-{k}")
        ran.append(sorted(r.product_id for r in due.collect()))
        done = due if done is None else done.unionByName(due)
    assert ran == [["7"], [], ["7"]]
    assert {(r.product_id, r.v) for r in spark.read.parquet(f"{run}/out").collect()} == {("7", 2)}

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from opinio.streaming import event_time as et
from opinio.streaming import refresh as st

SCHEMA = "event_id long, user_id long, ts timestamp, value double"
DAY = dt.datetime(2024, 3, 1, 12)


def at(days, hours=0):
    return DAY + dt.timedelta(days=days, hours=hours)


BATCHES = [[(1, 7, at(0), 1.0), (2, 7, at(1), 1.0), (3, 8, at(6), 1.0), (2, 7, at(1), 1.0)],
           # 1 again and a new row of day 0: late (watermark day 3 noon); 3 again: a repeat; 4 is old but in time
           [(1, 7, at(0), 1.0), (5, 7, at(0), 1.0), (3, 8, at(6), 1.0), (4, 7, at(4), 1.0), (6, 8, at(9), 1.0)],
           # 7 lies exactly on the watermark (day 6 noon) and is late, 8 is an hour younger
           [(7, 8, at(6), 1.0), (8, 8, at(6, 1), 1.0), (9, 7, at(9), 1.0)]]
CLOSED = [{("03-01", "7", 1), ("03-02", "7", 1)},
          {("03-01", "7", 1), ("03-02", "7", 1), ("03-05", "7", 1)},
          {("03-01", "7", 1), ("03-02", "7", 1), ("03-05", "7", 1)}]
OPEN = {("03-01", "7", 1), ("03-02", "7", 1), ("03-05", "7", 1), ("03-07", "8", 2), ("03-10", "8", 1), ("03-10", "7", 1)}


def deliver(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
    return st.review_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)


def counts(df):
    return {(r.day, r.product_id, r.new_reviews) for r in df.select(
        F.date_format("window.start", "MM-dd").alias("day"), "product_id", "new_reviews").collect()}


@pytest.fixture()
def run():
    return tempfile.mkdtemp(prefix="opinio-event-time-")


def test_append_mode_withholds_open_windows_over_restarts(spark, run):
    for rows, closed in zip(BATCHES, CLOSED, strict=True):
        stream = deliver(spark, f"{run}/src", rows)
        et.write_closed(et.windowed_counts(stream, "3 days"), f"{run}/out", f"{run}/cp").awaitTermination()
        assert counts(spark.read.parquet(f"{run}/out")) == closed
    # a run without new rows changes nothing
    et.write_closed(et.windowed_counts(stream, "3 days"), f"{run}/out", f"{run}/cp").awaitTermination()
    assert counts(spark.read.parquet(f"{run}/out")) == CLOSED[-1]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != et.ROCKSDB


def test_update_mode_over_restarts_and_a_batch_run_again(spark, run):
    import glob
    import os
    for rows in BATCHES:
        stream = deliver(spark, f"{run}/src", rows)
        et.write_updates(et.windowed_counts(stream, "3 days"), f"{run}/out", f"{run}/cp").awaitTermination()
    assert counts(et.latest_counts(spark, f"{run}/out")) == OPEN
    # the job was lost after it had written its last batch and before it had noted that: the batch runs again
    commits = sorted((f for f in glob.glob(f"{run}/cp/commits/*") if os.path.basename(f).isdigit()),
                     key=lambda f: int(os.path.basename(f)))
    for f in (commits[-1], os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")):
        if os.path.exists(f):
            os.remove(f)
    et.write_updates(et.windowed_counts(stream, "3 days"), f"{run}/out", f"{run}/cp").awaitTermination()
    assert counts(et.latest_counts(spark, f"{run}/out")) == OPEN


def test_keyed_refresh_counts_over_restarts(spark, run):
    ran = []

    def recompute(products):
        ran.append(sorted(r.product_id for r in products.collect()))
        return products.withColumn("v", F.lit(len(ran)))

    feeds = [[(i, 7, at(0), 1.0) for i in (1, 2)] + [(3, 8, at(0), 1.0)],
             [(4, 7, at(0), 1.0), (1, 7, at(0), 1.0), (5, 8, at(0), 1.0)],      # 7 has three, one repeat not counted
             [(i, 8, at(1), 1.0) for i in range(10, 16)],                       # 8 has eight: one refresh, not two
             [(20, 7, at(1), 1.0), (21, 7, at(1), 1.0), (22, 7, at(1), 1.0)]]
    for rows in feeds:
        stream = deliver(spark, f"{run}/src", rows)
        for _ in range(2):      # the second run has no new rows
            et.refresh_when_due(stream, 3, "30 days", f"{run}/due", f"{run}/cp", recompute, f"{run}/out").awaitTermination()
    assert ran == [["7"], ["8"], ["7"]]
    due = {(r.product_id, r.refresh, r.new_reviews) for r in spark.read.parquet(f"{run}/due").collect()}
    assert due == {("7", 1, 3), ("8", 1, 8), ("7", 2, 3)}
    assert {(r.product_id, r.v) for r in spark.read.parquet(f"{run}/out").collect()} == {("7", 3), ("8", 2)}

"""Queries over the events as a review feed that arrives in three deliveries.

The stand-in feed has the rows of ``events`` in the order of their days; every 19th
row arrives a delivery later, every 97th two later, and every 7th comes once more with
the next delivery.  Each delivery is one run of the streaming job, resumed from its
checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.plans.catalog import register
from opinio.session import checkpoint_dir
from opinio.sources.tables import table
from opinio.streaming import event_time as et
from opinio.streaming import refresh as st

LATENESS = "5 days"
AFTER_N = 20
DELIVERIES = 3

_ARRIVALS = """sent AS (SELECT event_id, user_id, ts, CAST(least(floor((day(ts) - 1) / 10), 2)
        + CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS INTEGER) AS b FROM events),
fed AS (SELECT *, least(b, 2) AS batch FROM sent
        UNION ALL SELECT *, least(b + 1, 2) FROM sent WHERE event_id % 7 = 0 AND b < 2),
wm AS (SELECT batch, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY batch)) - INTERVAL 5 DAY AS mark
       FROM fed GROUP BY batch),
new AS (SELECT event_id, any_value(user_id) AS user_id, any_value(ts) AS ts, min(f.batch) AS batch
        FROM fed f LEFT JOIN wm ON wm.batch = f.batch - 1 WHERE wm.mark IS NULL OR f.ts > wm.mark GROUP BY event_id)"""


def _deliver(spark: SparkSession, sf: str, name: str, start: Callable[[DataFrame, str], object]) -> str:
    """Run ``start(feed, folder)`` once after each delivery; the folder of the run."""
    run = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    late = F.when(F.col("event_id") % 97 == 0, 2).when(F.col("event_id") % 19 == 0, 1).otherwise(0)
    sent = e.withColumn("b", (F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) + late).cast("int"))
    fed = sent.withColumn("batch", F.least("b", F.lit(2))).unionByName(
        sent.where((F.col("event_id") % 7 == 0) & (F.col("b") < 2)).withColumn("batch", F.least(F.col("b") + 1, F.lit(2))))
    for k in range(DELIVERIES):
        fed.where(F.col("batch") == k).select(*e.columns).write.mode("append").parquet(f"{run}/feed")
        start(st.review_stream(spark, f"{run}/feed", e.schema), run).awaitTermination()
    return run


def _days(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "product_id", "new_reviews")


@register("stream_daily_counts_closed", f"""WITH {_ARRIVALS}
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS product_id, count(*) AS new_reviews
FROM new WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(mark) FROM wm) GROUP BY ALL""")
def q_stream_daily_counts_closed(spark, sf):
    """Append mode: days that the watermark has passed.  Runs streaming jobs when called."""
    run = _deliver(spark, sf, "closed", lambda feed, at: et.write_closed(
        et.windowed_counts(feed, LATENESS), f"{at}/out", f"{at}/checkpoint"))
    return _days(spark.read.parquet(f"{run}/out"))


@register("stream_daily_counts_updated", f"""WITH {_ARRIVALS}
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS product_id, count(*) AS new_reviews
FROM new GROUP BY ALL""")
def q_stream_daily_counts_updated(spark, sf):
    """Update mode: the newest count of every day.  Runs streaming jobs when called."""
    run = _deliver(spark, sf, "updated", lambda feed, at: et.write_updates(
        et.windowed_counts(feed, LATENESS), f"{at}/out", f"{at}/checkpoint"))
    return _days(et.latest_counts(spark, f"{run}/out"))


@register("stream_refresh_due", f"""WITH {_ARRIVALS},
c AS (SELECT CAST(user_id AS VARCHAR) AS product_id, count_if(batch = 0) AS n0, count_if(batch = 1) AS n1,
      count_if(batch = 2) AS n2 FROM new GROUP BY ALL),
s1 AS (SELECT *, n1 + CASE WHEN n0 >= {AFTER_N} THEN 0 ELSE n0 END AS m1 FROM c),
s2 AS (SELECT *, n2 + CASE WHEN m1 >= {AFTER_N} THEN 0 ELSE m1 END AS m2 FROM s1),
due AS (SELECT product_id, 0 AS batch, n0 AS new_reviews FROM s2 UNION ALL SELECT product_id, 1, m1 FROM s2
        UNION ALL SELECT product_id, 2, m2 FROM s2)
SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY batch) AS refresh, new_reviews
FROM due WHERE new_reviews >= {AFTER_N}""")
def q_stream_refresh_due(spark, sf):
    """Products refreshed after N new reviews, by counters in keyed state.  Runs streaming jobs when called."""
    run = _deliver(spark, sf, "due", lambda feed, at: et.refresh_when_due(
        feed, AFTER_N, LATENESS, f"{at}/due", f"{at}/checkpoint"))
    return spark.read.parquet(f"{run}/due").select("product_id", "refresh", "new_reviews")

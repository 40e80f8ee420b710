"""The credibility report of a whole corpus as a job that can be stopped and resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.operators.report import credibility_report, resume_anti_join, upsert_keep_last
from opinio.schemas import SUMMARY_ROW
from opinio.session import materialize
from opinio.sources.published import publish, published
from opinio.sources.sinks import read_checkpoint_csv

KEY = "parent_asin"


def run_credibility_report(cleaned: DataFrame, path: str, batches: int = 8, stop_after: int | None = None,
                           checkpoint_csv: str | None = None, min_reviews: int = 50, **options) -> DataFrame:
    """Bring the report table at ``path`` up to date and return it.

    Products that the table does not have yet are dealt into ``batches`` by a hash of
    their key.  Each batch is summarised, merged into the table (the last row of a
    product wins) and published in one step, so a job that is lost leaves whole batches
    and the next run does the rest.  ``checkpoint_csv`` is a report written by
    ``write_summary_csv``: its products count as done and are taken over when the table
    is empty.  ``stop_after`` ends the run after so many batches.  Other options are
    those of ``credibility_report``.  Runs jobs when called.
    """
    spark = cleaned.sparkSession
    if published(spark, path) is None:
        before = read_checkpoint_csv(spark, checkpoint_csv) if checkpoint_csv else spark.createDataFrame([], SUMMARY_ROW)
        publish(before, path)
    reviews = materialize(cleaned)      # duplicates are found over the whole corpus, once
    products = reviews.groupBy(KEY).agg(F.count("rating").alias("n")).where(F.col("n") >= min_reviews).select(KEY)
    todo = materialize(resume_anti_join(products, published(spark, path), KEY).withColumn(
        "batch", F.pmod(F.xxhash64(KEY), F.lit(batches))))
    left = sorted(r.batch for r in todo.select("batch").distinct().collect())     # at most ``batches`` numbers
    for batch in left[:stop_after]:
        of = todo.where(F.col("batch") == batch).select(F.col(KEY).alias("_of"))
        rows = reviews.join(of, F.col(KEY).eqNullSafe(F.col("_of")), "left_semi")
        new = credibility_report(rows, min_reviews=min_reviews, **options)
        publish(upsert_keep_last(published(spark, path), new, KEY), path)
    return published(spark, path)


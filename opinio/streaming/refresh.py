"""Append-only review streams.

Every micro-batch is appended to a staged table under its batch id (a retried
batch rewrites its own folder).  Distinct reviews are counted on the staged
table, so neither late rows nor repeats far apart in time change the result.
Products that gathered N new reviews since their last refresh are recomputed
and overwritten.  Folders are parameters: a restarted job finds its own.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.session import materialize

SPREAD = 256    # folders of the recomputed table: a hash of the product, not one folder each


def review_stream(spark: SparkSession, source_dir: str, schema) -> DataFrame:
    """events parquet as a review feed with event time as TIMESTAMP."""
    ev = spark.readStream.schema(schema).parquet(source_dir)
    return ev.select(F.col("user_id").cast("string").alias("product_id"),
                     F.col("event_id").alias("review_id"),
                     F.col("ts").cast("timestamp").alias("ts"),
                     F.col("value").alias("rating"))


def stage_reviews(stream: DataFrame, staged_dir: str, checkpoint: str, available_now: bool = True):
    """Append every row to ``staged_dir/batch_id=<id>`` (idempotent by batch)."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staged_dir}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def staged_reviews(spark: SparkSession, staged_dir: str, schema=None) -> DataFrame:
    """The distinct staged reviews: of rows with one id the first by (ts, batch_id).

    A grouped minimum, combined before the shuffle.
    """
    staged = spark.read.parquet(staged_dir)
    rest = [c for c in staged.columns if c != "review_id"]
    order = ["ts", "batch_id"] + [c for c in rest if c not in ("ts", "batch_id")]
    first = staged.groupBy("review_id").agg(F.min(F.struct(*order)).alias("r"))
    return first.select("review_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def review_counts(reviews: DataFrame) -> DataFrame:
    """Distinct new reviews per product."""
    return reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("new_reviews"))


def daily_counts(reviews: DataFrame) -> DataFrame:
    """The same in tumbling windows of a day of event time."""
    return reviews.groupBy(F.window("ts", "1 day").alias("day"), "product_id").agg(
        F.count(F.lit(1)).alias("new_reviews"))


def refresh_after_n(spark: SparkSession, staged_dir: str, refreshed: DataFrame | None, n: int,
                    recompute: Callable[[DataFrame], DataFrame], out_dir: str, done_dir: str) -> DataFrame:
    """Products with >= n distinct new reviews since their last refresh are recomputed
    by ``recompute(products)`` and overwritten.

    ``refreshed`` has (product_id, last_batch_id); only reviews first staged in a
    later batch count.  The products refreshed now, with the last batch id of the
    staged table, are written to ``done_dir`` and returned: they belong into
    ``refreshed`` next time.
    """
    staged = spark.read.parquet(staged_dir)
    last = staged.agg(F.max("batch_id").alias("last_batch_id"))
    first = staged.groupBy("product_id", "review_id").agg(F.min("batch_id").alias("batch_id"))
    if refreshed is not None:
        seen = refreshed.groupBy("product_id").agg(F.max("last_batch_id").alias("_seen"))
        first = first.join(seen, "product_id", "left").where(
            F.col("batch_id") > F.coalesce("_seen", F.lit(-1)))
    due = first.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select("product_id")
    newest = last.first()
    due = due.withColumn("last_batch_id", F.lit(None if newest is None else newest[0]).cast("long"))
    due.write.mode("overwrite").parquet(done_dir)
    due = spark.read.parquet(done_dir)
    replace_products(recompute(due.select("product_id")), due.select("product_id"), out_dir)
    return due


def replace_products(rows: DataFrame, due: DataFrame, out_dir: str) -> None:
    """Replace the rows of the ``due`` products in the table ``out_dir`` by ``rows``.

    The table lies in folders by a hash of the product; only folders of due products
    are written, and what else they hold is carried over.
    """
    part = F.pmod(F.xxhash64("product_id"), F.lit(SPREAD)).cast("int")
    out = rows.withColumn("part", part)
    try:
        old = rows.sparkSession.read.parquet(out_dir)
    except Exception as e:  # noqa: BLE001 -- first run: nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        touched = due.select(part.alias("part")).distinct()
        keep = (old.join(touched, "part", "leftsemi").join(due.select("product_id"), "product_id", "leftanti"))
        out = materialize(out.unionByName(keep.select(*out.columns)))
    (out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part").parquet(out_dir))

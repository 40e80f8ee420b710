"""Event-time state over a review feed: counted windows and refresh counters.

All state lives in Spark's state store under the query's checkpoint, so a restarted
query goes on where it stopped and a batch that is run again gives the same result.

*Lateness rule.*  A row is late when its event time is not after the watermark: the
largest event time of all earlier batches, in milliseconds, less ``lateness``.  Late
rows are dropped; what they would have added is not counted again later.  A review
that comes twice is counted once as long as its repeat is not late.

State is bounded by the feed, not by its history: review ids are forgotten when the
watermark has passed them by ``lateness``, windows when it has passed their end.  Only
the refresh counters stay, two numbers a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from opinio.streaming.refresh import replace_products

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB (off the heap, and needed by
    ``transformWithState``); the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def distinct_in_time(stream: DataFrame, lateness: str, id_col: str = "review_id", time_col: str = "ts") -> DataFrame:
    """The feed under a watermark, each review once."""
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])


def windowed_counts(stream: DataFrame, lateness: str, window: str = "1 day", key: str = "product_id") -> DataFrame:
    """(window, product, new_reviews): distinct reviews in tumbling windows of event time."""
    return (distinct_in_time(stream, lateness).groupBy(F.window("ts", window).alias("window"), key)
            .agg(F.count(F.lit(1)).alias("new_reviews")))


def write_closed(counts: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Append mode: a window is written once, when the watermark has passed its end; open
    windows are withheld.  The file sink's log makes each batch count once."""
    with rocksdb_state(counts.sparkSession):
        return (counts.writeStream.outputMode("append").format("parquet").option("path", out_dir)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_updates(counts: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Update mode: every batch writes the windows that it changed into a folder of its own,
    which it overwrites when it is run again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    with rocksdb_state(counts.sparkSession):
        return (counts.writeStream.outputMode("update").foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, out_dir: str, key: str = "product_id") -> DataFrame:
    """The newest count of every window, open ones included (combined before the shuffle)."""
    updates = spark.read.parquet(out_dir)
    return updates.groupBy("window", key).agg(F.max_by("new_reviews", "batch_id").alias("new_reviews"))


class RefreshCounter(StatefulProcessor):
    """Per product: reviews since the last refresh, and the number of refreshes so far.

    A product whose count reaches ``n`` is due: one row comes out and its count starts
    again at zero, whatever the number by which the batch went past ``n``.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "waiting long, refreshes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 -- Spark's names
        waiting, refreshes = self.seen.get() if self.seen.exists() else (0, 0)
        waiting += sum(len(part) for part in rows)
        if waiting >= self.n:
            refreshes += 1
            yield pd.DataFrame({"product_id": [key[0]], "refresh": [refreshes], "new_reviews": [waiting]})
            waiting = 0
        self.seen.update((waiting, refreshes))

    def close(self) -> None:
        pass


def due_products(stream: DataFrame, n: int, lateness: str) -> DataFrame:
    """(product_id, refresh, new_reviews): a row each time a product has gathered ``n`` new reviews.

    Only key and id reach the Python workers; the rows of a hot product are streamed
    through its task in Arrow batches and counted, never held.
    """
    fed = distinct_in_time(stream.select("product_id", "review_id", "ts"), lateness)
    return fed.select("product_id").groupBy("product_id").transformWithStateInPandas(
        RefreshCounter(n), "product_id string, refresh long, new_reviews long", "Update", "none")


def refresh_when_due(stream: DataFrame, n: int, lateness: str, due_dir: str, checkpoint: str,
                     recompute: Callable[[DataFrame], DataFrame] | None = None, out_dir: str | None = None) -> StreamingQuery:
    """Write due products a batch (folder ``batch_id=<id>`` of ``due_dir``) and, with
    ``recompute(products)``, replace exactly their rows in the table ``out_dir``."""
    def refresh(batch: DataFrame, batch_id: int) -> None:
        path = f"{due_dir}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        due = batch.sparkSession.read.schema(batch.schema).parquet(path).select("product_id")
        if recompute is not None and not due.isEmpty():
            replace_products(recompute(due), due, out_dir)

    with rocksdb_state(stream.sparkSession):
        return (due_products(stream, n, lateness).writeStream.outputMode("update").foreachBatch(refresh)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

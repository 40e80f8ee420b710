"""What a sentence index was built from, and its rebuild for the products that changed.

The state of an index is one row a product: how many reviews were indexed and a
digest of their ids and texts that does not depend on their order.  A product is
stale when that row differs, so an edited text is found although the number of
reviews is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.operators.sentences import sentence_index
from opinio.session import materialize
from opinio.sources.published import publish, published
from opinio.sources.sinks import read_sentence_index, write_sentence_index


def content_digest(reviews: DataFrame, key: str = "product_id", id_col: str = "review_id",
                   text_col: str = "text") -> DataFrame:
    """(product, n_reviews, h_sum, h_xor) of the reviews that an index holds.

    Two 64-bit hashes of each (id, text) are folded by sum and by exclusive or:
    neither depends on the order, repeats count in the sum, and both are combined
    before the shuffle, so a hot product costs one row a task.  Reviews without id
    or text have no sentences and do not count.
    """
    held = reviews.where((F.coalesce(F.col(id_col), F.lit("")) != "") & (F.coalesce(F.col(text_col), F.lit("")) != ""))
    return held.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum(F.xxhash64(id_col, text_col).cast("decimal(20,0)")).alias("h_sum"),
        F.bit_xor(F.xxhash64(text_col, id_col)).alias("h_xor"))


def stale_products(state: DataFrame, current: DataFrame, key: str = "product_id") -> DataFrame:
    """(product, cached_reviews, current_reviews, reason) of two digests: ``new``, ``gone``,
    ``count`` (another number of reviews), ``content`` (as many, but others) or null (fresh)."""
    a = state.select(F.col(key).alias("_a"), F.col("n_reviews").alias("cached_reviews"), F.struct("h_sum", "h_xor").alias("_was"))
    b = current.select(F.col(key).alias("_b"), F.col("n_reviews").alias("current_reviews"), F.struct("h_sum", "h_xor").alias("_is"))
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    reason = (F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone")
              .when(F.col("cached_reviews") != F.col("current_reviews"), "count")
              .when(F.col("_was") != F.col("_is"), "content"))
    return both.select(F.coalesce("_b", "_a").alias(key), F.coalesce("cached_reviews", F.lit(0)).alias("cached_reviews"),
                       F.coalesce("current_reviews", F.lit(0)).alias("current_reviews"), reason.alias("reason"))


def refresh_sentence_index(reviews: DataFrame, path: str, build: Callable[[DataFrame], DataFrame] = sentence_index) -> DataFrame:
    """Bring the stored index at ``path`` up to date and return ``stale_products`` of the run.

    Sentences lie in a folder a product; only folders of products that are new or
    changed are written, all others keep their files.  The new state is published
    after them: a run that is lost between the two writes the same folders again.  A
    product without reviews leaves the state, and with it what readers see.  Reviews
    without a product are not indexed.  Runs jobs when called.
    """
    spark = reviews.sparkSession
    named = reviews.where(F.col("product_id").isNotNull())
    current = materialize(content_digest(named))
    state = published(spark, f"{path}/state")
    if state is None:
        state = current.where(F.lit(False))
    stale = materialize(stale_products(state, current))
    todo = stale.where(F.col("reason").isin("new", "count", "content")).select("product_id")
    if not todo.isEmpty():
        write_sentence_index(build(named.join(todo, "product_id", "left_semi")), f"{path}/sentences")
    if not stale.where(F.col("reason").isNotNull()).isEmpty():
        publish(current, f"{path}/state")
    return stale


def stored_sentence_index(spark: SparkSession, path: str) -> DataFrame:
    """The sentences of all products that the index has now."""
    return read_sentence_index(spark, f"{path}/sentences").join(
        published(spark, f"{path}/state").select("product_id"), "product_id", "left_semi")

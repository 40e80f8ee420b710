"""Per-product aggregates.  All are groupBy aggregations with map-side
partial aggregation, so a hot product is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions import text as tx


def total_reviews(reviews: DataFrame, key: str = "product_id") -> DataFrame:
    return reviews.groupBy(key).agg(F.countDistinct("review_id").alias("total_reviews"))


def rating_distribution(reviews: DataFrame, key: str = "product_id") -> DataFrame:
    """Count and share per rating, keyed ``rating_<r>`` on the exact rating.

    Null ratings are not counted but are in the denominator.
    """
    tot = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    per = (reviews.where(F.col("rating").isNotNull()).groupBy(key, "rating")
           .agg(F.count(F.lit(1)).alias("count")))
    r = F.col("rating")
    label = F.when(r == F.floor(r), F.floor(r).cast("long").cast("string")).otherwise(r.cast("string"))
    return (per.join(tot, key)
            .select(key, F.concat(F.lit("rating_"), label).alias("rating_key"), "count",
                    (F.col("count") / F.col("_n")).alias("proportion")))


def index_staleness(cached_sentences: DataFrame, reviews: DataFrame, key: str = "product_id") -> DataFrame:
    """Per product: is the cached sentence index stale?

    Stale when the distinct review count differs (a product missing on
    either side counts as 0).  Like the reference, a changed text with an
    unchanged count is not detected.
    """
    a = cached_sentences.groupBy(key).agg(F.countDistinct("review_id").alias("cached_reviews"))
    b = reviews.groupBy(key).agg(F.countDistinct("review_id").alias("current_reviews"))
    out = a.join(b, key, "full_outer").fillna(0, ["cached_reviews", "current_reviews"])
    stale = ~(F.col("cached_reviews") == F.col("current_reviews"))
    return out.withColumn("stale", stale)


def review_overview(reviews: DataFrame, key: str = "product_id") -> DataFrame:
    """Flagship: per-product review overview plus sentence sentiment counts.

    Sentences are split and labelled inside each review row (no explode), so
    the whole report is one scan and one partial aggregation per product.
    """
    from opinio.dictionaries import NEGATIVE_WORDS, POSITIVE_WORDS
    from opinio.operators.themes import weighted_hits
    has = ((F.coalesce(F.col("review_id"), F.lit("")) != "")
           & (F.coalesce(F.col("text"), F.lit("")) != ""))
    sents = F.when(has, tx.sentence_array("text")).otherwise(F.array().cast("array<string>"))
    pw = {w: 1 for w in set(POSITIVE_WORDS)}
    nw = {w: 1 for w in set(NEGATIVE_WORDS)}
    # one token split per sentence; the label is the sign of positive - negative hits
    toks = F.transform(sents, lambda s: tx.tokens(s))
    labels = F.transform(toks, lambda t: F.signum(weighted_hits(t, pw) - weighted_hits(t, nw)).cast("int"))
    # the label array is its own column, so the four counts read it instead of
    # recomputing it (no common-subexpression elimination across lambdas)
    lab = reviews.select(F.col(key), F.col("rating"), F.col("helpful_votes"), F.col("text"),
                         labels.alias("_lab"))
    per = lab.select(
        F.col(key), F.col("rating"), F.col("helpful_votes"), F.col("text"),
        F.size("_lab").alias("_n"),
        F.size(F.filter("_lab", lambda x: x == 1)).alias("_p"),
        F.size(F.filter("_lab", lambda x: x == -1)).alias("_g"),
        F.size(F.filter("_lab", lambda x: x == 0)).alias("_u"))
    return per.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        (F.sum(F.coalesce(F.col("rating"), F.lit(0.0))) / F.count(F.lit(1))).alias("avg_rating"),
        F.count_if(F.coalesce(F.col("helpful_votes"), F.lit(0)) > 0).alias("helpful_reviews"),
        F.sum(tx.estimate_tokens("text")).alias("total_tokens"),
        F.sum("_n").cast("long").alias("n_sentences"),
        F.sum("_p").cast("long").alias("positive_sentences"),
        F.sum("_g").cast("long").alias("negative_sentences"),
        F.sum("_u").cast("long").alias("neutral_sentences"))

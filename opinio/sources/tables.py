"""Review-shaped views over the driver's parquet tables.

Each view is a projection (plus one join for ``reviews``) declared with the
DataFrame API, so column pruning and filters reach the parquet scan.
The same definitions are written in SQL for the DuckDB oracles
(``opinio.plans.views``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.dictionaries import NEGATIVE_FUNCTION_WORDS, POSITIVE_FUNCTION_WORDS
from opinio.functions.vectors import hash_embed
from opinio.operators.aspects import aspect_mining
from opinio.operators.sentences import lexicon_label, sentence_index
from opinio.session import spread, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, verified: bool = False) -> DataFrame:
    """documents as canonical reviews (M2 + product_id, pos): a projection of the scan.

    Only with ``verified`` are the labels joined, and Spark chooses how by their size.
    """
    d = spread(table(spark, sf_dir, "documents"))
    doc = F.col("doc_id")
    cols = [F.col("source").alias("product_id"),
            doc.cast("string").alias("review_id"),
            doc.alias("pos"),
            F.col("text"),
            (F.lit(1) + doc % 5).cast("double").alias("rating"),
            F.when(doc % 7 == 0, F.lit(None)).otherwise(doc % 13).cast("int").alias("helpful_votes"),
            F.col("lang")]
    if not verified:
        return d.select(*cols)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    cols.insert(5, (F.col("quality") == 1).alias("verified"))
    return d.join(labels, "doc_id", "left").select(*cols)


def corpus_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews view in the corpus (JSONL) shape: parent_asin, title, ..."""
    r = reviews(spark, sf_dir, verified=True)
    return r.select(F.col("product_id").alias("parent_asin"),
                    F.lit(None).cast("string").alias("title"),
                    "text", "rating",
                    F.col("verified").alias("verified_purchase"),
                    F.col("helpful_votes").cast("double").alias("helpful_vote"),
                    "pos", "lang")


def sentence_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as sentence rows: product = label, review = vec_id % 7."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(F.col("label").cast("string").alias("product_id"),
                    (v % 7).cast("string").alias("review_id"),
                    v.cast("int").alias("sentence_id"),
                    F.concat(F.lit("s"), v.cast("string")).alias("text"),
                    F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")),
                                 (v % 3 + 1).cast("int")).alias("sentiment"),
                    F.col("embedding"))


def doc_sentences(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """The sentence index of the reviews, with each review's place; labels come from
    word lists that occur in these texts.  Written once when called: what grounds,
    answers or selects reads the columns it needs."""
    r = reviews(spark, sf_dir)
    s = sentence_index(r, dim=dim, labeler=lambda c: lexicon_label(c, POSITIVE_FUNCTION_WORDS, NEGATIVE_FUNCTION_WORDS))
    return stored(s.withColumn("pos", F.col("review_id").cast("long")), "sentences")


def aspects(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """Entities: the mined aspects (1 to 5 words) of each product, embedded; written once."""
    a = aspect_mining(reviews(spark, sf_dir))
    return stored(a.select("product_id", F.col("rank").cast("int").alias("entity_idx"), F.col("aspect").alias("entity"),
                    hash_embed("aspect", dim).alias("embedding")), "aspects")


def questions(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """Questions: all user turns of ``conversations``, dealt to 25 products (five of
    which have no reviews); every 7th question is blank, every 11th has no vector."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    qid = F.col("conv_id") * 1000 + F.col("turn")
    q = spread(c).select(F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("product_id"),
                 qid.alias("question_id"), F.when(qid % 7 == 0, F.lit("  ")).otherwise(F.col("text")).alias("question"))
    return q.withColumn("embedding", F.when(F.col("question_id") % 11 != 0, hash_embed("question", dim)))

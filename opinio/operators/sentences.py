"""Sentence index: split reviews into sentences, label and embed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.functions.batches import list_hits


def split_sentences(reviews: DataFrame, key: str = "product_id", id_col: str = "review_id",
                    text_col: str = "text") -> DataFrame:
    """One row per non-empty sentence with dense 0-based ``sentence_id``.

    Rows with an empty id or text yield nothing.  A per-row generator: no
    shuffle, partitioning of the input is kept.
    """
    ok = reviews.where((F.coalesce(F.col(id_col), F.lit("")) != "")
                       & (F.coalesce(F.col(text_col), F.lit("")) != ""))
    return ok.select(F.col(key), F.col(id_col),
                     F.posexplode(tx.sentence_array(text_col)).alias("sentence_id", "text")
                     ).withColumn("sentence_id", F.col("sentence_id").cast("int"))


def label_to_sentiment(label, text=None):
    """Model label -> negative / positive / neutral; blank text -> neutral."""
    lab = F.lower(F.coalesce(label, F.lit("")))
    out = (F.when(lab.startswith("neg"), F.lit("negative"))
           .when(lab.startswith("pos"), F.lit("positive"))
           .otherwise(F.lit("neutral")))
    if text is not None:
        out = F.when(tx.strip(F.coalesce(text, F.lit(""))) == "", F.lit("neutral")).otherwise(out)
    return out


def lexicon_label(text_col="text", pos=None, neg=None):
    """Default offline sentiment: sign(positive hits - negative hits)."""
    from opinio.dictionaries import NEGATIVE_WORDS, POSITIVE_WORDS
    # counted in Arrow batches, from the same words as the hashing encoder's: Spark makes them once
    hits = list_hits([{w: 1 for w in (pos or POSITIVE_WORDS)}, {w: 1 for w in (neg or NEGATIVE_WORDS)}])(tx.spaced_words(text_col))
    return (F.when(hits[0] > hits[1], F.lit("positive")).when(hits[1] > hits[0], F.lit("negative"))
            .otherwise(F.lit("neutral")))


def sentence_index(reviews: DataFrame, key: str = "product_id", id_col: str = "review_id",
                   text_col: str = "text", dim: int = 64, encoder=None, labeler=None) -> DataFrame:
    """split -> label -> embed, as one lazy frame.

    ``encoder`` / ``labeler`` are Column -> Column hooks (e.g. an iterator
    pandas_udf that loads a model once per worker); the defaults are the
    JVM-side hashing encoder and lexicon labeler.
    """
    from opinio.functions.vectors import hash_embed
    s = split_sentences(reviews, key, id_col, text_col)
    lab = labeler(F.col("text")) if labeler else lexicon_label("text")
    emb = encoder(F.col("text")) if encoder else hash_embed("text", dim)
    return s.withColumn("sentiment", lab).withColumn("embedding", emb)

"""Corpus review cleaning: coercion, length/spam filters, dedupe, credibility.

Order matters and follows the batch job: length and spam filters, then
first-copy-wins dedupe, then personal-sentence stripping, and only then the
strict (verified-only) filter -- so an unverified first copy still removes a
verified later copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.dictionaries import SPAM_PHRASES, SPAM_WORDS_V2
from opinio.functions import text as tx


def canonicalize_corpus(df: DataFrame) -> DataFrame:
    """Coerce a corpus-shaped frame (M12) to typed columns.

    rating -> DOUBLE (bad -> null); helpful_vote -> DOUBLE (bad/null/absent
    -> 0); verified likewise (null -> false), or true when neither spelling of
    the column exists.  Where both spellings are there the first value counts.
    Adds ``review_text`` = strip(title + '. ' + text).
    """
    cols = set(df.columns)
    def first_value(kind: str, *names: str):
        found = [F.expr(f"try_cast(`{c}` AS {kind})") for c in names if c in cols]
        return F.coalesce(*found) if found else None

    rating = first_value("DOUBLE", "rating")
    rating = F.lit(None).cast("double") if rating is None else rating
    votes = first_value("DOUBLE", "helpful_vote", "helpful_votes")
    votes = F.lit(0.0) if votes is None else F.coalesce(votes, F.lit(0.0))
    verified = first_value("BOOLEAN", "verified_purchase", "verified")
    verified = F.lit(True) if verified is None else F.coalesce(verified, F.lit(False))
    title = F.col("title") if "title" in cols else F.lit(None).cast("string")
    return df.withColumns({
        "rating": rating,
        "helpful_vote": votes,
        "verified": verified,
        "review_text": tx.compose_review_text(title, F.col("text")),
    })


def min_length(df: DataFrame, col: str = "review_text", n: int = 30,
               inclusive: bool = False) -> DataFrame:
    """Keep rows whose text is longer than n (or at least n when inclusive)."""
    ln = F.length(F.coalesce(F.col(col), F.lit("")))
    return df.where(ln >= n if inclusive else ln > n)


def is_spam(col, phrases=SPAM_PHRASES) -> Column:
    return tx.contains_any(col, phrases)


def spam_filter(df: DataFrame, col: str = "review_text", phrases=SPAM_PHRASES) -> DataFrame:
    return df.where(~is_spam(col, phrases))


def dedupe_keep_first(df: DataFrame, text_col: str = "review_text",
                      order_col: str = "pos", rows: DataFrame | None = None) -> DataFrame:
    """One row per normalised text key: the first in file order.

    Keys are compared by their SHA-256 and the first ``order_col`` is found by a grouped
    minimum on narrow rows, combined before the shuffle; the winners' rows then come by a
    semi-join on ``order_col`` and a hash of the text, so texts are normalised once.
    ``order_col`` names a row.  ``rows`` are those that ``df`` was filtered from by the
    text alone: the winners are taken from them, and the filters are not run again.
    """
    keyed = df.select(F.sha2(tx.normalize_dup_key(text_col), 256).alias("_key"), F.struct(
        F.col(order_col).isNull().alias("n"), F.col(order_col).alias("o"), F.xxhash64(text_col).alias("h")).alias("_at"))
    first = keyed.groupBy("_key").agg(F.min("_at").alias("_at")).select(F.col("_at.o").alias("_first"), F.col("_at.h").alias("_hash"))
    won = F.col(order_col).eqNullSafe(F.col("_first")) & (F.xxhash64(text_col) == F.col("_hash"))
    return (df if rows is None else rows).join(first, won, "leftsemi")


def strict_mode(df: DataFrame, mode: str = "strict") -> DataFrame:
    """'strict' keeps verified reviews only; 'inclusive' keeps all."""
    if mode == "strict":
        return df.where(F.col("verified") == F.lit(True))
    if mode == "inclusive":
        return df
    raise ValueError(f"unknown filter mode {mode!r}")


def credibility(verified="verified", votes="helpful_vote", text="review_text",
                spam_phrases=SPAM_PHRASES, clamp: bool = True) -> Column:
    """1.0; -0.5 if not verified; +min(votes/50, .35); -0.4 if spam;
    +0.05 if longer than 300 characters; clamped to [0, 1]."""
    v = F.col(verified) if isinstance(verified, str) else verified
    hv = F.coalesce(F.col(votes).cast("double"), F.lit(0.0))
    t = F.coalesce(F.col(text), F.lit(""))
    s = (F.lit(1.0)
         - F.when(F.coalesce(v, F.lit(False)), 0.0).otherwise(0.5)
         + F.least(hv / 50.0, F.lit(0.35))
         - F.when(tx.contains_any(t, spam_phrases), 0.4).otherwise(0.0)
         + F.when(F.length(t) > 300, 0.05).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) if clamp else s


def credibility_open(verified_any: Column, votes: Column, text: Column,
                     spam_words=SPAM_WORDS_V2) -> Column:
    """Second-generation score: 1.0; +1.0 if verified; +min(.35, votes/50);
    +0.05 if more than 20 words; -0.4 if a spam word; not clamped."""
    t = F.coalesce(text, F.lit(""))
    return (F.lit(1.0)
            + F.when(F.coalesce(verified_any, F.lit(False)), 1.0).otherwise(0.0)
            + F.least(F.lit(0.35), F.coalesce(votes.cast("double"), F.lit(0.0)) / 50.0)
            + F.when(tx.word_count(t) > 20, 0.05).otherwise(0.0)
            - F.when(tx.contains_any(t, spam_words), 0.4).otherwise(0.0))


def clean_corpus(df: DataFrame, filter_mode: str = "strict", min_len: int = 30) -> DataFrame:
    """Canonical corpus reviews -> cleaned, deduplicated, scored reviews."""
    rows = canonicalize_corpus(df)
    c = min_length(rows, "review_text", min_len)
    c = spam_filter(c, "review_text")
    c = dedupe_keep_first(c, "review_text", "pos", rows)
    c = c.withColumn("clean_text", tx.strip_personal("review_text"))
    c = strict_mode(c, filter_mode)
    return c.withColumn("credibility_score", credibility())

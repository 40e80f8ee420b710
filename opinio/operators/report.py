"""Per-product credibility report (the corpus batch job as one Spark plan).

The report reads every sentence of every review.  Sentences stay rows
(product, review position, sentence position): themes are counted by partial
aggregation, the quoted sentences come from group-limited rankings, and the
summary from the exact greedy pick, so no product is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.dictionaries import NEGATIVE_WORDS, POSITIVE_WORDS, THEMES_V2
from opinio.functions import text as tx
from opinio.functions.batches import list_hits
from opinio.operators import themes as th
from opinio.operators.cleaning import canonicalize_corpus, credibility_open, min_length, strict_mode
from opinio.operators.selection import select_under_budget
from opinio.schemas import SUMMARY_COLUMNS
from opinio.session import stored


def report_sentences(cleaned: DataFrame, key: str, text_col: str, themes, pos=POSITIVE_WORDS,
                     neg=NEGATIVE_WORDS) -> DataFrame:
    """Every scored sentence: key, at (review position, place in the review), s, scores, wc."""
    x = cleaned.select(F.col(key), F.col("pos"), F.posexplode(tx.long_sentence_array(text_col)).alias("i", "s"))
    lists = [th.keyword_weights(themes, pos, neg), {w: 1 for w in set(pos)}, {w: 1 for w in set(neg)}]
    x = x.withColumn("_n", list_hits(lists)(tx.spaced_words("s")))
    return x.select(key, F.struct("pos", "i").alias("at"), "s", F.col("_n")[0].alias("score"), F.col("_n")[1].alias("pos_score"),
                    F.col("_n")[2].alias("neg_score"), tx.word_count("s").alias("wc"))


def quoted(sentences: DataFrame, key: str, score: str, k: int, out: str) -> DataFrame:
    """The k best sentences of each key by ``score`` (ties: text order), packed into one string."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col("at"))
    top = sentences.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    items = F.array_sort(F.collect_list(F.struct("_rn", "s")))
    return top.groupBy(F.col(key).alias("_of")).agg(
        tx.pack_evidence(F.transform(items, lambda x: x["s"])).alias(out))


def summaries(sentences: DataFrame, key: str, max_words: int) -> DataFrame:
    """Extractive summary of each key: sentences taken greedily by (score desc,
    text order) while they fit into ``max_words``, joined in text order.  Runs jobs."""
    picks = select_under_budget(sentences, key, "score", "at", "wc", max_words)
    chosen = sentences.join(picks.select(F.col(key).alias("_of"), F.col("at").alias("_at")),
                            F.col(key).eqNullSafe(F.col("_of")) & (F.col("at") == F.col("_at")), "leftsemi")
    items = F.array_sort(F.collect_list(F.struct("at", "s")))      # at most max_words of them
    return chosen.groupBy(F.col(key).alias("_of")).agg(
        F.array_join(F.transform(items, lambda x: x["s"]), " ").alias("summary"))


def theme_columns(cleaned: DataFrame, key: str, text_col: str, themes) -> DataFrame:
    """themes_counts and themes_pct of each key, over all its texts."""
    n = th.corpus_theme_counts(cleaned, key, text_col, themes)
    items = n.groupBy(F.col(key).alias("_of")).agg(F.collect_list(F.struct("theme", "theme_idx", "n")).alias("_t"))
    counts, pct = th.theme_strings(F.col("_t"))
    return items.select("_of", counts.alias("themes_counts"), pct.alias("themes_pct"))


def _with(df: DataFrame, key: str, part: DataFrame) -> DataFrame:
    return df.join(part, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")


def product_stats(df: DataFrame, key: str = "parent_asin") -> DataFrame:
    """Mean rating, count of non-null ratings, mean credibility; null key kept."""
    return df.groupBy(key).agg(F.avg("rating").alias("avg_rating"),
                               F.count("rating").alias("review_count"),
                               F.avg("credibility_score").alias("credibility_score"))


def product_stats_rows(df: DataFrame, key: str = "parent_asin",
                       cred_col: str = "credibility") -> DataFrame:
    """Second generation: row count, mean rating, mean credibility; null keys dropped."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("review_count"),
                 F.avg(cred_col).alias("credibility_score")))


def formatted_summary(review_count: Column, avg_rating: Column, cred: Column,
                      pct_str: Column, summary: Column, verified: bool) -> Column:
    return F.format_string(
        "Based on %d " + ("verified " if verified else "") +
        "reviews (avg rating %.1f/5, credibility %.2f). Top themes: %s. %s",
        review_count, F.bround(avg_rating, 1), F.bround(cred, 2), pct_str, summary)


def _report_parts(rows: DataFrame, stats: DataFrame, key: str, text_col: str, summary_words: int, themes, pos, neg,
                  verified: bool) -> DataFrame:
    """``stats`` with themes, quotes, summary and the formatted line of each product."""
    sents = stored(report_sentences(rows, key, text_col, themes, pos, neg), "scored-sentences")
    out = _with(stats, key, theme_columns(rows, key, text_col, themes))
    out = _with(out, key, summaries(sents, key, summary_words))
    for col, score, k in (("evidence", "score", 3), ("pos_snippets", "pos_score", 2), ("neg_snippets", "neg_score", 2)):
        out = _with(out, key, quoted(sents, key, score, k, col))
    out = out.fillna("N/A", ["themes_counts", "themes_pct"]).fillna(
        "", ["summary", "evidence", "pos_snippets", "neg_snippets"])
    return out.withColumn("formatted_summary", formatted_summary(
        F.col("review_count"), F.col("avg_rating"), F.col("credibility_score"),
        F.col("themes_pct"), F.col("summary"), verified))


def credibility_report(cleaned: DataFrame, min_reviews: int = 50, filter_mode: str = "strict",
                       summary_words: int = 120, themes=th.THEMES_GEN1, pos=POSITIVE_WORDS,
                       neg=NEGATIVE_WORDS) -> DataFrame:
    """Cleaned corpus reviews -> one 11-column summary row per product.

    Themes, quotes and summary cover the whole text of all reviews; a sentence
    ends with its review.  ``summary`` is extractive (the best keyword-scored
    sentences under a word cap); a generator can replace it through
    ``summary_by_udf``.  Runs jobs when called (the greedy pick).
    """
    key = "parent_asin"
    cleaned = stored(cleaned.select(key, "pos", "clean_text", "rating", "credibility_score"), "cleaned-reviews")
    stats = product_stats(cleaned).where(F.col("review_count") >= min_reviews)
    rows = cleaned.join(stats.select(F.col(key).alias("_of")), F.col(key).eqNullSafe(F.col("_of")), "leftsemi")
    out = _report_parts(rows, stats, key, "clean_text", summary_words, themes, pos, neg, filter_mode == "strict")
    return out.select(
        key,
        F.round("avg_rating", 3).alias("avg_rating"),
        F.col("review_count").cast("long").alias("review_count"),
        F.round("credibility_score", 3).alias("credibility_score"),
        *SUMMARY_COLUMNS[4:])


def credibility_report_v2(corpus: DataFrame, min_reviews: int = 50, filter_mode: str = "strict",
                          summary_words: int = 120, themes=THEMES_V2, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS) -> DataFrame:
    """Second generation: corpus reviews -> one 11-column row per product.

    Unlike the first it neither drops spam and duplicates nor strips sentences, scores
    with ``credibility_open`` (unbounded), keeps texts of at least 30 characters, counts
    rows (a null rating counts), has themes of its own, and rounds nothing but the
    formatted line.  Reviews without a product are left out.  Runs jobs when called.
    """
    key = "parent_asin"
    c = canonicalize_corpus(corpus).where(F.col(key).isNotNull())
    c = min_length(strict_mode(c, filter_mode), "text", 30, inclusive=True)
    c = c.withColumn("credibility", credibility_open(F.col("verified"), F.col("helpful_vote"), F.col("text")))
    c = stored(c.select(key, "pos", "text", "rating", "credibility"), "scored-reviews")
    stats = product_stats_rows(c, key).where(F.col("review_count") >= min_reviews)
    rows = c.join(stats.select(F.col(key).alias("_of")), F.col(key) == F.col("_of"), "leftsemi")
    return _report_parts(rows, stats, key, "text", summary_words, themes, pos, neg, False).select(*SUMMARY_COLUMNS)


def upsert_keep_last(existing: DataFrame, new: DataFrame, key: str = "parent_asin",
                     seq: str | None = None) -> DataFrame:
    """existing UNION ALL new, the last row per key wins (new over existing).

    Inside one side the row with the largest ``seq`` (an order column that both
    sides have) is the last; without it the rows of one side must have distinct
    keys.  Columns of either side are kept, null where a side lacks them.
    """
    both = (existing.withColumn("_batch", F.lit(0))
            .unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True))
    cols = [c for c in both.columns if c != "_batch"]
    order = F.struct("_batch", seq) if seq else F.col("_batch")
    last = both.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols if c != key]), order).alias("_r"))
    return last.select(key, "_r.*").select(*cols)


def resume_anti_join(todo: DataFrame, done: DataFrame, key: str = "parent_asin") -> DataFrame:
    """Drop products already summarised (compared as strings; no key is a key too)."""
    d = done.select(F.col(key).cast("string").alias("_done"))
    return todo.join(d, F.col(key).cast("string").eqNullSafe(F.col("_done")), "left_anti")

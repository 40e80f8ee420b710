"""Theme counting, keyword scoring, representative sentences and snippets.

Per-text work (a product's bounded text, or one review) is row-local array
code; corpus-wide counts go through a map-side-combined aggregation of only
the dictionary hits, never a shuffle of every token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.dictionaries import NEGATIVE_WORDS, POSITIVE_WORDS, THEMES_GEN1
from opinio.functions import text as tx
from opinio.functions.batches import list_hits


def keyword_weights(themes=THEMES_GEN1, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS) -> dict:
    """word -> number of (theme list, positive set, negative set) entries it hits."""
    w: dict = {}
    for _, words in themes:
        for word in words:
            w[word] = w.get(word, 0) + 1
    for word in set(pos):
        w[word] = w.get(word, 0) + 1
    for word in set(neg):
        w[word] = w.get(word, 0) + 1
    return w


def weighted_hits(tokens_col: Column, weights: dict) -> Column:
    """Sum of per-token weights (0 for tokens outside the dictionary)."""
    of: dict = {}
    for word, weight in weights.items():
        of.setdefault(int(weight), []).append(word)
    # words of one weight are a set of literals: a token is looked up, not compared with each
    def within(words):
        return F.size(F.filter(tokens_col, lambda t: t.isin(words)))
    hits = [within(words) * F.lit(k) for k, words in sorted(of.items())]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def keyword_score(col, themes=THEMES_GEN1, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS) -> Column:
    """Theme + positive + negative whole-word hits of one sentence."""
    return weighted_hits(tx.tokens(col), keyword_weights(themes, pos, neg))


def word_set_hits(col, words) -> Column:
    return weighted_hits(tx.tokens(col), {w: 1 for w in set(words)})


def theme_count_array(col, themes=THEMES_GEN1) -> Column:
    """ARRAY<STRUCT<theme, theme_idx, n>> of whole-word theme hits in one text.

    One pass over the tokens per theme with a word -> multiplicity map (a
    word listed twice in a theme counts twice, like a sum over the list).
    The tokens are split once, inside a one-element array, and read by field.
    """
    items = []
    for idx, (theme, words) in enumerate(themes):
        mult: dict = {}
        for w in words:
            mult[w] = mult.get(w, 0) + 1
        items.append((theme, idx, mult))
    holder = F.array(F.struct(tx.tokens(col).alias("t")))
    per = F.transform(holder, lambda h: F.array(*[
        F.struct(F.lit(theme).alias("theme"), F.lit(idx).alias("theme_idx"),
                 weighted_hits(h["t"], mult).alias("n")) for theme, idx, mult in items]))
    return F.element_at(per, 1)


def _capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def theme_strings(counts: Column) -> tuple[Column, Column]:
    """("Quality (3), Value (1)", "Quality 75%, Value 25%") or 'N/A'.

    Count descending, ties in dictionary order; percentages are half-even
    rounded shares of the total (total 0 counts as 1).
    """
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    total = F.when(total == 0, F.lit(1)).otherwise(total)
    items = F.array_sort(F.transform(
        F.filter(counts, lambda x: x["n"] > 0),
        lambda x: F.struct((-x["n"]).alias("k"), x["theme_idx"].alias("i"),
                           x["theme"].alias("theme"), x["n"].alias("n"))))
    cstr = F.array_join(F.transform(items, lambda x: F.concat(
        _capitalize(x["theme"]), F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    pstr = F.array_join(F.transform(items, lambda x: F.concat(
        _capitalize(x["theme"]), F.lit(" "),
        F.bround(F.lit(100.0) * x["n"] / total, 0).cast("int").cast("string"), F.lit("%"))), ", ")
    na = F.lit("N/A")
    return (F.when(cstr == "", na).otherwise(cstr), F.when(pstr == "", na).otherwise(pstr))


def scored_sentences(col, themes=THEMES_GEN1, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS,
                     min_len: int = 10) -> Column:
    """ARRAY<STRUCT<i, s, score, pos_score, neg_score, wc>> of one text."""
    sents = tx.long_sentence_array(col, min_len)
    kw = keyword_weights(themes, pos, neg)
    pw = {w: 1 for w in set(pos)}
    nw = {w: 1 for w in set(neg)}
    # split each sentence into tokens once, then score from the stored field
    # and keep those that any list has
    any_list = sorted({*kw, *pw, *nw})
    with_toks = F.transform(sents, lambda s, i: F.struct(
        i.alias("i"), s.alias("s"), F.filter(tx.tokens(s), lambda t: t.isin(any_list)).alias("t")))
    return F.transform(with_toks, lambda x: F.struct(
        x["i"].alias("i"), x["s"].alias("s"),
        weighted_hits(x["t"], kw).alias("score"),
        weighted_hits(x["t"], pw).alias("pos_score"),
        weighted_hits(x["t"], nw).alias("neg_score"),
        tx.word_count(x["s"]).alias("wc")))


def top_sentences(scored: Column, field: str, k: int) -> Column:
    """Texts of the k best sentences by ``field`` desc, stable on position."""
    ordered = F.array_sort(F.transform(
        scored, lambda x: F.struct((-x[field]).alias("k"), x["i"].alias("i"), x["s"].alias("s"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: x["s"])


def extractive_summary(scored: Column, max_words: int = 120) -> Column:
    """Greedy pick of the best keyword-scored sentences under a word cap.

    Sentences are visited by (score desc, position); a sentence is taken when
    it still fits (skip-and-continue).  Taken sentences are joined in text
    order.
    """
    ordered = F.array_sort(F.transform(
        scored, lambda x: F.struct((-x["score"]).alias("k"), x["i"].alias("i"),
                                   x["wc"].alias("wc"), x["s"].alias("s"))))
    init = F.struct(F.lit(0).alias("used"),
                    F.array().cast("array<struct<i:int,s:string>>").alias("picked"))
    folded = F.aggregate(ordered, init, lambda acc, x: F.when(
        acc["used"] + x["wc"] <= max_words,
        F.struct((acc["used"] + x["wc"]).alias("used"),
                 F.concat(acc["picked"], F.array(F.struct(x["i"].alias("i"), x["s"].alias("s"))))
                 .alias("picked"))).otherwise(acc))
    return F.array_join(F.transform(F.array_sort(folded["picked"]), lambda x: x["s"]), " ")


def corpus_theme_counts(df: DataFrame, key: str, text_col: str, themes=THEMES_GEN1) -> DataFrame:
    """Whole-text theme hits per (key, theme) over every row of ``df``.

    The hits of a text are counted in Arrow batches, one number a theme; the numbers are
    summed up before the shuffle, so hot keys stay cheap.
    """
    lists: list = []
    for _, words in themes:
        mult: dict = {}
        for w in words:         # a word that is listed twice counts twice
            mult[w] = mult.get(w, 0) + 1
        lists.append(mult)
    hits = df.select(F.col(key).alias("_key"), list_hits(lists)(tx.spaced_words(text_col)).alias("_n"))
    per = F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(i).alias("theme_idx"), F.col("_n")[i].alias("n"))
                    for i, (t, _) in enumerate(themes)])
    return (hits.select("_key", F.inline(per)).where(F.col("n") > 0)
            .groupBy(F.col("_key").alias(key), "theme", "theme_idx").agg(F.sum("n").alias("n")))

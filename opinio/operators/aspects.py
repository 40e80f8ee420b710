"""Aspect mining (stands in for model entity discovery) and text chunking."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.session import stored


#: Grams that a product's longer grams may be made of, as one array; a product with more of
#: them (ties) is counted whole.
MAX_FREQUENT = 512


def distinct_grams(sizes=(1, 2, 3, 4, 5)):
    """Function (tokens joined by spaces, grams allowed) -> the distinct n-grams of a text.

    With ``allowed`` (an array of grams of the smallest size) only n-grams count whose
    parts of that size are all in it; null allows every n-gram.
    """
    least = min(sizes)
    sets: dict = {}

    def of_text(text, allowed):
        words = text.split(" ") if text else []
        parts = words if least == 1 else [" ".join(words[i:i + least]) for i in range(len(words) - least + 1)]
        runs, start = [], None
        if allowed is None:
            runs = [(0, len(parts))]
        else:
            known = sets.get(allowed)
            if known is None:
                if len(sets) > 256:
                    sets.clear()
                known = sets[allowed] = frozenset(allowed)
            for i, p in enumerate(parts):
                if p in known:
                    start = i if start is None else start
                elif start is not None:
                    runs.append((start, i))
                    start = None
            if start is not None:
                runs.append((start, len(parts)))
        found = set()
        for i, j in runs:
            run = words[i:j + least - 1]
            for n in sizes:
                found.update(run if n == 1 else [" ".join(run[k:k + n]) for k in range(len(run) - n + 1)])
        return list(found)

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series, allowed: pd.Series) -> pd.Series:
        return pd.Series([of_text(t, None if a is None else tuple(a)) for t, a in zip(texts, allowed)], dtype=object)
    return grams


def drop_subsumed(counts: DataFrame, key: str = "product_id") -> DataFrame:
    """Of (key, aspect, review_count), the grams that no longer gram contains with the same count.

    The count of a gram is at least that of every gram that holds it, so it is enough to
    look at grams one word longer: each hands its count to the two grams that it is made
    of, and a gram that is handed its own count says nothing that the longer one does
    not.  One grouped pass (handed counts are combined before the shuffle), no self join.
    """
    a, n = F.col("aspect"), F.col("review_count")
    said = lambda gram, own, handed: F.struct(gram.alias("aspect"), own.alias("own"), handed.alias("handed"))
    none = F.lit(None).cast("long")
    first = said(F.regexp_replace(a, " [^ ]+$", ""), none, n)
    last = said(F.regexp_replace(a, "^[^ ]+ ", ""), none, n)
    told = F.when(F.contains(a, F.lit(" ")), F.array(said(a, n, none), first, last)).otherwise(F.array(said(a, n, none)))
    return (counts.select(key, F.inline(told)).groupBy(key, "aspect")
            .agg(F.max("own").alias("review_count"), F.max("handed").alias("handed"))
            .where(F.col("review_count").isNotNull() & (F.coalesce("handed", F.lit(0)) < F.col("review_count")))
            .drop("handed"))


def aspect_mining(reviews: DataFrame, key: str = "product_id", text_col: str = "text",
                  sizes=(1, 2, 3, 4, 5), top_k: int = 10, novel: bool = False) -> DataFrame:
    """Top n-grams per product by the number of distinct reviews using them.

    With ``novel`` a gram is left out if a longer mined gram holds it and occurs in as
    many reviews (``sizes`` must be consecutive): the more specific one stands for both.

    Each review contributes a distinct set (row-local) and counts are combined map-side.
    A gram occurs in no more reviews than any part of it, so grams of the smallest size
    are counted first and longer ones only where all their parts are as frequent as the
    last one that can be among the results (ties included): what is left out cannot
    be, and the grams of a text are not shuffled.  A product with more than
    ``MAX_FREQUENT`` such parts is counted whole.  Runs a job when called.
    """
    least = min(sizes)
    # a gram that is left out by ``novel`` says as much as a kept one, and a kept one
    # holds at most max - min + 1 parts: so many parts stand for one result
    need = top_k * (max(sizes) - least + 1 if novel else 1)
    tok = reviews.select(F.col(key), F.array_join(tx.tokens(text_col), " ").alias("_toks"))
    every = F.lit(None).cast("array<string>")

    def counted(texts, wanted, allowed):
        found = texts.select(F.col(key), F.explode(distinct_grams(wanted)("_toks", allowed)).alias("aspect"))
        return found.groupBy(key, "aspect").agg(F.count(F.lit(1)).alias("review_count"))

    by_count = Window.partitionBy(key).orderBy(F.col("review_count").desc())
    parts = (counted(tok, (least,), every).withColumn("_r", F.rank().over(by_count)).where(F.col("_r") <= need)
             .withColumn("_n", F.row_number().over(by_count)).where(F.col("_n") <= MAX_FREQUENT + 1))
    frequent = stored(parts.groupBy(F.col(key).alias("_of")).agg(F.collect_list("aspect").alias("_allowed")), "frequent-grams")
    few = F.size("_allowed") <= MAX_FREQUENT
    same = F.col(key).eqNullSafe(F.col("_of"))
    counts = (counted(tok.join(frequent.where(few), same), sizes, F.col("_allowed"))
              .unionByName(counted(tok.join(frequent.where(~few).select("_of"), same, "leftsemi"), sizes, every)))
    if novel:
        counts = drop_subsumed(counts, key)
    w = Window.partitionBy(key).orderBy(F.col("review_count").desc(), F.col("aspect"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k))


#: Texts of an Arrow batch that are packed at a time.
PACK_ROWS = 256


def packed_sentences(max_tokens: int):
    """Function text -> its chunks, for valid UTF-8; null and blank texts have none.

    The words of each sentence are counted once, and a chunk ends at the last sentence whose
    running count is within the budget: the work is linear in the text, long sentences too.
    """
    sentence_break = re.compile(r"(?<=[.!?])\s+")
    rows, chunk_type = PACK_ROWS, pa.list_(pa.string())

    def pack(text):
        sentences = [s for s in sentence_break.split((text or "").strip()) if s]
        ends = [0, *accumulate(len(s.split()) for s in sentences)]
        out, at = [], 0
        while at < len(sentences):
            stop = bisect_right(ends, ends[at] + max_tokens, at) - 1
            if stop > at:
                out.append(" ".join(sentences[at:stop]))
            else:
                words, stop = sentences[at].split(), at + 1
                out += [" ".join(words[i:i + max_tokens]) for i in range(0, len(words), max_tokens)]
            at = stop
        return out

    @F.arrow_udf("array<string>")
    def chunks(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(map(pack, texts.slice(i, rows).to_pylist()), chunk_type)
                                 for i in range(0, max(len(texts), 1), rows)])
    return chunks


def chunk_by_budget(text_col, max_tokens: int = 900) -> Column:
    """Pack sentences into chunks of at most ``max_tokens`` words; a chunk
    that is still too long (one long sentence) is hard-split every
    ``max_tokens`` words.  Token length is the whitespace word count."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return packed_sentences(max_tokens)(F.make_valid_utf8(text))

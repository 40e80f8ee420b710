"""User selection, ranking and greedy selection under a token budget.

``select_under_budget`` is exact and never gathers a whole product:

* Greedy order is (score desc, pos asc).  An item is taken when it still
  fits; otherwise it is skipped and the scan goes on.
* The remaining budget R only shrinks, so items with tokens > R can never be
  taken later and are pruned.
* Each round takes the next ``k`` candidates of every unfinished product
  (a window group limit, applied map-side before the shuffle), folds them
  in order, and carries R forward.  The first candidate of a round always
  fits, so every round makes progress; a product is finished when no
  candidate with tokens <= R is left.
* Round state is checkpointed to the shared checkpoint folder, so lineage
  stays short and a lost executor recomputes only the current round.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.session import materialize, stored


@dataclass(frozen=True)
class FilteringCriteria:
    use_verified: Optional[bool] = None
    use_useful: Optional[bool] = None
    token_limit: float = 4000
    tokens_per_char: float = 0.25
    helpful_boost: float = 0.5


def select_verified(df: DataFrame, flag: Optional[bool], col: str = "verified") -> DataFrame:
    """True keeps verified; False keeps not-verified including null; None: no-op."""
    if flag is None or col not in df.columns:
        return df
    v = F.coalesce(F.col(col), F.lit(False))
    return df.where(v if flag else ~v)


def select_useful(df: DataFrame, flag: Optional[bool], col: str = "helpful_votes") -> DataFrame:
    """True keeps votes > 0; False keeps votes <= 0 (null counts as 0)."""
    if flag is None:
        return df
    v = F.coalesce(F.col(col).cast("double"), F.lit(0.0)) if col in df.columns else F.lit(0.0)
    return df.where(v > 0 if flag else v <= 0)


def _fold(items, budget):
    """Greedy skip-and-continue over ordered items: what is left, and the places taken."""
    init = F.struct(budget.alias("rem"), F.array().cast("array<int>").alias("taken"))
    return F.aggregate(items, init, lambda acc, x: F.when(
        x["t"] <= acc["rem"],
        F.struct((acc["rem"] - x["t"]).alias("rem"),
                 F.concat(acc["taken"], F.array(x["rn"])).alias("taken"))).otherwise(acc))


def last_per_id(df: DataFrame, key: str, id_col: str, order_col: str) -> DataFrame:
    """One row per (key, id): the last in order.  Rows without an id all stay."""
    last = (df.where(F.col(id_col).isNotNull()).groupBy(F.col(key).alias("_lk"), F.col(id_col).alias("_li"))
            .agg(F.max(order_col).alias("_lo")))
    same = (F.col(key).eqNullSafe(F.col("_lk")) & (F.col(id_col) == F.col("_li"))
            & (F.col(order_col) == F.col("_lo")))
    return (df.where(F.col(id_col).isNotNull()).join(last, same, "leftsemi")
            .unionByName(df.where(F.col(id_col).isNull())))


def select_under_budget(df: DataFrame, key: str, score_col: str, order_col: str, tokens_col: str,
                        limit: float, k: int = 1000) -> DataFrame:
    """Rows of ``df`` chosen greedily by (score desc, order asc) under ``limit``.

    ``order_col`` (any orderable column, a struct too) names a row within its
    key; ids play no part.  Returns (key, order_col, picked_rank) of the chosen
    rows; the fallback for keys where nothing was chosen is up to the caller.
    Null keys are a key of their own.  Runs jobs when called.
    """
    limit = float(limit)
    cand = (df.select(F.col(key).alias("_k"), F.col(score_col).alias("_s"), F.col(order_col).alias("_o"),
                      F.col(tokens_col).cast("double").alias("_t"))
            .where((F.col("_t") > 0) & (F.col("_t") <= F.lit(limit)))
            .withColumn("_rem", F.lit(limit)))
    cand = materialize(cand)
    parts = []
    w = Window.partitionBy("_k").orderBy(F.col("_s").desc(), F.col("_o").asc())
    rnd = 0
    while True:
        top = cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
        items = F.array_sort(F.collect_list(F.struct(
            F.col("_rn").alias("rn"), F.col("_t").alias("t"), F.col("_o").alias("o"), F.col("_s").alias("s"))))
        state = (top.groupBy("_k").agg(F.first("_rem").alias("_rem0"), items.alias("_items"))
                 .select("_k", "_items", F.explode(F.array(_fold(F.col("_items"), F.col("_rem0")))).alias("f")))
        state = materialize(state.select(
            "_k", F.col("f.rem").alias("_rem1"), F.element_at("_items", -1).alias("_last"),
            F.transform("f.taken", lambda n: F.element_at("_items", n)["o"]).alias("_taken")))
        parts.append(state.select(F.col("_k").alias(key), "_taken", F.lit(rnd).alias("_round")))
        # what comes after the last one seen and still fits
        seen = state.select(F.col("_k").alias("_sk"), "_rem1", F.col("_last.s").alias("_ls"),
                            F.col("_last.o").alias("_lo"))
        later = (F.col("_s") < F.col("_ls")) | ((F.col("_s") == F.col("_ls")) & (F.col("_o") > F.col("_lo")))
        rest = (cand.join(seen, F.col("_k").eqNullSafe(F.col("_sk")))
                .where(later & (F.col("_t") <= F.col("_rem1")))
                .select("_k", "_s", "_o", "_t", F.col("_rem1").alias("_rem")))
        cand = materialize(rest)
        if cand.isEmpty():
            break
        rnd += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.select(key, "_round", F.posexplode("_taken").alias("_p", order_col))
            .select(key, order_col, (F.col("_round") * F.lit(k) + F.col("_p")).alias("picked_rank")))


def filter_reviews(reviews: DataFrame, sentences: Optional[DataFrame],
                   criteria: FilteringCriteria = FilteringCriteria(),
                   key: str = "product_id", id_col: str = "review_id", text_col: str = "text",
                   order_col: str = "pos", vec_col: str = "embedding",
                   dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """User selection -> budget check -> importance + boost -> greedy pick.

    Returns (selected reviews with ``score``/``tokens``, per-product stats).
    Of rows with equal ids the last counts; ``order_col`` names a row.  Products
    whose selected reviews fit the budget keep all of them and are never
    embedded or ranked.  Scores are computed on narrow rows and written once;
    texts are joined back to the chosen rows.  Runs jobs when called.
    """
    from opinio.operators.vectors import importance_and_boost

    from opinio.sources.jsonl import canonical_columns
    limit = float(criteria.token_limit)
    # lengths are taken before rows are compared, so that texts are moved only to be returned
    reviews = canonical_columns(reviews).withColumn("tokens", tx.estimate_tokens(text_col, criteria.tokens_per_char)) \
        .withColumn("_len", F.length(F.coalesce(F.col(text_col), F.lit(""))))
    base = last_per_id(reviews, key, id_col, order_col)
    work = select_useful(select_verified(base, criteria.use_verified), criteria.use_useful)
    narrow = work.select(key, id_col, order_col, "tokens", "_len",
                         *(["helpful_votes"] if "helpful_votes" in work.columns else []))
    # written, so that Spark knows how small they are: sentences and texts are not shuffled to join them
    totals = stored(work.groupBy(F.col(key).alias("_tk")).agg(F.sum("tokens").alias("_total")), "token-totals")
    work = work.drop("_len")
    of = F.col(key).eqNullSafe(F.col("_tk"))
    over_keys = totals.where(F.col("_total") > F.lit(limit)).select("_tk")
    over = narrow.join(over_keys, of, "leftsemi")
    if sentences is None:
        raise ValueError("sentence vectors are required to rank products over the budget")
    sent = sentences.join(over_keys, of, "leftsemi")
    scored = importance_and_boost(over, sent, key, id_col, vec_col, "helpful_votes", criteria.helpful_boost, dim)
    scored = materialize(scored.withColumn("score", F.round(F.col("importance") + F.col("boost"), 9))
                         .select(F.col(key).alias("_ck"), F.col(order_col).alias("_co"), "score", "tokens", "_len"))
    picks = select_under_budget(scored, "_ck", "score", "_co", "tokens", limit).select("_ck", "_co")
    # nothing fits: the shortest review (first on ties) if it fits
    none = scored.join(picks.select(F.col("_ck").alias("_pk")).distinct(), F.col("_ck").eqNullSafe(F.col("_pk")), "leftanti")
    shortest = (none.groupBy("_ck").agg(F.min(F.struct("_len", "_co", "tokens")).alias("_m"))
                .where(F.col("_m.tokens") <= F.lit(limit)).select("_ck", F.col("_m._co").alias("_co")))
    won = picks.unionByName(shortest).select(F.col("_ck").alias("_wk"), F.col("_co").alias("_wo"))
    won = stored(scored.join(won, F.col("_ck").eqNullSafe(F.col("_wk")) & (F.col("_co") == F.col("_wo")))
                 .select("_ck", "_co", "score"), "chosen-reviews")
    fits = work.join(totals.where(F.col("_total") <= F.lit(limit)).select("_tk"), of, "leftsemi")
    chosen = work.join(won, F.col(key).eqNullSafe(F.col("_ck")) & (F.col(order_col) == F.col("_co"))).drop("_ck", "_co")
    selected = fits.withColumn("score", F.lit(None).cast("double")).unionByName(chosen)
    kept = (totals.where(F.col("_total") <= F.lit(limit)).select(F.col("_tk").alias("_ck"))
            .join(narrow, F.col(key).eqNullSafe(F.col("_ck"))).select("_ck", "tokens")
            .unionByName(scored.join(won.select(F.col("_ck").alias("_wk"), F.col("_co").alias("_wo")),
                                     F.col("_ck").eqNullSafe(F.col("_wk")) & (F.col("_co") == F.col("_wo")), "leftsemi")
                         .select("_ck", "tokens")))
    return selected, selection_stats(base.drop("_len"), kept, over_keys, key, limit, criteria)


def selection_stats(base: DataFrame, kept: DataFrame, ranked_keys: DataFrame, key: str, limit: float,
                    criteria: FilteringCriteria) -> DataFrame:
    """Per-product counts, removals per filter, tokens, retention and ratings.

    One pass of conditional counts over ``base``; ``kept`` has (_ck, tokens) of
    the selected rows and ``ranked_keys`` (_tk) the products over the budget.
    Products emptied by selection keep a row with zero counts.
    """
    def passes(flag, yes):
        return F.lit(True) if flag is None else (yes if flag else ~yes)
    ver = (F.coalesce(F.col("verified"), F.lit(False)) if "verified" in base.columns else F.lit(True))
    use = (F.coalesce(F.col("helpful_votes").cast("double"), F.lit(0.0)) if "helpful_votes" in base.columns
           else F.lit(0.0)) > 0
    uv, uu = criteria.use_verified, criteria.use_useful
    ok_v = passes(uv if "verified" in base.columns else None, ver)
    s = base.groupBy(key).agg(
        F.count(F.lit(1)).alias("original_count"), F.count_if(ok_v).alias("_after_v"),
        F.count_if(ok_v & passes(uu, use)).alias("after_selection_count"))
    n = kept.groupBy("_ck").agg(F.count(F.lit(1)).alias("after_ranking_count"), F.sum("tokens").alias("token_usage"))
    s = (s.join(n, F.col(key).eqNullSafe(F.col("_ck")), "left")
         .join(ranked_keys.withColumn("_ranked", F.lit(True)), F.col(key).eqNullSafe(F.col("_tk")), "left")
         .fillna(0, ["after_ranking_count"]).fillna(0.0, ["token_usage"]))
    if "rating" in base.columns:    # few distinct ratings a product
        r = base.where(F.col("rating").isNotNull()).groupBy(F.col(key).alias("_rk"), "rating").agg(F.count(F.lit(1)).alias("c"))
        r = r.groupBy("_rk").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rating", "c")))).alias("rating_distribution"))
        s = s.join(r, F.col(key).eqNullSafe(F.col("_rk")), "left")
    else:
        s = s.withColumn("rating_distribution", F.lit(None).cast("map<double,bigint>"))
    rv = F.col("original_count") - F.col("_after_v")
    ru = F.col("_after_v") - F.col("after_selection_count")
    return s.select(
        key, "original_count", "after_selection_count", "after_ranking_count",
        F.col("token_usage").cast("double").alias("token_usage"),
        F.lit(float(limit)).alias("token_limit"),
        (rv if uv is True else F.lit(0)).cast("long").alias("verified_only"),
        (ru if uu is True else F.lit(0)).cast("long").alias("useful_only"),
        (rv if uv is False else F.lit(0)).cast("long").alias("exclude_verified"),
        (ru if uu is False else F.lit(0)).cast("long").alias("exclude_useful"),
        (F.col("after_ranking_count") / F.col("original_count")).alias("retention_rate"),
        F.coalesce("_ranked", F.lit(False)).alias("selection_applied"), "rating_distribution")

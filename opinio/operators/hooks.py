"""Pluggable model hooks and generator-response handling.

Models are never bundled.  Encoders and labellers are Column -> Column
functions built from a factory that loads the model once per Python worker
(iterator pandas_udf, Arrow batches).  Generators run per product on a
bounded prompt block through ``mapInPandas``.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: generator fallback text and prompt-block format.
MSG_NO_REVIEWS = "No reviews available to summarize."
PROMPT_LINE = "Review_id: %s: %s"
# ---------------------------------------------------------------------------


def encoder_udf(factory: Callable[[], Callable[[list], list]]):
    """Column hook for a sentence encoder: texts -> ARRAY<FLOAT>.

    ``factory()`` runs once per worker and returns ``encode(list[str]) ->
    list[list[float]]``; null text is encoded as "".
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in batches:
            yield pd.Series(list(encode(s.fillna("").astype(str).tolist())))
    return enc


def labeler_udf(factory: Callable[[], Callable[[list], list]]):
    """Column hook for a sentiment model: texts -> raw model labels (STRING).
    Map them with ``sentences.label_to_sentiment``."""
    @F.pandas_udf(T.StringType())
    def lab(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = factory()
        for s in batches:
            yield pd.Series(list(predict(s.fillna("").astype(str).tolist())))
    return lab


def prompt_block(selected: DataFrame, key: str = "product_id", id_col: str = "review_id",
                 text_col: str = "text", order_col: str = "picked_rank") -> DataFrame:
    """``Review_id: <id>: <text>`` blocks joined by blank lines in selection
    order -- bounded by the token budget of the selection."""
    line = F.format_string(PROMPT_LINE, F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), line.alias("l"))))
    return selected.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["l"]), "\n\n").alias("prompt"))


def summary_by_udf(prompts: DataFrame, generate: Callable[[str], str], key: str = "product_id") -> DataFrame:
    """Run ``generate(prompt)`` per product row; empty prompt -> fixed message;
    an exception becomes an ``error`` value instead of failing the job."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("summary", T.StringType()),
                           T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf["prompt"]):
                if p is None or not str(p).strip():
                    out.append((k, MSG_NO_REVIEWS, None))
                    continue
                try:
                    out.append((k, generate(str(p)), None))
                except Exception as e:  # noqa: BLE001 -- reported per row
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "summary", "error"])
    return prompts.select(F.col(key).cast("string").alias(key), "prompt").mapInPandas(run, schema)


def entity_names(col) -> Column:
    """Entities given as strings or ``{"entity": ...}`` objects (a JSON array
    text) -> ARRAY<STRING>; falsy names dropped, duplicates and order kept."""
    c = F.col(col) if isinstance(col, str) else col
    arr = F.from_json(c, T.ArrayType(T.StringType()))
    # an object gives its entity (none: dropped), a string itself
    names = F.transform(arr, lambda e: F.when(e.rlike(r"^\s*\{"), F.get_json_object(e, "$.entity")).otherwise(e))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


_RESPONSE = T.StructType([T.StructField("summary", T.StringType()),
                          T.StructField("entities", T.StringType())])


def parse_summary_response(col) -> Column:
    """Strict JSON; else the widest ``{..."summary"..."entities"...}`` span;
    else the whole text as the summary with no entities."""
    c = F.col(col) if isinstance(col, str) else col
    strict = F.from_json(c, _RESPONSE)
    span = F.regexp_extract(c, r'(?s)\{.*"summary".*"entities".*\}', 0)
    loose = F.from_json(F.nullif(span, F.lit("")), _RESPONSE)
    parsed = F.when(strict["summary"].isNotNull(), strict).otherwise(loose)
    ok = parsed["summary"].isNotNull()
    return F.struct(
        F.when(ok, parsed["summary"]).otherwise(c).alias("summary"),
        F.when(ok, F.coalesce(entity_names(parsed["entities"]), F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("entities"))

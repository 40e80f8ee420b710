"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.session import checkpoint_dir

#: Words as separated by ASCII white space, whole text.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage with a table that every executor can reach: a lost
    executor costs a re-read, not a recomputation.  Runs a job when called.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a written, small table, behind a count of its rows.

    Beyond ``max_rows`` the table is returned without a hint: Spark then
    shuffles both sides and splits skewed keys itself.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a row by content: repeated ids with other texts stay apart,
    and rows that agree in both share one key (and so one result)."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                             F.md5(text_or_empty(text_col))))

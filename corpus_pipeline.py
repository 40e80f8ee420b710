"""Training-corpus pipeline: toxicity, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm.common import table
from opinio.llm.mixing import mix_documents
from opinio.llm.ngram_join import keep_one_of_each_group
from opinio.llm.pieces import encode_documents, load_pieces
from opinio.llm.pii import replace_personal_data
from opinio.llm.toxicity import FLAG, fit_toxicity, score_toxicity
from opinio.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the toxicity threshold.

    The model learns from ``labels``; without toxic ones every row stays.  Null and
    empty texts have no evidence and stay; repeated rows go or stay together; very
    long texts are judged whole; an empty table stays empty; all columns are kept.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = score_toxicity(docs.select(columns.alias("row"), "text"), model)
    return scored.where(F.col("toxic_score") < FLAG).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id.

    Rows without a word (null and empty texts too) have no near duplicates and all
    stay; rows that agree in id and text leave one; null and repeated ids do not join
    different texts; an empty table stays empty; all columns are kept.
    """
    return keep_one_of_each_group(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates instead of personal data and secrets.

    Every row stays; null texts stay null; an entity gets one surrogate wherever it
    stands; other columns are carried untouched; an empty table stays empty.
    """
    return replace_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows left out, kept or repeated (three times at most) as the source
    weights ask.

    A null source is a source of its own; null and empty texts have size 0 and come
    with each full pass; rows equal in id and text are taken alike; an empty table
    gives an empty mix; all columns are kept.
    """
    return mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row of the mix, with its id, language and source.

    Null and empty texts have no ids; repeated rows are encoded alike; columns other
    than these four are left out; an empty table gives an empty result.
    """
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), load_pieces())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii_surrogates", replace_pii),
    ("source_mixing", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: Trained models, hashed bands and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Stored tables that are replaced as a whole, in one step.

A version is written to a folder of its own and becomes the current one when a row
that names it has been added to the table ``versions``: one file, which appears
complete or not at all.  A job that is lost while it writes leaves the current version
as it was, and a reader keeps the version it has opened.  Everything goes through
Spark's readers and writers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_VERSION = T.StructType([T.StructField("seq", T.LongType()), T.StructField("folder", T.StringType())])


def _latest(spark: SparkSession, path: str):
    try:
        versions = spark.read.schema(_VERSION).parquet(f"{path}/versions")
    except Exception as e:  # noqa: BLE001 -- only a missing path means that nothing is published
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return versions.selectExpr("max(struct(seq, folder)) AS last").first()["last"]


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as the new current version of ``path`` and return it as stored.

    ``df`` may read the version that it replaces.  With two writers at a time the
    larger (number, folder) wins, and each reads back its own version.
    """
    spark = df.sparkSession
    last = _latest(spark, path)
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{folder}")
    spark.createDataFrame([(0 if last is None else last["seq"] + 1, folder)], _VERSION).coalesce(1) \
        .write.mode("append").parquet(f"{path}/versions")
    return spark.read.schema(df.schema).parquet(f"{path}/data/{folder}")


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of ``path``; None before the first."""
    last = _latest(spark, path)
    return None if last is None else spark.read.parquet(f"{path}/data/{last['folder']}")

"""Writers and readers of derived tables.

Per-product outputs are partitioned by product and written with dynamic
partition overwrite, so a refresh replaces only the products it recomputed
and a retried task rewrites the same partitions (idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.schemas import PRODUCT_FACTS, SUMMARY_ROW


def write_partitioned(df: DataFrame, path: str, key: str = "product_id", fmt: str = "parquet") -> None:
    # the rows of a product go to a few tasks only, so it gets a few files, and a hot one is no single task
    salt = F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]), F.lit(8))
    (df.repartition(F.col(key), salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).format(fmt).save(path))


def write_sentence_index(sentences: DataFrame, path: str) -> None:
    """Sentences with their ``embedding ARRAY<FLOAT>`` in one Parquet table."""
    write_partitioned(sentences, path, "product_id", "parquet")


def read_partitioned(spark: SparkSession, path: str, key: str = "product_id") -> DataFrame:
    """A table of ``write_partitioned``; keys stay text ("007" is no number)."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name == key else f.dataType)
                                           for f in found.fields])).parquet(path)


def read_sentence_index(spark: SparkSession, path: str) -> DataFrame:
    return read_partitioned(spark, path)


def write_product_facts(facts: DataFrame, path: str, fmt: str = "json") -> None:
    write_partitioned(facts, path, "product_id", fmt)


def read_product_facts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested facts with defaults: features -> [], summary text -> '', total -> 0."""
    df = spark.read.schema(PRODUCT_FACTS).format(fmt).load(path)
    empty = F.array().cast(PRODUCT_FACTS["features"].dataType)
    return df.select("product_id",
                     F.coalesce("total_reviews", F.lit(0).cast("long")).alias("total_reviews"),
                     F.struct(F.coalesce(F.col("summary.text"), F.lit("")).alias("text")).alias("summary"),
                     F.coalesce("features", empty).alias("features"))


def write_summary_csv(rows: DataFrame, path: str) -> None:
    """11-column UTF-8 CSV with a header (no byte-order mark)."""
    rows.select(*[f.name for f in SUMMARY_ROW.fields]).write.mode("overwrite") \
        .option("header", True).csv(path)


def read_checkpoint_csv(spark: SparkSession, path: str) -> DataFrame:
    """Prior summary rows, or an empty frame with the fixed columns."""
    try:
        return spark.read.schema(SUMMARY_ROW).option("header", True).csv(path)
    except Exception as e:  # noqa: BLE001 -- only a missing path means "no checkpoint"
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], SUMMARY_ROW)
        raise


def run_report(summary: DataFrame, stats: DataFrame, facts: DataFrame, config: dict,
               key: str = "product_id") -> DataFrame:
    """One JSON document per product: summary + filter stats + facts + config (nulls kept)."""
    cfg = F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())])
    j = (summary.join(stats, key, "left").join(facts, key, "left"))
    cols = [c for c in j.columns if c != key]
    return j.select(key, F.to_json(F.struct(F.col(key), *[F.col(c) for c in cols],
                                            cfg.alias("config")),
                                     {"ignoreNullFields": "false"}).alias("report"))

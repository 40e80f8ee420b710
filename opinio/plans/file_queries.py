"""Queries over files that are written from the documents and read back by the sources.

The stand-in only writes files: JSON lines, JSON arrays and product documents, dealt
by the first digit of the source's md5.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.plans.catalog import register
from opinio.session import checkpoint_dir
from opinio.sources import jsonl, products, shapes
from opinio.sources.tables import table

#: Documents of one source in one array or product file.
FILE_ROWS = 200


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _one_a_file(values: DataFrame, path: str) -> None:
    """``value`` of each row as a file of its own."""
    # tasks put their files in place themselves (the folder is new and read when all are done):
    # moved by the driver one after the other, they would take longer than they took to write
    values.select("value").write.option("maxRecordsPerFile", 1) \
        .option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


def _groups(d: DataFrame) -> DataFrame:
    return d.withColumn("key", F.md5(F.concat_ws("/", "source", F.floor(F.col("doc_id") / FILE_ROWS).cast("string"))))


def _product_files(d: DataFrame, path: str) -> None:
    """Product documents: the source's reviews under its name, pretty-printed."""
    review = F.struct(F.lit("t").alias("title"), "text", (1 + F.col("doc_id") % 5).cast("double").alias("rating"),
                      (F.length("text") % 2 == 0).alias("verified"), F.lit("a").alias("author"),
                      (F.col("doc_id") % 13).alias("helpful_votes"), F.lit(20240131).alias("publication_date"))
    reviews = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", review.alias("r")))), lambda x: x["r"])
    meta = F.struct(F.struct(F.first("source").alias("ISBN-10")).alias("specifications"))
    doc = F.struct(F.array().cast("array<string>").alias("website_summaries"), reviews.alias("customer_reviews"),
                   meta.alias("product_meta"))
    _one_a_file(_groups(d).groupBy("key").agg(F.to_json(doc, {"pretty": "true"}).alias("value")), path)


_DEALT = "d AS (SELECT *, substr(md5(source), 1, 1) AS x FROM documents)"


@register("adapt_mixed_shapes", f"""WITH {_DEALT}
SELECT CASE WHEN x < '5' THEN 'review' WHEN x < 'a' THEN 'array' ELSE 'product' END AS shape, source AS parent_asin,
    md5(coalesce(text, '')) AS text_md5, CASE WHEN x < '5' THEN 1.5 WHEN x < 'a' THEN NULL ELSE 1 + doc_id % 5 END::DOUBLE AS rating,
    CASE WHEN x < 'a' THEN doc_id % 2 = 0 ELSE coalesce(length(text) % 2 = 0, false) END AS verified_purchase,
    CASE WHEN x < '5' THEN 0 WHEN x < 'a' THEN doc_id % 9 ELSE doc_id % 13 END::DOUBLE AS helpful_vote FROM d""")
def q_adapt_mixed_shapes(spark, sf):
    """All documents from one folder of three shapes, without being told which file has which."""
    path = _folder(spark, "mixed")
    d = table(spark, sf, "documents").withColumn("x", F.substring(F.md5("source"), 1, 1))
    d.where(F.col("x") < "5").select(F.to_json(F.struct(
        F.col("source").alias("parent_asin"), F.col("text").alias("review_text"), F.lit("1.5").alias("stars"),
        (F.col("doc_id") % 2 == 0).alias("verified")))).write.text(f"{path}/lines")
    row = F.struct("doc_id", F.struct(F.col("source").alias("parent_asin"), "text", F.lit("none").alias("rating"),
                                      (F.col("doc_id") % 2 == 0).cast("string").alias("verified_purchase"),
                                      (F.col("doc_id") % 9).cast("string").alias("helpful_votes")).alias("r"))
    arrays = _groups(d.where((F.col("x") >= "5") & (F.col("x") < "a"))).groupBy("key").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]), {"pretty": "true"}).alias("value"))
    _one_a_file(arrays, f"{path}/arrays")
    _product_files(d.where(F.col("x") >= "a"), f"{path}/products")
    rows, _ = shapes.detect_review_shapes(spark, path)
    return rows.select("shape", "parent_asin", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "rating",
                       "verified_purchase", "helpful_vote")


@register("scan_review_jsonl", """
SELECT coalesce(source, '') AS parent_asin, md5(coalesce(text, '')) AS text_md5, CAST(doc_id % 5 AS VARCHAR) AS rating,
    doc_id % 11 = 0 AS broken FROM documents""")
def q_scan_review_jsonl(spark, sf):
    """JSON-lines files read back: rows and, where the line was cut off, what quarantine kept of it."""
    path = _folder(spark, "jsonl")
    line = F.to_json(F.struct(F.coalesce("source", F.lit("")).alias("parent_asin"), F.md5(F.coalesce("text", F.lit(""))).alias("title"),
                              F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 5).cast("string").alias("stars")))
    cut = F.when(F.col("doc_id") % 11 == 0, F.regexp_replace(line, r"\}$", "")).otherwise(line)
    table(spark, sf, "documents").select(cut.alias("value")).write.text(path)
    good, bad = jsonl.scan_review_jsonl(spark, path)
    field = lambda name: F.regexp_extract("value", rf'"{name}":"([^"]*)"', 1)
    return good.select("parent_asin", F.md5("text").alias("text_md5"), "rating", F.lit(False).alias("broken")).unionByName(
        bad.select(field("parent_asin").alias("parent_asin"), field("title").alias("text_md5"), field("stars").alias("rating"),
                   F.lit(True).alias("broken")))


@register("reviews_table_files", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id // {FILE_ROWS} ORDER BY doc_id) - 1
    AS pos FROM documents WHERE source IS NOT NULL)
SELECT source AS product_id, CAST(pos AS INTEGER) AS pos, printf('r%03d', pos) AS review_id, md5(coalesce(text, '')) AS text_md5,
    CAST(1 + doc_id % 5 AS DOUBLE) AS rating, CAST(doc_id % 13 AS INTEGER) AS helpful_votes, '2024-01-31' AS publication_day FROM r""")
def q_reviews_table_files(spark, sf):
    """Product files of the documents, scanned and flattened by the sources."""
    path = _folder(spark, "products")
    _product_files(table(spark, sf, "documents").where(F.col("source").isNotNull()), path)
    files = spark.read.schema(products.PRODUCT).option("multiLine", True).option("recursiveFileLookup", True).json(path) \
        .withColumn("file_name", F.col("_metadata.file_name"))
    return products.reviews_table(files).select(
        "product_id", "pos", "review_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "rating", "helpful_votes",
        F.col("publication_day").cast("string").alias("publication_day"))

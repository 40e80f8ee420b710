"""Product documents (one pretty-printed JSON file per product)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.schemas import PRODUCT

# ---------------------------------------------------------------------------
# FIXED VALUES: validation keys and messages as in the reference.
REQUIRED_KEYS = ["website_summaries", "customer_reviews", "product_meta"]
REQUIRED_REVIEW_FIELDS = ["title", "text", "rating", "verified", "helpful_votes"]
# product id sources, in order: meta ids, then specification keys, then file stem
META_ID_FIELDS = ["asin", "isbn", "id", "sku"]
SPEC_ID_KEYS = ["ASIN", "asin", "ISBN-10", "ISBN-13"]
# ---------------------------------------------------------------------------


def _require_files(df: DataFrame, path: str) -> DataFrame:
    if not df.inputFiles():
        raise FileNotFoundError(f"No JSON files found in {path}")
    return df


def scan_products(spark: SparkSession, path: str) -> DataFrame:
    """Read product documents (a file or a directory of ``*.json``).

    Adds ``file_name`` from the file metadata.  Raises when nothing matches.
    """
    df = (spark.read.schema(PRODUCT).option("multiLine", True)
          .option("pathGlobFilter", "*.json").json(path)
          .withColumn("file_name", F.col("_metadata.file_name")))
    return _require_files(df, path)


def file_stem(col="file_name"):
    return F.regexp_extract(F.col(col), r"([^/]*?)(\.[^./]*)?$", 1)


def product_id(meta="product_meta", file_col="file_name"):
    """First non-empty meta id, then specification id keys, then the file stem."""
    m = F.col(meta)
    cands = [F.nullif(m[f], F.lit("")) for f in META_ID_FIELDS]
    cands += [F.nullif(F.element_at(m["specifications"], F.lit(k)), F.lit("")) for k in SPEC_ID_KEYS]
    cands.append(file_stem(file_col))
    return F.coalesce(*cands)


def reviews_table(products: DataFrame) -> DataFrame:
    """Flatten reviews: one row per review with ``pos`` (0-based array offset)
    and ``review_id`` (given, else ``r%03d`` of the position)."""
    p = products.select(product_id().alias("product_id"),
                        F.posexplode("customer_reviews").alias("pos", "r"))
    return p.select("product_id", "pos",
                    F.coalesce(F.col("r.review_id"), F.format_string("r%03d", F.col("pos"))).alias("review_id"),
                    "r.title", "r.text", "r.rating", "r.verified", "r.author", "r.helpful_votes",
                    "r.publication_date",
                    F.to_date(F.col("r.publication_date").cast("string"), "yyyyMMdd").alias("publication_day"))


def website_verdict(products: DataFrame) -> DataFrame:
    """First website summary's verdict (null when there is none), pros, cons."""
    first = F.try_element_at(F.col("website_summaries"), F.lit(1))
    return products.select(product_id().alias("product_id"), first["verdict"].alias("verdict"),
                           first["pros"].alias("pros"), first["cons"].alias("cons"))


def validate_products(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (file_name, is_valid, reason).

    Key presence needs the raw text, so files are read whole; only the first
    review's fields are checked and an empty review list is valid.
    """
    raw = (spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
           .withColumn("file_name", F.col("_metadata.file_name")))
    _require_files(raw, path)
    keys = F.json_object_keys(F.col("value"))
    reviews = F.get_json_object(F.col("value"), "$.customer_reviews")
    first_keys = F.json_object_keys(F.get_json_object(F.col("value"), "$.customer_reviews[0]"))
    reason = F.lit(None).cast("string")
    checks = [(~F.coalesce(F.array_contains(keys, k), F.lit(False)), f"Missing required key: {k}")
              for k in REQUIRED_KEYS]
    checks.append((~F.coalesce(F.ltrim(reviews).startswith("["), F.lit(False)),
                   "customer_reviews must be a list"))
    checks += [(first_keys.isNotNull() & ~F.array_contains(first_keys, f),
                f"Missing required field in reviews: {f}") for f in REQUIRED_REVIEW_FIELDS]
    expr = None
    for cond, msg in checks:
        expr = F.when(cond, F.lit(msg)) if expr is None else expr.when(cond, F.lit(msg))
    reason = expr.otherwise(reason)
    return raw.select("file_name", reason.isNull().alias("is_valid"), reason.alias("reason"))

"""Corpus review feeds: JSON lines, JSON arrays and product documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.functions.text import strip
from opinio.schemas import CORPUS_REVIEW, PRODUCT


# ---------------------------------------------------------------------------
# FIXED VALUES: spellings of each review field, first match wins (case-insensitive).
ALIASES = {"review_id": ["review_id", "id"],
           "text": ["text", "review_text", "content"],
           "rating": ["rating", "rating_value", "stars"],
           "verified": ["verified", "verified_purchase"],
           "helpful_votes": ["helpful_votes", "helpful_vote", "helpful", "useful_votes"]}
# ---------------------------------------------------------------------------


#: Every field is read as text: a value of another type must not cost the line.
_NAMES = sorted({f.name for f in CORPUS_REVIEW.fields} | {a for names in ALIASES.values() for a in names})
_FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in [*_NAMES, "_corrupt"]])


def parse_review_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """A table of JSON lines -> (rows, quarantined lines); other columns are kept.

    A line is quarantined only if it is no JSON object; every other non-blank
    line gives a row, whatever columns are selected later.  Values stay text
    (``canonicalize_corpus`` casts them, bad ones to null).
    """
    others = [c for c in lines.columns if c != value]
    full = lines.where(strip(value) != "").withColumn("_r", F.from_json(
        F.col(value), _FIELDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | ~F.ltrim(F.col(value)).startswith("{")
    more = {"text": ["review_text", "content"], "rating": ["rating_value", "stars"],
            "helpful_votes": ["helpful", "useful_votes"]}
    good = full.where(~broken).select(*others, *[
        F.coalesce(*[F.col(f"_r.{n}") for n in [f.name, *more.get(f.name, [])]]).alias(f.name)
        for f in CORPUS_REVIEW.fields])
    return good, full.where(broken).select(*others, value)


def scan_review_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per line -> (rows, quarantined lines).

    Rows get ``pos``, their order within the read (file, then place in the
    file's split), as ``clean_corpus`` needs it.
    """
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_name")).withColumn(
        "pos", F.monotonically_increasing_id())
    return parse_review_lines(lines)


def resolve_columns(df: DataFrame, candidates: dict) -> dict:
    """Canonical name -> actual column, case-insensitive, first alias wins."""
    lower = {c.lower(): c for c in df.columns}
    out = {}
    for canon, opts in candidates.items():
        for o in opts:
            if o.lower() in lower:
                out[canon] = lower[o.lower()]
                break
    return out


def canonical_columns(df: DataFrame) -> DataFrame:
    """``df`` with the columns of a review renamed to their canonical names."""
    for canon, actual in resolve_columns(df, ALIASES).items():
        if actual != canon and canon not in df.columns:
            df = df.withColumnRenamed(actual, canon)
    return df


def adapt_review_shapes(spark: SparkSession, path: str, shape: str | None = None) -> DataFrame:
    """Read ``jsonl`` | ``array`` | ``product`` files into the corpus shape, with ``pos``.

    Without ``shape`` the files may be of any of the three, which is found out value by
    value (``detect_review_shapes``, which also returns the quarantine); ``pos`` is then
    a struct.

    Missing ``parent_asin``: a product file gives ISBN-10, ISBN-13, title, then
    the file stem; the others the file stem.  Broken lines are left out (they
    are in the quarantine of ``scan_review_jsonl``); bad numbers read as null and
    missing verified as false.  Schemas are fixed: no inference pass.
    """
    if shape is None:
        from opinio.sources.shapes import detect_review_shapes
        return detect_review_shapes(spark, path)[0].drop("shape", "file")
    from opinio.operators.cleaning import canonicalize_corpus
    stem = F.regexp_extract(F.col("_file"), r"([^/]*?)(\.[^./]*)?$", 1)
    if shape == "jsonl":
        df = scan_review_jsonl(spark, path)[0].withColumn("_asin", stem)
    elif shape == "array":
        whole = spark.read.text(path, wholetext=True).withColumn("_file", F.col("_metadata.file_name"))
        items = F.from_json("value", T.ArrayType(T.StringType()))
        df = whole.select("_file", F.posexplode(items).alias("pos", "value"))
        df = parse_review_lines(df)[0].withColumn("_asin", stem)
    elif shape == "product":
        p = (spark.read.schema(PRODUCT).option("multiLine", True).json(path)
             .withColumn("_file", F.col("_metadata.file_name")))
        spec = F.col("product_meta.specifications")
        own = F.coalesce(*[F.nullif(strip(x), F.lit("")) for x in (
            F.element_at(spec, F.lit("ISBN-10")), F.element_at(spec, F.lit("ISBN-13")), F.col("product_meta.title"))], stem)
        df = p.select("_file", own.alias("_asin"), F.posexplode("customer_reviews").alias("pos", "r"))
        df = df.select("_file", "_asin", "pos", "r.*").withColumn("parent_asin", F.lit(None).cast("string"))
    else:
        raise ValueError(f"unknown shape {shape!r}")
    c = canonicalize_corpus(df)
    return c.select(F.coalesce(F.nullif(F.col("parent_asin"), F.lit("")), F.col("_asin")).alias("parent_asin"), "title",
                    "text", "rating", F.col("verified").alias("verified_purchase"), "helpful_vote",
                    F.col("pos").cast("long").alias("pos"))

"""Review files of unknown shape: every JSON value is routed by what it is.

A folder may mix JSON lines, JSON arrays and product documents, pretty-printed or not.
It is read once, as lines.  A file whose first line is a JSON value of its own holds a
value a line; another one (pretty-printed) is a single value, and only the lines of such
files are put together again.  Values are parsed to VARIANT and routed by their schema:

* an object with ``customer_reviews`` is a product document: its reviews,
* an array: its objects,
* any other object: a review.

What is none of these (a broken line, a bare number, an object alone in a file over
several lines without reviews, an array item that is no object) goes to the quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.functions.text import strip
from opinio.schemas import CORPUS_REVIEW
from opinio.sources.jsonl import ALIASES


def _text(value: Column, *names: str) -> Column:
    """The first of the fields that is there, as text; bad paths and nulls give null."""
    found = [F.try_variant_get(value, f"$['{n}']", "string") for n in names]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def shape_of(value: Column, own: Column) -> Column:
    """``product``, ``array``, ``review`` (on a line of its own), or null for what is none of them."""
    kind = F.schema_of_variant(value)
    reviews = F.schema_of_variant(F.try_variant_get(value, "$.customer_reviews", "variant"))
    return (F.when(kind.startswith("OBJECT") & reviews.startswith("ARRAY"), "product")
            .when(kind.startswith("OBJECT") & own, "review").when(kind.startswith("ARRAY"), "array"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value, json, own): the JSON values of all files below ``path``; ``at`` orders
    the values of a file, ``json`` is null where the value does not parse, ``own`` tells
    whether the value stands on a line of its own."""
    lines = (spark.read.option("recursiveFileLookup", True).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.struct(
                 F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
                 F.col("value"))
             .where(strip("value") != "").withColumn("json", F.try_parse_json("value")))
    complex_ = F.coalesce(F.schema_of_variant("json").rlike("^(OBJECT|ARRAY)"), F.lit(False))
    first = lines.groupBy("file").agg(F.min(F.struct("at", complex_.alias("own")))["own"].alias("own"))
    told = lines.join(first, "file")
    apart = told.where(~F.col("own"))
    whole = apart.groupBy("file").agg(F.min("at").alias("at"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return told.where("own").unionByName(whole.withColumns({"json": F.try_parse_json("value"), "own": F.lit(False)}))


def detect_review_shapes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of any shape -> (rows in the corpus shape, quarantined (file, value)).

    Rows have ``shape``, ``file`` and ``pos`` (file, place of the value, place of the
    review in it), which orders them.  Missing ``parent_asin``: a product gives ISBN-10,
    ISBN-13, title, then the file stem; the others the file stem.  Values stay text until
    ``canonicalize_corpus`` casts them (bad numbers to null, missing verified to false).
    """
    from opinio.operators.cleaning import canonicalize_corpus
    values = read_values(spark, path).withColumn("shape", shape_of(F.col("json"), F.col("own")))
    items = (F.when(F.col("shape") == "product", F.try_variant_get("json", "$.customer_reviews", "array<variant>"))
             .when(F.col("shape") == "array", F.try_variant_get("json", "$", "array<variant>"))
             .when(F.col("shape") == "review", F.array("json")))
    spec = "$.product_meta.specifications"
    own = F.coalesce(*[F.nullif(strip(F.try_variant_get("json", p, "string")), F.lit("")) for p in (
        f"{spec}['ISBN-10']", f"{spec}['ISBN-13']", "$.product_meta.title")])
    each = values.select("file", "at", "shape", F.when(F.col("shape") == "product", own).alias("own"),
                         F.posexplode(items).alias("item", "r"))
    fits = F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False))
    fields = {f.name: [f.name, *[a for a in ALIASES.get(f.name, []) if a not in CORPUS_REVIEW.names and a != f.name]]
              for f in CORPUS_REVIEW.fields}
    rows = canonicalize_corpus(each.where(fits).select(
        "file", "shape", F.struct("file", "at", "item").alias("pos"), "own",
        *[_text(F.col("r"), *names).alias(n) for n, names in fields.items()]))
    stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    rows = rows.select(
        F.coalesce(F.nullif("parent_asin", F.lit("")), "own", stem).alias("parent_asin"), "title", "text", "rating",
        F.col("verified").alias("verified_purchase"), "helpful_vote", "shape", "file", "pos")
    bad = values.where(F.col("shape").isNull()).select("file", "value").unionByName(
        each.where(~fits).select("file", F.to_json("r").alias("value")))
    return rows, bad

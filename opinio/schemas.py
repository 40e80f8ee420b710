"""Explicit StructTypes at every boundary (no schema inference)."""

from pyspark.sql import types as T

WEBSITE_SUMMARY = T.StructType([
    T.StructField("verdict", T.StringType()),
    T.StructField("pros", T.ArrayType(T.StringType())),
    T.StructField("cons", T.ArrayType(T.StringType())),
    T.StructField("aspects", T.MapType(T.StringType(), T.StringType())),
    T.StructField("publication_date", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("source", T.StringType()),
])

CUSTOMER_REVIEW = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("author", T.StringType()),
    T.StructField("helpful_votes", T.IntegerType()),
    T.StructField("publication_date", T.IntegerType()),
])

PRODUCT_META = T.StructType([
    T.StructField("asin", T.StringType()),
    T.StructField("isbn", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("specifications", T.MapType(T.StringType(), T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("price", T.StringType()),
])

PRODUCT = T.StructType([
    T.StructField("website_summaries", T.ArrayType(WEBSITE_SUMMARY)),
    T.StructField("customer_reviews", T.ArrayType(CUSTOMER_REVIEW)),
    T.StructField("product_meta", PRODUCT_META),
])

# Corpus review (one JSON object per line).  Both spellings of the
# verified / helpful fields are declared; ``adapt`` picks one at plan time.
CORPUS_REVIEW = T.StructType([
    T.StructField("parent_asin", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("helpful_vote", T.StringType()),
    T.StructField("helpful_votes", T.StringType()),
])

FEATURE_FACT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("positive_count", T.LongType()),
    T.StructField("negative_count", T.LongType()),
    T.StructField("neutral_count", T.LongType()),
    T.StructField("evidence_sentences", T.ArrayType(T.StringType())),
])

PRODUCT_FACTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("total_reviews", T.LongType()),
    T.StructField("summary", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("features", T.ArrayType(FEATURE_FACT)),
])

SUMMARY_ROW = T.StructType([
    T.StructField("parent_asin", T.StringType()),
    T.StructField("avg_rating", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("credibility_score", T.DoubleType()),
    T.StructField("themes_counts", T.StringType()),
    T.StructField("themes_pct", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("pos_snippets", T.StringType()),
    T.StructField("neg_snippets", T.StringType()),
    T.StructField("formatted_summary", T.StringType()),
])
SUMMARY_COLUMNS = [f.name for f in SUMMARY_ROW.fields]

"""Queries over an index of the reviews that was built before some of them changed.

The stand-in for "before" and "now" are two versions of the reviews: by the first
digit of the product's md5, products have a third of their reviews edited (0-4), are as
they were (5-9), have lost a tenth of their reviews (a, b), are gone (c) or new (d-f).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.operators import index_state as ix
from opinio.plans import views as V
from opinio.plans.catalog import register
from opinio.session import checkpoint_dir
from opinio.sources import tables as tb

_NOW = f"""{V.REVIEWS},
dealt AS (SELECT *, substr(md5(product_id), 1, 1) AS x FROM reviews),
before AS (SELECT product_id, review_id, text FROM dealt WHERE x < 'd'),
now AS (SELECT product_id, review_id, pos, CASE WHEN x < '5' AND length(text) % 3 = 0 THEN text || ' Edited.' ELSE text END AS text
        FROM dealt WHERE x <> 'c' AND NOT (x IN ('a', 'b') AND coalesce(length(text), 0) % 10 = 0))"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = tb.reviews(spark, sf).select("product_id", "review_id", "pos", "text")
    x = F.substring(F.md5("product_id"), 1, 1)
    edited = F.when((x < "5") & (F.length("text") % 3 == 0), F.concat("text", F.lit(" Edited."))).otherwise(F.col("text"))
    now = r.where((x != "c") & ~(x.isin("a", "b") & (F.coalesce(F.length("text"), F.lit(0)) % 10 == 0))).withColumn("text", edited)
    return r.where(x < "d"), now


@register("index_staleness_content", f"""WITH {_NOW},
held(v, product_id, review_id, text) AS (SELECT 0, * FROM before UNION ALL SELECT 1, product_id, review_id, text FROM now),
s AS (SELECT product_id, count(*) FILTER (v = 0) AS cached_reviews, count(*) FILTER (v = 1) AS current_reviews,
        string_agg(md5(review_id || ':' || text), ',' ORDER BY review_id, text) FILTER (v = 0) AS was,
        string_agg(md5(review_id || ':' || text), ',' ORDER BY review_id, text) FILTER (v = 1) AS now
      FROM held WHERE coalesce(review_id, '') <> '' AND coalesce(text, '') <> '' GROUP BY product_id)
SELECT product_id, cached_reviews, current_reviews, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone'
    WHEN cached_reviews <> current_reviews THEN 'count' WHEN was <> now THEN 'content' END AS reason FROM s""")
def q_index_staleness_content(spark, sf):
    before, now = _versions(spark, sf)
    return ix.stale_products(ix.content_digest(before), ix.content_digest(now))


@register("sentence_index_refresh", f"""WITH {_NOW}, sr AS ({V.sentence_rows("now")}),
held(product_id, review_id, text) AS (SELECT * FROM before WHERE coalesce(text, '') <> ''),
holds AS (SELECT product_id, review_id, text FROM now WHERE coalesce(text, '') <> ''),
changed AS (SELECT product_id FROM (SELECT * FROM held EXCEPT ALL SELECT * FROM holds)
    UNION SELECT product_id FROM (SELECT * FROM holds EXCEPT ALL SELECT * FROM held))
SELECT product_id, review_id, sentence_id, text, product_id IN (SELECT product_id FROM changed) AS rebuilt FROM sr""")
def q_sentence_index_refresh(spark, sf):
    """The stored index after a run for the old and one for the new reviews, and which
    products the second run rebuilt.  Runs jobs when called."""
    before, now = _versions(spark, sf)
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    ix.refresh_sentence_index(before, path)
    done = ix.refresh_sentence_index(now, path).select("product_id", F.col("reason").isNotNull().alias("rebuilt"))
    return ix.stored_sentence_index(spark, path).join(done, "product_id").select(
        "product_id", "review_id", "sentence_id", "text", "rebuilt")

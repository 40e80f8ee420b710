import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from opinio.operators import index_state as ix
from opinio.operators.sentences import sentence_index
from opinio.sources.published import publish, published

REVIEWS = "product_id string, review_id string, text string"
FIRST = [("a", "1", "One. Two!"), ("a", "2", "Three."), ("b", "3", "Four? Five."), ("c", "4", "Six."), ("d", "5", "Seven."),
         ("e", "6", "Same."), ("e", "7", "Other."), ("007", "70", "Bond.")]


@pytest.fixture()
def path():
    return tempfile.mkdtemp(prefix="opinio-index-")


def files(path):
    return {p: sorted(os.path.basename(f) for f in glob.glob(f"{path}/sentences/product_id={p}/*.parquet")) for p in "abcdef"}


def content(df):
    return sorted((r.product_id, r.review_id, r.sentence_id, r.text, r.sentiment, tuple(r.embedding)) for r in df.collect())


def test_only_changed_products_are_rewritten(spark, path):
    first = spark.createDataFrame([*FIRST, ("z", None, "no id"), (None, "8", "No product.")], REVIEWS)
    ix.refresh_sentence_index(first, path)
    before = files(path)
    # a: edited, same count; c: one more; d: gone; e: the same rows in another order; f: new
    rows = [("e", "7", "Other."), ("e", "6", "Same."), ("a", "1", "One. Two!"), ("a", "2", "Tree."), ("b", "3", "Four? Five."),
            ("c", "4", "Six."), ("c", "9", "Nine."), ("f", "10", "Ten."), ("007", "70", "Bond.")]
    second = spark.createDataFrame(rows, REVIEWS)
    stale = {r.product_id: r.reason for r in ix.refresh_sentence_index(second, path).collect()}
    assert stale == {"a": "content", "b": None, "c": "count", "d": "gone", "e": None, "f": "new", "007": None}
    after = files(path)
    assert {p for p in "abcdef" if before[p] != after[p]} == {"a", "c", "f"}
    assert content(ix.stored_sentence_index(spark, path)) == content(sentence_index(second))
    # nothing changed: no file and no version is written
    versions = len(os.listdir(f"{path}/state/data"))
    assert all(r.reason is None for r in ix.refresh_sentence_index(second, path).collect())
    assert files(path) == after and len(os.listdir(f"{path}/state/data")) == versions


def test_digest_is_of_a_multiset(spark):
    rows = [("a", "1", "x"), ("a", "2", "y")]
    def digest(r):
        return ix.content_digest(spark.createDataFrame(r, REVIEWS)).collect()
    base = digest(rows)
    assert digest(rows[::-1]) == base
    assert digest([("a", "1", "y"), ("a", "2", "x")]) != base           # texts swapped
    assert digest([*rows, rows[0], rows[0]]) != base                    # a repeat cancels in the xor, not in the sum
    assert digest([*rows, ("a", None, "z"), ("a", "3", "")]) == base    # no sentences


def test_a_lost_run_is_repeated(spark, path):
    first = spark.createDataFrame(FIRST, REVIEWS)
    ix.refresh_sentence_index(first, path)
    second = first.withColumn("text", F.when(F.col("review_id") == "3", "Forty.").otherwise(F.col("text")))

    def lost(todo):
        raise RuntimeError("executors lost")

    with pytest.raises(RuntimeError):
        ix.refresh_sentence_index(second, path, build=lost)
    ix.refresh_sentence_index(second, path)
    assert content(ix.stored_sentence_index(spark, path)) == content(sentence_index(second))


def test_publish_reads_what_it_replaces(spark, path):
    assert published(spark, path) is None
    publish(spark.range(3).toDF("n"), path)
    opened = published(spark, path)
    publish(published(spark, path).select((F.col("n") + 10).alias("n")), path)
    assert sorted(r.n for r in published(spark, path).collect()) == [10, 11, 12]
    assert sorted(r.n for r in opened.collect()) == [0, 1, 2]
    # a version that was written but never named is not seen
    spark.range(1).toDF("n").write.parquet(f"{path}/data/orphan")
    assert published(spark, path).count() == 3

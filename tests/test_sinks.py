import json

from opinio.schemas import SUMMARY_ROW
from opinio.sources import sinks

FACTS = ("product_id string, total_reviews long, summary struct<text: string>, features array<struct<name: string, "
         "description: string, review_count: long, positive_count: long, negative_count: long, neutral_count: long, "
         "evidence_sentences: array<string>>>")


def test_sentence_index_round_trip(spark, tmp_path):
    rows = [("p", "r1", 0, "a.", [1.0, 0.0]), ("q", "r2", 0, "b.", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "product_id string, review_id string, sentence_id int, text string, embedding array<float>")
    path = str(tmp_path / "index")
    sinks.write_sentence_index(df, path)
    sinks.write_sentence_index(df.where("product_id = 'p'"), path)      # a refresh of one product keeps the others
    got = sinks.read_sentence_index(spark, path).select(df.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_product_facts_round_trip_and_defaults(spark, tmp_path):
    rows = [("p", 3, ("good",), [("grip", "", 2, 1, 0, 1, ["Great grip."])]), ("q", None, None, None)]
    path = str(tmp_path / "facts")
    sinks.write_product_facts(spark.createDataFrame(rows, FACTS), path)
    got = {r.product_id: r for r in sinks.read_product_facts(spark, path).collect()}
    assert got["p"].features[0].evidence_sentences == ["Great grip."] and got["p"].summary.text == "good"
    assert (got["q"].total_reviews, got["q"].summary.text, got["q"].features) == (0, "", [])


def test_summary_csv_is_a_checkpoint(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    assert sinks.read_checkpoint_csv(spark, path).count() == 0
    row = ("A", 4.5, 60, 0.9, "Quality (3)", "Quality 100%", 'said "fine", twice', "x | y", "", "", "Based on 60")
    sinks.write_summary_csv(spark.createDataFrame([row], SUMMARY_ROW), path)
    got = sinks.read_checkpoint_csv(spark, path).first()
    assert (got.parent_asin, got.review_count, got.avg_rating) == ("A", 60, 4.5)


def test_run_report_keeps_null_settings(spark):
    one = spark.createDataFrame([("p", 1)], "product_id string, n int")
    rep = sinks.run_report(one, one.withColumnRenamed("n", "m"), one.withColumnRenamed("n", "k"),
                           {"use_verified": None, "limit": 5})
    doc = json.loads(rep.first().report)
    assert doc["config"] == {"use_verified": None, "limit": 5} and doc["product_id"] == "p"

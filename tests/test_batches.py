import hashlib
import re

import pytest
from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.functions import vectors as vx
from opinio.functions.batches import list_hits
from opinio.operators import cleaning as cl
from opinio.operators import report as rp
from opinio.operators import themes as th
from opinio.operators.sentences import lexicon_label, sentence_index

TEXTS = ["", "  ", "Gut, gut! The end", "ärger_1 THE the", None, "日本 the und", "...", "x" * 50 + " und. A longer sentence, und the rest!"]


def words(t):
    return re.findall(r"\w+", (t or "").lower())


@pytest.fixture
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)


def test_list_hits_are_weighted_words(df):
    lists = [{"the": 2, "gut": 1}, {}, {"und": 1, "the": 1, "": 9}]
    got = {r.i: r.h for r in df.select("i", list_hits(lists)(tx.spaced_words("t")).alias("h")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == [sum(w.get(x, 0) for x in words(t)) for w in ({"the": 2, "gut": 1}, {}, {"und": 1, "the": 1})]


def test_encoder_and_labels_share_their_words(df):
    """Both are counted in one Arrow step from one column: the words are made once."""
    out = df.select("i", vx.hash_embed("t", 8).alias("v"), lexicon_label("t", ["the"], ["und"]).alias("s"))
    for r in out.collect():
        w = words(TEXTS[r.i])
        at = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 8 for x in w]
        assert list(r.v) == [at.count(b) for b in range(8)]
        assert r.s == ("positive" if w.count("the") > w.count("und") else "negative" if w.count("und") > w.count("the") else "neutral")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan.lower()


def test_phrases_are_found_in_one_pass(df):
    got = {r.i: r.c for r in df.select("i", tx.contains_any("t", ["THE e", "日本", "..."]).alias("c")).collect()}
    assert got == {i: any(p in (t or "").lower() for p in ("the e", "日本", "...")) for i, t in enumerate(TEXTS)}
    assert not any(r.c for r in df.select(tx.contains_any("t", []).alias("c")).collect())


def test_theme_counts_explode_no_words(spark, df):
    themes = [("a", ["the", "the", "gut"]), ("b", ["und"]), ("none", ["absent"])]
    out = th.corpus_theme_counts(df.withColumn("k", F.when(F.col("i") > 2, "p")), "k", "t", themes)
    expected: dict = {}
    for i, t in enumerate(TEXTS):
        for name, ws in themes:
            n = sum(ws.count(w) for w in words(t))
            if n:
                key = ("p" if i > 2 else None, name)
                expected[key] = expected.get(key, 0) + n
    assert {(r.k, r.theme): r.n for r in out.collect()} == expected
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_report_sentences_are_those_scored_in_a_row(spark, df):
    rows = df.select(F.lit("p").alias("k"), F.col("i").cast("long").alias("pos"), F.col("t"))
    lists = ([("a", ["the", "und"]), ("b", ["the"])], ["gut", "the"], ["und"])
    got = {(r["at"].pos, r["at"].i): (r.s, r.score, r.pos_score, r.neg_score, r.wc) for r in rp.report_sentences(rows, "k", "t", *lists).collect()}
    whole = rows.select("pos", F.explode(th.scored_sentences("t", *lists)).alias("x")).collect()
    assert got == {(r.pos, r.x.i): (r.x.s, r.x.score, r.x.pos_score, r.x.neg_score, r.x.wc) for r in whole} and len(got) == 3


def test_first_copy_wins_and_texts_are_normalised_once(spark):
    text = "A text that is long enough to be kept, number "
    rows = [("p", None, f"{text}{n}", 5.0, True, 1.0, pos) for pos, n in [(7, 1), (3, 1), (4, 2), (9, 3)]]
    rows += [("p", None, f"{text}1!!", 5.0, True, 1.0, 3), ("q", None, "another text that has the place of a first copy", 5.0, True, 1.0, 3),
             ("p", None, "gifted " + text + "4", 5.0, True, 1.0, 1), ("p", None, "short", 5.0, True, 1.0, 2)]
    c = spark.createDataFrame(rows, "parent_asin string, title string, text string, rating double, verified_purchase boolean, helpful_vote double, pos long")
    out = cl.clean_corpus(c, "inclusive")
    assert sorted((r.pos, r.parent_asin) for r in out.collect()) == [(3, "p"), (3, "q"), (4, "p"), (9, "p")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^\\p{L}\\p{N}_]+") == 1

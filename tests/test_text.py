from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.operators.sentences import split_sentences


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_sentence_ids_dense(spark):
    df = spark.createDataFrame([("p", "r1", "  A.  B! C  ")], "product_id string, review_id string, text string")
    rows = split_sentences(df).orderBy("sentence_id").collect()
    assert [(r.text, r.sentence_id) for r in rows] == [("A.", 0), ("B!", 1), ("C", 2)]


def test_empty_id_or_text_yields_nothing(spark):
    df = spark.createDataFrame([("p", "", "A. B."), ("p", "r2", ""), ("p", "r3", None)],
                               "product_id string, review_id string, text string")
    assert split_sentences(df).count() == 0


def test_estimate_tokens_null_is_zero(spark):
    assert one(spark, tx.estimate_tokens(F.col("x")), None) == 0.0
    assert one(spark, tx.estimate_tokens(F.col("x")), "abcd") == 1.0


def test_dup_key_unicode_word_chars(spark):
    assert one(spark, tx.normalize_dup_key(F.col("x")), "Été, x_y!! 42") == "étéx_y42"


def test_strip_personal(spark):
    got = one(spark, tx.strip_personal(F.col("x")), "Great pan. I love it! We think so. Mine")
    assert got == "Great pan.   Mine"


def test_compose_and_word_count(spark):
    assert one(spark, tx.compose_review_text(F.lit(None), F.col("x")), "  hi  ") == ".   hi"
    assert one(spark, tx.word_count(F.col("x")), "  a  b\tc ") == 3
    assert one(spark, tx.word_count(F.col("x")), "") == 0


def test_count_word_whole_words(spark):
    assert one(spark, tx.count_word(F.col("x"), "use"), "Use it; user uses USE.") == 2


def test_contains_any_is_substring(spark):
    assert one(spark, tx.contains_any(F.col("x"), ["gifted"]), "a GIFTED-ish item") is True


def test_unicode_white_space(spark):
    from pyspark.sql import functions as F

    from opinio.functions import text as tx
    t = "\u00a0Bonjour\u2009le monde.\u00a0Encore\u3000un mot un mot\u00a0"
    df = spark.createDataFrame([(t,)], "t string")
    r = df.select(tx.strip("t").alias("s"), tx.word_count("t").alias("n"), F.size(tx.sentence_array("t")).alias("k"),
                  tx.strip_stutter("t").alias("u")).first()
    assert r.s == t.strip() and r.n == len(t.split()) and r.k == 2 and r.u.strip().endswith("Encore\u3000un mot")


def test_text_functions_of_the_hot_path(spark):
    """Blank ends, phrases, word weights and hashed counts against Python; none compares a
    token with every bucket or word, none tries a pattern at every character."""
    import hashlib
    import re

    from pyspark.sql import functions as F

    from opinio.functions import text as tx
    from opinio.functions import vectors as vx
    from opinio.operators import themes as th

    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(tx.WS_CHARS) == sorted(blanks)
    rows = ["", " 　", tx.WS_CHARS + "Gut, gut ! FREE Sample" + tx.WS_CHARS, "a.b c​ ", "ärger gut a_1 x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    weights = {"gut": 2, "x": 1, "ärger": 1}
    strip, spam, hits, vec = (tx.strip("t"), tx.contains_any("t", ["free sample", "c​"]),
                              th.weighted_hits(tx.tokens("t"), weights), vx.hash_embed("t", 8))
    got = df.select("i", strip.alias("s"), spam.alias("p"), hits.alias("h"), vec.alias("v")).orderBy("i").collect()
    for t, r in zip(rows, got):
        words = re.findall(r"\w+", (t or "").lower())
        assert r.s == (None if t is None else t.strip(tx.WS_CHARS))
        assert r.p == any(p in (t or "").lower() for p in ("free sample", "c​"))
        assert r.h == sum(weights.get(w, 0) for w in words)
        buckets = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8 for w in words]
        assert list(r.v) == [buckets.count(b) for b in range(8)]
    plan = df.select(strip, spam, hits, vec)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp_replace" not in plan and "aggregate(" not in plan and "element_at" not in plan

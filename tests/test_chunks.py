import random
import time

from pyspark.sql import functions as F

from opinio.operators import aspects, chunks


def reviews(spark):
    rnd = random.Random(4)
    words = ["a", "bb", "ccc.", "dd!", "é", "日本", "why?", " ", "\n"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(80)))) for i in range(60)]
    return spark.createDataFrame([*rows, (100, None), (101, ""), (102, "  "), (103, "x" * 50), (103, "x" * 50)], "id long, text string")


def test_words_are_the_built_in_chunks(spark):
    df = reviews(spark)
    got = chunks.chunk_table(df, max_tokens=7).select("id", "chunk_id", "chunk").collect()
    built_in = df.select("id", F.posexplode(aspects.chunk_by_budget("text", 7)).alias("chunk_id", "chunk")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, built_in)) and len(got) > 100


def test_one_long_sentence_is_linear_work(spark):
    n = 200_000
    df = spark.range(2).select("id", F.array_join(F.sequence(F.lit(1), F.lit(n)), " ").alias("text"))
    chunks_of = df.select(F.explode(aspects.chunk_by_budget("text", 120)).alias("chunk"))
    df.select(F.explode(aspects.chunk_by_budget(F.lit("a. b"), 1))).collect()     # workers are up
    start = time.monotonic()
    got = [r.chunk for r in chunks_of.collect()]
    assert time.monotonic() - start < 10        # cutting every piece out of the whole sentence takes far longer
    assert len(got) == 2 * (n // 120 + 1) and max(len(c.split()) for c in got) == 120
    assert " ".join(got).split() == 2 * [str(i) for i in range(1, n + 1)]


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT cast(X'612EFF20622E2063' AS string) AS text")
    assert df.select(aspects.chunk_by_budget("text", 2)).first()[0] == ["a.\ufffd b.", "c"]


def test_any_tokenizer(spark):
    class Pairs:
        def encode(self, text):
            return [text[i:i + 2] for i in range(0, len(text), 2)]

        def decode(self, tokens):
            return "".join(tokens)

    for factory, n in ((Pairs, 9), (chunks.Characters, 21)):
        out = chunks.chunk_table(reviews(spark), max_tokens=n, tokenizer=factory).collect()
        t = factory()
        assert all(0 < len(t.encode(r.chunk)) <= n for r in out)
        by_id = {}
        for r in sorted(out, key=lambda r: r.chunk_id):
            by_id.setdefault(r.id, []).append(r.chunk)
        assert {100, 101, 102}.isdisjoint(by_id)
        assert sum(map(len, by_id[103])) == 100     # two equal rows, each with all its characters
        for r in reviews(spark).where("id < 100").collect():
            assert "".join("".join(by_id.get(r.id, [])).split()) == "".join(r.text.split())


def test_short_parts(spark):
    df = spark.createDataFrame([("one two three",), ("one two",), ("",), (None,)], "chunk string")
    assert [r.chunk for r in chunks.drop_short_parts(df, 3).collect()] == ["one two three"]

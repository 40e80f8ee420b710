"""Nulls, empty and very long texts, repeated rows, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opinio.llm import hnsw, licenses, mixing, ngram_join, pieces, pii, quality, suffix_dedup, toxicity, urls

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "key string, row int, words int, h int, ids int, toxic_score int, copies int, component int, size int")
EXTRA = ("k", 1, 2, 3, 4, 5, 6, 7, 8)


def edge_docs(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000)) + " mail me at ab.12@mail1.example.com"
    same = "this very row is here more than once, with its words and all, all rights reserved, call +1 (386) 555-3733 now"
    rows = [(1, long, "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0),
            (3, same, "en", "b", 3), (3, same, "en", "b", 3), (3, same + " but not quite", "en", "b", 3),
            (4, same, None, "b", None), (None, same, "en", None, 1), (5, " \n\t ", "en", "a", 1), (6, "one", "de", "c", 1),
            (7, "é" * 3000, "fr", "c", 1), (8, "\u0000a b 日本語 😀 #$%", "xx", "c", 1)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def labels(spark, rows=((3, 1), (1, 0), (2, 0), (None, 1), (6, None))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


OPERATORS = {
    "toxicity": lambda d, lab: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, lab)),
    "license_scan": lambda d, lab: licenses.license_scan(d),
    "ngram_join": lambda d, lab: ngram_join.ngram_join(d),
    "pii": lambda d, lab: pii.replace_personal_data(d),
    "pieces": lambda d, lab: pieces.encode_documents(d, pieces.load_pieces()),
    "mix_plan": lambda d, lab: mixing.assign(mixing.measure(d), mixing.mix_plan(mixing.measure(d))),
    "suffix_dedup": lambda d, lab: suffix_dedup.remove_repeats(d),
    "quality": lambda d, lab: quality.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    docs = edge_docs(spark)
    got = OPERATORS[name](docs, labels(spark)).collect()
    assert len(got) == 13
    empty = OPERATORS[name](docs.where(F.lit(False)), labels(spark, []))
    assert empty.count() == 0


def test_defined_results(spark):
    docs = edge_docs(spark)
    links = {(r.doc_id, r.n_links, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert (2, 0, 2) in links and (3, 4, 3) in links and (4, 4, 3) in links     # three copies and a variant
    cut = [r for r in suffix_dedup.remove_repeats(docs).collect() if r.doc_id == 7]
    assert cut[0].n_removed == 6000 and cut[0].n_spans == 1
    ids = pieces.encode_documents(docs, pieces.load_pieces()).collect()
    assert all(r.round_trip for r in ids) and [r.n_ids for r in ids if r.doc_id == 2] == [0, 0]
    texts = [r.text for r in pii.replace_personal_data(docs).collect() if r.doc_id == 3]
    assert len(texts) == 3 and all("386" not in t for t in texts) and sorted(texts)[0] == sorted(texts)[1]
    marks = {r.doc_id: r.labels for r in licenses.license_scan(docs).collect()}
    assert marks[3] == "reserved" and marks[2] == ""


def test_one_of_each_group_under_null_and_repeated_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]),
            (8, texts[4] + " more"), (7, texts[5]), (None, texts[5]), (9, texts[6]), (None, None), (None, " ")]
    kept = ngram_join.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == sorted(
        [(0, t) for t in texts[:3]] + [(7, t) for t in texts[3:6]] + [(9, texts[6]), (0, ""), (0, " ")])
    clash = spark.createDataFrame([(1, texts[0], "own", 2, True)], "doc_id long, text string, __key string, key int, worded boolean")
    assert [tuple(r) for r in ngram_join.keep_one_of_each_group(clash).collect()] == [(1, texts[0], "own", 2, True)]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = edge_docs(spark)
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for at, table in (("rows", docs), ("none", docs.where(F.lit(False)))):
        d = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            path = str(tmp_path / at / str(k))
            out.write.parquet(path)
            d = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert d.columns == docs.columns
            if name == "ngram_jaccard_join" and at == "rows":
                ids = [r.doc_id for r in d.collect()]
                assert ids.count(3) <= 2 and ids.count(2) == 2 and 4 not in ids
        assert {"doc_id", "ids", "n_ids", "round_trip"} <= set(d.columns)
        assert (d.count() == 0) == (at == "none")


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, links int, node int"
    one, nan = [1.0, 0.0, 0.0], float("nan")
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, [2.0, 0.0, 0.0], 0), (4, one, None), (5, None, 0), (6, [0.0] * 3, 0),
            (7, [nan, 1.0, 0.0], 0), (8, [1.0, None, 0.0], 0), (9, [float("inf"), 0.0, 0.0], 0), (10, [], 0),
            (11, [1.0, 0.0], 0), (12, one, 1), (None, one, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df).collect()]
    assert len(got) == len(rows)
    assert sorted(g for g in got if g[0] in (1, 2, 3)) == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    assert all(g[1] == 0 for g in got if g[0] not in (1, 2, 3))
    assert hnsw.near_vectors(df.where(F.lit(False))).count() == 0


def test_one_vec_id_names_several_vectors(spark):
    a, near, b = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 0), (5, near, 0), (3, [0.0, 0.01, 1.0], 1), (5, [0.0, 0.0, 1.0], 1), (5, b, 0), (6, b, 2), (8, [0.01, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_vectors(df).collect())
    assert got == [(3, 1, 3), (5, 1, 3), (5, 1, 5), (5, 1, 5), (5, 1, 5), (6, 0, 6), (8, 1, 5)]


def test_url_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "no scheme"), (4, "https://EXAMPLE.com/en/" + "x" * 50_000), (4, "http://a.net/es/"),
            (None, "http://b.net/fr/?q"), (5, "http://"), (5, "http://")]
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "page_id long, url string, host int, rule int, key int")
    got = urls.url_filter(df).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert {(r.page_id, r.rule, r.verdict) for r in got if r.rule} == {
        (4, "example.com/en/", "block"), (4, "net/es/", "block"), (None, "net/fr/", "block")}
    assert urls.url_filter(df.where(F.lit(False))).count() == 0

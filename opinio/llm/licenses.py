"""License scan: phrase places, and an exact containment join with notice templates.

A block is a run of 2L words starting at a multiple of L, L being the length
of the template: every run of L words or fewer lies whole in some block.  A
block matches when it holds at least ``threshold`` of the template's distinct
tokens.  Tokens are ordered by their global frequency in the documents, rarest
first.  A matching block must hold one of the first |T| - need + 1 tokens of
the template (prefix filter), have at least ``need`` words (length filter),
and leave room for ``need`` common tokens after the place of the shared token
in both orders (positional filter).  Survivors are verified on the whole sets,
so the result is exact.

Only DataFrame functions; the words of each text are written once and never
shuffled.  Joins with the template tokens are equi-joins that Spark broadcasts
by their size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinio.llm.common import let, row_key, table, text_or_empty, written

PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of well-known licence notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file "
                  "except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted "
           "provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms "
                  "of the gnu general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software "
           "and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "permission-required": "reproduction without written permission of the publisher is prohibited",
}
THRESHOLD = 0.9
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced_words(text: Column) -> Column:
    """The words, lower-cased in A-Z, each between single spaces: ' a b c ' ('' if none)."""
    line = F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " ")
    body = F.btrim(line)
    return F.when(body == "", "").otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _phrase(line: Column, phrase: str, n_words: Column) -> Column:
    """struct(n, first, last) of the phrase's places in a spaced line."""
    size = len(phrase.split())
    kind = "struct<n:bigint,first:bigint,last:bigint>"
    found = let(F.split(line, f" {phrase}(?= )"), lambda p: F.struct(
        (F.size(p) - 1).cast("long").alias("n"),
        _spaces(p[0]).cast("long").alias("first"),
        (n_words - size - (_spaces(F.element_at(p, -1)) - 1)).cast("long").alias("last")))
    return F.when(F.contains(line, F.lit(f" {phrase} ")), found).otherwise(F.lit(None)).cast(kind)


def template_tokens(spark: SparkSession, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """(label, token, length, size, need): the distinct tokens of each template."""
    rows = []
    for label, text in templates.items():
        words = text.split()
        size = len(set(words))
        need = -(-int(round(threshold * 1000)) * size // 1000)
        rows += [(label, w, len(words), size, need) for w in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "label string, token string, length int, size int, need int")


def ordered_templates(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """(label, length, size, need, tokens array): rarest first over all documents."""
    words = lines.select(F.explode(F.split(F.btrim("line"), " ")).alias("token"))
    vocabulary = tokens.select(F.col("token").alias("t")).distinct()
    seen = (words.join(F.broadcast(vocabulary), F.col("token") == F.col("t"), "leftsemi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("seen")))
    order = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("token"))
    return (tokens.join(seen, "token", "left").groupBy("label", "length", "size", "need")
            .agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["token"]).alias("tokens")))


def matching_blocks(lines: DataFrame, ordered: DataFrame) -> DataFrame:
    """(key, label, start, share): blocks whose containment reaches the threshold.

    ``lines`` has (key, line); ``ordered`` is a template a row.
    """
    prefix = ordered.select("label", "length", "size", "need", "tokens", F.posexplode(
        F.slice("tokens", 1, F.col("size") - F.col("need") + 1)).alias("p", "token"))
    words = lines.select("key", F.split(F.btrim("line"), " ").alias("words"))
    hits = (words.select("key", "words", F.posexplode("words").alias("pos", "word"))
            .join(prefix, F.col("word") == F.col("token")))
    unit = F.floor(F.col("pos") / F.col("length")).cast("int")
    starts = F.transform(F.filter(F.array(unit - 1, unit), lambda b: b >= 0),
                         lambda b: b * F.col("length"))
    blocks = hits.select("key", "label", "size", "need", "tokens", "p", F.explode(F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.array_distinct(F.slice(
            "words", s + 1, 2 * F.col("length"))).alias("block")))).alias("b"))
    block = F.col("b.block")
    rarer = F.size(F.array_intersect(F.slice("tokens", 1, F.col("p")), block))
    room = 1 + F.least(F.col("size") - F.col("p") - 1, F.size(block) - rarer - 1)
    blocks = blocks.where((F.size(block) >= F.col("need")) & (room >= F.col("need")))
    common = F.size(F.array_intersect("tokens", block))
    return (blocks.withColumn("common", common).where(F.col("common") >= F.col("need"))
            .select("key", "label", F.col("b.start").cast("long").alias("start"),
                    (F.col("common") / F.col("size")).alias("share")).distinct())


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES,
                 templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrase counts, places, labels and the best containment of each row's whole text.

    Defined results: null and empty texts have no words, no places, empty
    labels and score 0; rows equal in id and text get the same result each;
    an empty table gives an empty result; further columns are ignored.
    ``score`` is 1 where a phrase occurs, else the best containment found.
    Runs jobs when called.
    """
    # read three times: phrases, token frequencies, blocks
    lines = written(docs.select("doc_id", row_key().alias("key"), spaced_words(text_or_empty()).alias("line")),
                    "license-lines")
    n_words = F.greatest(_spaces(F.col("line")) - 1, F.lit(0)).cast("long")
    base = lines.withColumn("n_words", n_words)
    for i, (phrase, _) in enumerate(phrases.items()):
        base = base.withColumn(f"ph{i}", _phrase(F.col("line"), phrase, F.col("n_words")))
    names = [f"ph{i}" for i in range(len(phrases))]
    low = [F.col(f"{c}.first") for c in names]
    high = [F.col(f"{c}.last") for c in names]
    labels = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(v))
                                       for c, v in zip(names, phrases.values())]))
    base = base.select(
        "doc_id", "key", "n_words",
        sum((F.coalesce(F.col(f"{c}.n"), F.lit(0)) for c in names), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.array(*low)).alias("first_word"), F.array_max(F.array(*high)).alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"))
    spark = docs.sparkSession
    tokens = template_tokens(spark, templates, threshold)
    ordered = written(ordered_templates(lines, tokens), "license-order")
    found = (matching_blocks(lines.select("key", "line"), ordered).groupBy("key")
             .agg(F.collect_set("label").alias("more"), F.max("share").alias("share")))
    out = base.join(found, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(
        "more", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    phrases = ", ".join(f"('{k}', '{v}', {len(k.split())})" for k, v in PHRASES.items())
    per_mille = int(round(THRESHOLD * 1000))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
ph(phrase, label, size) AS (VALUES {phrases}),
ha AS (SELECT doc_id, label, pos FROM (SELECT d.doc_id, ph.*, unnest(range(len(words) - size + 1)) AS pos, words
    FROM d, ph WHERE contains(array_to_string(words, ' '), phrase))
    WHERE array_to_string(words[pos + 1:pos + size], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
    list_sort(list(DISTINCT label)) AS base FROM ha GROUP BY doc_id),
t(label, body) AS (VALUES {values}),
tw AS (SELECT DISTINCT label, len(string_split(body, ' ')) AS length, unnest(string_split(body, ' ')) AS token FROM t),
ts AS (SELECT label, length, count(*) AS size FROM tw GROUP BY ALL),
hits AS (SELECT doc_id, label, token, unnest([pos // length, pos // length - 1]) AS block
    FROM w JOIN tw ON word = token),
m AS (SELECT doc_id, label, block, count(DISTINCT token) AS common FROM hits WHERE block >= 0 GROUP BY ALL),
f AS (SELECT doc_id, list(DISTINCT m.label) AS more, max(common / size) AS share FROM m JOIN ts USING (label)
    WHERE common >= (size * {per_mille} + 999) // 1000 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
    first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '')
    AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


ORACLE = _oracle()

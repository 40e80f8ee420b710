"""Fill-in-the-middle: each text is cut once by a regular expression made for it.

A text's units are its runs of letters and its other characters.  ``regexp_count``
gives their number n; two keyed draws choose the cuts a <= b; the pattern
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z`` then holds prefix, middle and suffix
as its groups, so one match of one pattern moves the middle to the end.  Every
quantifier is possessive: the match never backs off and needs no stack, however
long the text is.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``, ``plain`` is the text itself.  A text that is empty
or holds a marker stays plain, so each marker of a formed text occurs once and the
text can be rebuilt from output and form alone.

Defined results: a null text counts as empty (plain, n = 0); a null id draws as an
empty string; rows that agree in id and text get equal results; an empty table
gives an empty table; the caller's columns come back in a struct ``row``, so none
clashes with a column added here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm.common import table, text_or_empty

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The same units where nothing may be given back.
_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_PERCENT, SPM_PERCENT = 10, 20


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _pattern(first: Column, second: Column) -> Column:
    return F.concat(F.lit(r"\A(" + _UNIT + "{"), first.cast("string"), F.lit("}+)(" + _UNIT + "{"),
                    (second - first).cast("string"), F.lit(r"}+)((?s:.)*+)\z"))


def _between(text: Column, opening: str, closing: str | None) -> Column:
    """What stands after the first ``opening``, up to the first ``closing``."""
    after = F.substring(text, F.instr(text, opening) + F.lit(len(opening)), F.char_length(text))
    return F.substring_index(after, closing, 1) if closing else after


def restore(output: Column, form: Column) -> Column:
    """The text, from the formed output and its form alone."""
    middle = _between(output, MIDDLE, None)
    return (F.when(form == "psm", F.concat(_between(output, PREFIX, SUFFIX), middle, _between(output, SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(_between(output, PREFIX, MIDDLE), middle, _between(output, SUFFIX, PREFIX)))
            .otherwise(output))


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n, form, output, prefix_chars, middle_chars): every text in its form.

    ``row`` is the caller's whole row, so no column of it can clash.  Lazy, without a
    shuffle.  Lengths are in code points, null for plain texts.
    """
    text = text_or_empty(f"`{text_col}`")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"),
                    F.sha2(named.cast("binary"), 256).alias("digest"))
    d = d.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    x, y = (_draw(F.col("digest"), k) % (F.col("n") + 1) for k in (0, 1))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    d = d.withColumns({
        "first": F.least(x, y), "second": F.greatest(x, y),
        "form": F.when((F.col("text") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= 100 - plain_percent), "plain")
        .when(_draw(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm")})
    formed = F.regexp_replace("text", _pattern(F.col("first"), F.col("second")),
                              F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
                              .otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
    d = d.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(formed))
    size = lambda opening, closing: F.char_length(_between(F.col("output"), opening, closing)).cast("long")
    return d.select("row", "n", "form", "output",
                    F.when(F.col("form") == "psm", size(PREFIX, SUFFIX))
                    .when(F.col("form") == "spm", size(PREFIX, MIDDLE)).alias("prefix_chars"),
                    F.when(F.col("form") != "plain", size(MIDDLE, None)).alias("middle_chars"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's formed text, and of the text rebuilt from it."""
    d = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars",
                    digest(F.col("output")).alias("output_sha256"),
                    digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
    THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
    array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

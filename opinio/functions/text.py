"""Scalar text functions as Spark Column expressions.

All of these compile to built-in expressions, so they stay inside
whole-stage codegen (or, for higher-order functions, inside the JVM).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.dictionaries import PERSONAL_WORDS
from opinio.functions.batches import contains_one

# Non-word characters: Unicode letters, digits and '_' are word characters,
# which is what Python's Unicode-aware \W excludes.  Java's \W is ASCII-only.
NON_WORD = r"[^\p{L}\p{N}_]+"
# White space as Unicode has it (no-break, ideographic, ... included): Java's \s is
# ASCII-only.  The same text is valid in the SQL of the oracles.
WS = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same characters one by one.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
STUTTER = (rf"(?<![\p{{L}}\p{{N}}_])([\p{{L}}\p{{N}}_]+{WS}+[\p{{L}}\p{{N}}_]+)"
           rf"{WS}+\1(?![\p{{L}}\p{{N}}_])")
SENTENCE_BREAK = rf"(?<=[.!?]){WS}+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace (not only U+0020)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def estimate_tokens(col, tokens_per_char: float = 0.25) -> Column:
    """Code points x tokens_per_char; null text counts as 0 tokens."""
    return F.coalesce(F.length(_c(col)), F.lit(0)).cast("double") * F.lit(float(tokens_per_char))


def compose_review_text(title, text) -> Column:
    """strip(title + '. ' + text) with nulls read as ''."""
    return strip(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(". "),
                          F.coalesce(_c(text), F.lit(""))))


def normalize_dup_key(col) -> Column:
    """Lower-case and delete every run of non-word characters."""
    return F.regexp_replace(F.lower(_c(col)), NON_WORD, "")


def personal_pattern(words=PERSONAL_WORDS) -> str:
    alt = "|".join(words)
    # Word boundaries written as look-arounds over the Unicode word class.
    return r"(?i)(?<![\p{L}\p{N}_])(" + alt + r")(?![\p{L}\p{N}_])[^.!?]*[.!?]"


def strip_personal(col, words=PERSONAL_WORDS) -> Column:
    """Delete from a standalone first-person word through the next . ! or ?"""
    return F.regexp_replace(_c(col), personal_pattern(words), "")


def strip_stutter(col) -> Column:
    """Collapse an immediately repeated word pair ("a b a b" -> "a b")."""
    return F.regexp_replace(_c(col), STUTTER, "$1")


def truncate_text(col, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def review_texts(reviews: DataFrame, key: str = "product_id", order_col: str = "pos", text_col: str = "text") -> DataFrame:
    """The texts of all reviews with their product and place; nulls and empty ones stay."""
    return reviews.select(key, order_col, text_col)


def word_count(col) -> Column:
    """len(text.split()): whitespace-separated tokens, empty -> 0."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), WS + "+")
    return F.size(F.filter(parts, lambda w: w != F.lit("")))


def tokens(col) -> Column:
    """Lower-cased word tokens (Unicode word characters), empties dropped."""
    parts = F.split(F.lower(F.coalesce(_c(col), F.lit(""))), NON_WORD)
    return F.filter(parts, lambda w: w != F.lit(""))


def spaced_words(col) -> Column:
    """The words of ``tokens`` with a space between any two (blanks at the ends may stay)."""
    return F.array_join(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), NON_WORD), " ")


def count_word(col, word: str) -> Column:
    """Case-insensitive whole-word occurrences of ``word``.

    A whole-word regex match of a word made of word characters is exactly a
    token equal to it, so this counts equal tokens.
    """
    return F.size(F.filter(tokens(col), lambda t: t == F.lit(word.lower())))


def sentence_array(col) -> Column:
    """strip -> split after . ! ? -> strip parts -> drop empties."""
    parts = F.split(strip(F.coalesce(_c(col), F.lit(""))), SENTENCE_BREAK)
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != F.lit(""))


def long_sentence_array(col, min_len: int = 10) -> Column:
    """Sentences longer than ``min_len`` characters."""
    return F.filter(sentence_array(col), lambda s: F.length(s) > F.lit(min_len))


def contains_any(col, phrases) -> Column:
    """lower(text) contains any of the phrases (substring, not word).

    The text is lowered once; all phrases are searched in one pass over an Arrow batch.
    """
    if not phrases:
        return F.lit(False)
    return contains_one(sorted({p.lower() for p in phrases}))(F.lower(F.coalesce(_c(col), F.lit(""))))


def pack_evidence(arr) -> Column:
    return F.array_join(_c(arr), " | ")


def unpack_evidence(col) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(col), F.lit("")), r"\|"), lambda s: strip(s))
    return F.filter(parts, lambda s: s != F.lit(""))

"""Word lists as small dictionary DataFrames (user-replaceable).

The lists are tiny and fixed in size, so broadcasting them is bounded.
Users pass their own DataFrame with the same columns to replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: these must equal the reference's lists for equal results.
# Theme -> words (gen-1 batch job), in the reference's order.
THEMES_GEN1 = [
    ("quality", ["quality", "durable", "sturdy", "material", "build", "craft", "design"]),
    ("value", ["price", "worth", "expensive", "cheap", "deal", "overpriced", "value"]),
    ("delivery", ["shipping", "delivery", "arrived", "delay", "late", "package"]),
    ("content", ["article", "topic", "section", "issue", "story", "coverage", "writing"]),
    ("usability", ["easy", "hard", "use", "setup", "install", "intuitive", "comfortable"]),
    ("battery", ["battery", "charge", "charging", "life", "power"]),
    ("noise", ["loud", "quiet", "noise", "noisy", "silent"]),
    ("scent", ["smell", "scent", "fragrance", "odor"]),
    ("fit", ["size", "fit", "fitting", "tight", "loose"]),
    ("safety", ["safety", "hazard", "danger", "overheat", "burn"]),
]
# Theme -> words (second-generation summarizer), in the reference's order.
THEMES_V2 = [
    ("quality", ["quality", "excellent", "poor", "great", "good", "bad", "durable", "fragile", "strong", "weak"]),
    ("value", ["price", "value", "worth", "cheap", "expensive", "deal", "money", "cost", "refund"]),
    ("delivery", ["shipped", "delivery", "shipping", "package", "arrived", "late", "fast", "slow", "damage"]),
    ("content", ["article", "topic", "section", "issue", "story", "coverage", "writing"]),
    ("usability", ["easy", "hard", "use", "setup", "install", "intuitive", "comfortable"]),
    ("battery", ["battery", "charge", "charging", "life", "power"]),
    ("noise", ["loud", "quiet", "noise", "noisy", "silent"]),
    ("scent", ["smell", "scent", "fragrance", "odor"]),
    ("fit", ["size", "fit", "fitting", "tight", "loose"]),
    ("safety", ["safety", "hazard", "danger", "overheat", "burn"]),
]
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "love", "works", "easy", "smooth",
                  "well", "best", "perfect", "reliable", "recommend", "worth"]
NEGATIVE_WORDS = ["bad", "poor", "terrible", "awful", "hate", "broken", "hard", "difficult",
                  "waste", "disappointing", "noisy", "expensive", "slow", "late", "smell"]
# Substring phrases that mark a review as spam (gen-1) ...
SPAM_PHRASES = ["free sample", "gifted", "sponsored", "promotion", "in exchange for",
                "discounted for review", "ad partnership", "paid partnership", "collaboration",
                "sponsored review"]
# ... and the second generation's spam words (they only lower the score).
SPAM_WORDS_V2 = ["viagra", "casino", "lottery", "xxx"]
# First-person words whose sentence tail is removed by strip_personal.
PERSONAL_WORDS = ["I", "my", "mine", "me", "we", "our", "us"]
# ---------------------------------------------------------------------------

# A user-supplied dictionary (ours, not the reference's) of common function
# words in the four languages of the driver documents; used to exercise the
# theme operators on text where the product themes above never occur.
THEMES_FUNCTION_WORDS = [
    ("article", ["the", "a", "an", "la", "le", "les", "der", "die", "das", "el", "un"]),
    ("conjunction", ["and", "und", "et", "y", "or", "but"]),
    ("preposition", ["of", "de", "to", "in", "for", "on", "with", "by", "at", "from", "en"]),
    ("pronoun", ["it", "this", "that", "he", "she", "they", "er", "es"]),
]

# Word lists that occur in the driver documents, as a user's own sentiment lists.
POSITIVE_FUNCTION_WORDS = ["and", "of", "und", "la", "que"]
NEGATIVE_FUNCTION_WORDS = ["in", "to", "die", "le", "de"]

DICTIONARY_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType(), False),      # theme | pos | neg | spam
    T.StructField("theme", T.StringType(), True),
    T.StructField("theme_idx", T.IntegerType(), True),
    T.StructField("word", T.StringType(), False),
])


def dictionary_rows(themes=THEMES_GEN1, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS,
                    spam=SPAM_PHRASES):
    rows = []
    for idx, (theme, words) in enumerate(themes):
        rows += [("theme", theme, idx, w) for w in words]
    rows += [("pos", None, None, w) for w in pos]
    rows += [("neg", None, None, w) for w in neg]
    rows += [("spam", None, None, w) for w in spam]
    return rows


def dictionary_df(spark: SparkSession, version: str = "gen1") -> DataFrame:
    """The dictionary table: one row per (kind, theme, word)."""
    if version == "gen1":
        rows = dictionary_rows()
    elif version == "v2":
        rows = dictionary_rows(themes=THEMES_V2, spam=SPAM_WORDS_V2)
    else:
        raise ValueError(f"unknown dictionary version {version!r}")
    return spark.createDataFrame(rows, DICTIONARY_SCHEMA)


def themes_df(spark: SparkSession, version: str = "gen1") -> DataFrame:
    """(theme, theme_idx) in dictionary order."""
    themes = THEMES_GEN1 if version == "gen1" else THEMES_V2
    return spark.createDataFrame([(t, i) for i, (t, _) in enumerate(themes)],
                                 "theme string, theme_idx int")


def sql_values(rows) -> str:
    """Render dictionary rows as a SQL VALUES list (used by the DuckDB oracles)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)

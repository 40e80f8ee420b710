"""URL filter: list rules first, then a character language-model ratio.

A rule (host, path) fits its host and all subdomains when the URL's path starts
with the rule's path; the longest fitting rule decides.  For URLs without a
rule, variable-order Markov models of accepted and rejected URLs (those that a
rule decides) give the log-likelihood difference per character, and a
threshold calibrated on held-out decided URLs gives the verdict.

Counts cover every decided URL.  A character is predicted from its longest
context and, by interpolation, from all shorter ones.  The models are tables of
grams, joined to the URLs by gram; they are not brought to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinio.llm.common import row_key, table, written

RULES = (   # verdict, host, path
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4           # longest context, characters
BACKOFF = 2.0       # weight of the shorter context, as so many observations
ALPHABET = 256.0    # characters that order 0 gives some mass
CALIBRATE = 5       # every 5th decided URL, by hash, sets the threshold instead of training
BIN = 0.02          # step of the threshold
START, END = "\u0002", "\u0003"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(raw, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "r_verdict string, r_host string, r_path string")


def decide_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, host, path) -> (key, rule, r_verdict) for URLs that some rule fits.

    An equi-join on the host and its parent domains; a URL has as many of
    those as its host has labels.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    fits = (urls.select("key", "path", F.explode(parents).alias("parent"))
            .join(rules, F.col("parent") == F.col("r_host"))
            .where(F.col("path").startswith(F.col("r_path"))))
    rule = F.concat(F.col("r_host"), F.col("r_path"))
    best = fits.groupBy("key").agg(F.max(F.struct(
        F.length(rule).alias("n"), F.length("r_host").alias("m"), rule.alias("rule"),
        F.col("r_verdict"))).alias("b"))
    return best.select("key", "b.rule", "b.r_verdict")


def _grams(line: Column, order: int) -> Column:
    padded = F.concat(F.lit(START * order), line, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(line) + 1),
                       lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, a, r) counts -> (gram, ratio): ln P_accepted - ln P_rejected of the last character.

    ``counts`` holds every gram to be scored, with its counts among accepted
    and rejected URLs (0 where it was only met elsewhere).  Order by order the
    probability is (count + B * P_shorter) / (context count + B).
    """
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("r").alias("tr")).first()
    ta, tr = float(totals.ta or 0), float(totals.tr or 0)
    out = counts.select("gram", F.lit(1 / ALPHABET).alias("pa"), F.lit(1 / ALPHABET).alias("pr"))
    for k in range(order + 1):
        seen = (counts.where("a + r > 0").groupBy(F.expr(f"right(gram, {k + 1})").alias("g"))
                .agg(F.sum("a").alias("ca"), F.sum("r").alias("cr")))
        out = out.join(seen, F.expr(f"right(gram, {k + 1})") == F.col("g"), "left").drop("g")
        if k:
            ctx = (counts.where("a + r > 0")
                   .groupBy(F.expr(f"substring(gram, {order - k + 1}, {k})").alias("c"))
                   .agg(F.sum("a").alias("na"), F.sum("r").alias("nr")))
            out = out.join(ctx, F.expr(f"substring(gram, {order - k + 1}, {k})") == F.col("c"), "left").drop("c")
        else:
            out = out.withColumns({"na": F.lit(ta), "nr": F.lit(tr)})

        def p(c, n, shorter):
            zero = F.lit(0.0)
            return (F.coalesce(c, zero) + BACKOFF * F.col(shorter)) / (F.coalesce(n, zero) + BACKOFF)
        out = out.select("gram", p(F.col("ca"), F.col("na"), "pa").alias("pa"),
                         p(F.col("cr"), F.col("nr"), "pr").alias("pr"))
    return out.select("gram", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def calibrated_threshold(scored: DataFrame) -> float:
    """Lowest threshold with the best mean of both classes' accuracy.

    ``scored`` has (score, accepted); only counts by score bin are gathered.
    """
    bins = (scored.groupBy(F.floor(F.col("score") / BIN).alias("bin"))
            .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0)
    good = ((F.sum("a").over(every) - F.coalesce(F.sum("a").over(below), zero))
            / F.greatest(F.sum("a").over(every), F.lit(1))
            + F.coalesce(F.sum("r").over(below), zero) / F.greatest(F.sum("r").over(every), F.lit(1)))
    best = bins.select("bin", good.alias("good")).orderBy(F.desc("good"), "bin").first()
    return best.bin * BIN if best else 0.0


def url_filter(pages: DataFrame, rules: DataFrame | None = None, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of ``pages``.

    Defined results: a null URL, or one without ``://``, has empty host and
    path and is judged by the model on its end mark alone; rows equal in id and
    URL get the same result each; without decided URLs every ratio is 0 and the
    verdict is allow; an empty table stays empty; further columns are ignored.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    url = F.col("url")
    rows = pages.select("page_id", row_key("page_id", "url").alias("key"), host_of(url).alias("host"),
                        path_of(url).alias("path"))
    rows = written(rows.join(decide_by_rules(rows, rules), "key", "left"), "url-rows")
    line = F.concat("host", "path")
    fold = F.pmod(F.xxhash64(F.lit("url-fold"), "host", "path"), F.lit(CALIBRATE)) == 0
    grams = rows.select("r_verdict", fold.alias("fold"), F.explode(_grams(line, order)).alias("gram"))
    train = ~F.col("fold")
    counts = written(grams.groupBy("gram").agg(
        F.count_if(train & (F.col("r_verdict") == "allow")).alias("a"),
        F.count_if(train & (F.col("r_verdict") == "block")).alias("r")), "url-grams")
    ratios = written(gram_ratios(counts, order), "url-ratios")
    # one row a URL and gram, with its number of places; equal rows count once
    each = rows.dropDuplicates(["key"]).select("key", F.explode(_grams(line, order)).alias("gram"))
    sums = (each.join(ratios, "gram").groupBy("key")
            .agg((F.sum("ratio") / F.count(F.lit(1))).alias("score")))
    scored = written(rows.join(sums, "key", "left"), "url-scores")
    decided = scored.where(fold & F.col("r_verdict").isNotNull())
    cut = calibrated_threshold(decided.select("score", (F.col("r_verdict") == "allow").alias("accepted")))
    verdict = F.coalesce("r_verdict", F.when(F.col("score") < cut, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))

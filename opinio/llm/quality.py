"""Quality rules with robust multivariate outliers (minimum covariance determinant).

Base rules count words, symbols, repeated lines and repeated five-word windows
in every whole text.  On top, each (language, source) group gets a
minimum-covariance-determinant estimate of the transformed statistics.  From each
of several starts, concentration steps keep the 75 % of rows nearest by Mahalanobis
distance and re-estimate mean and covariance from them, as long as the covariance
determinant falls; of all starts the estimate with the smallest determinant is
taken.  A document whose squared distance is beyond the cutoff is rejected.

Groups of fewer than MIN_ROWS rows are judged by the estimate of their language's
rows, and where the language has as few, by that of the whole corpus: every row that
passes the base rules has a distance.

Only DataFrame functions.  Group estimates are combined sums, order statistics
come from counts on a fixed grid (exact on that grid, and combined before the
shuffle), so a group of a third of all rows is never brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.common import SPACE_WORD, bounded, let, row_key, table, text_or_empty, written

STATS = ("x0", "x1", "x2", "x3")
#: Variance added to each statistic's diagonal: a statistic that hardly varies
#: in a group must not turn small differences into large distances.
FLOORS = (0.25, 0.01, 0.25, 0.05)
KEEP_SHARE = 0.75       # the covariance determinant is minimised over this share
FALL = 1e-6             # the log of the determinant must fall by more for a further step
CONSISTENCY = 1.485     # share / P(chi2_6 <= chi2_4 quantile of the share)
CUTOFF = 45.0           # squared distance; chi2 with 4 degrees passes it once in 2e8
MIN_ROWS = 20           # smaller groups are judged by their language's rows, or by all
MAX_GROUPS = 50_000     # rows of the per-group table that may be broadcast
GRID = 64.0             # order statistics: grid steps a unit
MIN_WORDS, MAX_REPEAT_PCT = 10, 20


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more, first included."""
    n = F.size(words)

    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.xxhash64(
            *[F.element_at(h, (i + k).cast("int")) for k in range(5)]))

    def covered(g):
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def repeated(s):
            m = F.size(s)
            hit = F.filter(s, lambda x, j: (x["g"] == F.try_element_at(s, j + 2)["g"])
                           | F.when(j > 0, x["g"] == F.element_at(s, F.greatest(j, F.lit(1)))["g"])
                           .otherwise(F.lit(False)))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def cover(p):
            return F.aggregate(F.transform(p, lambda x, j: F.least(
                F.lit(5), F.coalesce(F.try_element_at(p, j + 2) - x, F.lit(5)))),
                F.lit(0), lambda a, x: a + x)
        return let(let(pairs, repeated), cover)

    value = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(
        windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g))))
    return F.when(n >= 5, value).otherwise(0).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """Base counts of each row's whole text (null: no words), with its group and key."""
    text = text_or_empty()
    d = docs.select("doc_id", "lang", "source", text.alias("text"), row_key().alias("key"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return d.select(
        "doc_id", "lang", "source", "key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"))


def transformed(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "x0": F.log(n),
        "x1": F.log((F.col("word_chars") + 1) / n),
        "x2": F.log1p(100.0 * F.col("n_symbols") / n),
        "x3": F.sqrt((F.col("n_dup_lines") * 5 + F.col("n_repeat_words")) / n),
    })


def _quantile_cells(rows: DataFrame, group: list[str], value: Column, share: float,
                    out: str) -> DataFrame:
    """The upper end of the grid cell that holds each group's ``share`` quantile."""
    cells = (rows.groupBy(*group, F.floor(value * GRID).alias("__cell"))
             .agg(F.count(F.lit(1)).alias("__n")))
    order = Window.partitionBy(*group).orderBy("__cell")
    every = Window.partitionBy(*group)
    return (cells.withColumn("__run", F.sum("__n").over(order))
            .withColumn("__all", F.sum("__n").over(every))
            .where(F.col("__run") >= F.ceil(F.col("__all") * share))
            .groupBy(*group).agg(((F.min("__cell") + 1) / GRID).alias(out)))


GROUP = ["gid", "start"]
_LOWER = [f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]
_ESTIMATE = [f"m_{x}" for x in STATS] + _LOWER


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean, lower Cholesky factor of the (floored) covariance and the log of its
    determinant, a row for each group and start."""
    p = len(STATS)
    sums = [F.avg(x).alias(f"m_{x}") for x in STATS]
    sums += [F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    g = rows.groupBy(*GROUP).agg(*sums)
    for i in range(p):
        g = g.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") * CONSISTENCY + FLOORS[i])
    for i in range(p):
        for j in range(i):
            g = g.withColumn(f"c{i}{j}", F.col(f"c{i}{j}") * CONSISTENCY)
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            g = g.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j
                             else rest / F.col(f"l{j}{j}"))
    return g.select(*GROUP, *_ESTIMATE, _log_det().alias("log_det"))


def _log_det() -> Column:
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, len(STATS))), 2 * F.log("l00"))


def _with_distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, for each start that ``est`` has of a row's
    group (null where it has none)."""
    more = [c for c in est.columns if c == "start"]
    e = est.select(F.col("gid").alias("__gid"), *more, *_ESTIMATE)
    out = rows.join(bounded(e, MAX_GROUPS), F.col("gid") == F.col("__gid"), "left")
    p = len(STATS)
    for i in range(p):
        z = F.col(STATS[i]) - F.col(f"m_{STATS[i]}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"__z{k}")
        out = out.withColumn(f"__z{i}", z / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(1, p)), F.col("__z0") * F.col("__z0"))
    return out.withColumn("d2", d2).select(*rows.columns, *more, "d2")


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates of each group: 0 medians and interquartile spread, coordinate by
    coordinate; 1 mean and covariance of all its rows; 2 and 3 those of the rows below and
    above the median of the first statistic, for groups of two kinds of rows."""
    long = rows.select("gid", F.posexplode(F.array(*STATS)).alias("dim", "v"))
    q = {s: _quantile_cells(long, ["gid", "dim"], F.col("v"), s, "q") for s in (0.25, 0.5, 0.75)}
    spread = written(q[0.5].withColumnRenamed("q", "mid")
                     .join(q[0.25].withColumnRenamed("q", "low"), ["gid", "dim"])
                     .join(q[0.75].withColumnRenamed("q", "high"), ["gid", "dim"]), "quality-spread")
    middle = spread.groupBy("gid").agg(
        F.lit(0).alias("start"),
        *[F.max(F.when(F.col("dim") == i, F.col("mid"))).alias(f"m_{x}") for i, x in enumerate(STATS)],
        *[(F.lit(0.0) if i != j else F.sqrt(F.pow(F.max(F.when(
            F.col("dim") == i, (F.col("high") - F.col("low")) / 1.349)), 2) + FLOORS[i])).alias(f"l{i}{j}")
          for i in range(len(STATS)) for j in range(i + 1)]).withColumn("log_det", F.lit(None).cast("double"))
    half = spread.where(F.col("dim") == 0).select(F.col("gid").alias("__g"), F.col("mid").alias("__mid"))
    side = F.when(F.col("x0") < F.col("__mid"), 2).otherwise(3)
    dealt = rows.join(bounded(half, MAX_GROUPS), F.col("gid") == F.col("__g")).select(
        "gid", F.explode(F.array(F.lit(1), side)).alias("start"), *STATS)
    return middle.unionByName(_estimate(dealt).withColumn("log_det", F.lit(None).cast("double")))


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """(gid, x0..x3) -> the estimate (gid, m_*, l*, log_det) of smallest determinant a group.

    All groups and starts take their concentration steps together; those whose
    determinant has stopped falling are done.  Each step keeps at least KEEP_SHARE of a
    group's rows: order statistics are exact on a fine grid of the distance.
    """
    now = written(_starts(rows), "quality-start")
    done = []
    while True:
        near = _with_distance(rows, now).where(F.col("d2").isNotNull())
        place = F.log1p("d2") * 16
        edge = written(_quantile_cells(near, GROUP, place, KEEP_SHARE, "edge"), "quality-edge")
        e = bounded(edge.select(F.col("gid").alias("__g"), F.col("start").alias("__s"), "edge"), MAX_GROUPS)
        core = near.join(e, (F.col("gid") == F.col("__g")) & (F.col("start") == F.col("__s"))).where(place < F.col("edge"))
        before = now.select(*GROUP, F.col("log_det").alias("was"))
        step = written(_estimate(core).join(before, GROUP).withColumn(
            "falls", F.col("was").isNull() | (F.col("log_det") < F.col("was") - FALL)), "quality-step")
        # an estimate that did not fall any more is no better than the one before
        done.append(now.join(step.where(~F.col("falls")).select(*GROUP), GROUP, "left_semi"))
        now = step.where("falls").drop("was", "falls")
        if now.isEmpty():
            break
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    best = ends.groupBy("gid").agg(F.min_by(F.struct(*_ESTIMATE, "log_det"), F.struct("log_det", "start")).alias("e"))
    return written(best.select("gid", "e.*"), "quality-estimate")


def group_keys() -> list[Column]:
    """A row's group, the group of its language, and the one of all rows."""
    part = lambda c: (F.col(c), F.col(c).isNull())      # null is a value of its own
    return [F.xxhash64(F.lit(0), *part("lang"), *part("source")), F.xxhash64(F.lit(1), *part("lang")), F.xxhash64(F.lit(2))]


def with_group(stats: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stats`` with gid, the group that judges each row, and the rows (gid, x0..x3) that
    shape those groups' estimates: all ``judged`` rows of the group, language or corpus."""
    keys = judged.select(F.posexplode(F.array(*group_keys())).alias("level", "gid"))
    sizes = written(keys.groupBy("level", "gid").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    large = bounded(sizes.where((F.col("n") >= MIN_ROWS) | (F.col("level") == 2)).select(F.col("gid").alias("__k")), MAX_GROUPS)
    out = stats.withColumns(dict(zip(("__g0", "__g1", "__g2"), group_keys(), strict=True)))
    for level in ("__g0", "__g1"):
        out = out.join(large.withColumn("__has", F.lit(True)), F.col(level) == F.col("__k"), "left").withColumn(
            level, F.when(F.col("__has"), F.col(level))).drop("__has", "__k")
    out = written(out.withColumn("gid", F.coalesce("__g0", "__g1", "__g2")).drop("__g0", "__g1", "__g2"), "quality-judged")
    used = bounded(written(out.select(F.col("gid").alias("__u")).distinct(), "quality-used"), MAX_GROUPS)
    shaping = judged.select(F.explode(F.array(*group_keys())).alias("gid"), *STATS)
    return out, written(shaping.join(used, F.col("gid") == F.col("__u"), "left_semi"), "quality-shaping")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, d2 and kept for every row of ``docs``.

    Defined results: a null or empty text has no words and fails the base
    rules; null lang or source form groups of their own; rows of groups under
    MIN_ROWS are judged with their language, then with all rows; d2 is null only if no
    row at all passes the base rules; repeated rows are each judged; an empty table
    gives an empty result.  Further columns are ignored.  Runs jobs when called.
    """
    stats = written(transformed(text_statistics(docs)), "quality-stats")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words")
                                               > MAX_REPEAT_PCT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    # rows that fail the base rules don't shape the estimates
    stats, shaping = with_group(stats, stats.where(~F.col("base_failed")))
    judged = _with_distance(stats, minimum_covariance(shaping))
    return judged.withColumn("kept", ~F.col("base_failed")
                             & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "d2")

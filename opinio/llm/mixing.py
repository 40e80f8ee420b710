"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source owns a keyed permutation of its documents (md5 order).  Its
target, in words, is met by whole passes over that permutation plus a prefix
of it; the prefix ends at an exact cutoff key, found from bucket totals and a
window over the one boundary bucket.  The permutation is cut into blocks
(equal ranges of the key).  The block quotas of all sources form the root of a
binary tree; each node deals its quotas to two children of equal capacity by
sequential hypergeometric draws, so the leaves (output shards) hold exact,
disjoint quotas.  Many sources are dealt in groups first, so no row holds more
than GROUP quotas.  A shard then takes consecutive blocks of each source's
permuted order and shuffles its rows locally by a keyed hash.

Everything is DataFrame functions.  Documents are never shuffled by source:
each row compares its key with its source's cutoff.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.common import SPACE_WORD, bounded, table, text_or_empty, written

WEIGHTS = (5, 2, 1)     # by source in code point order, repeating
MAX_REPEAT = 3          # a target stops at this many times its source's size
SEED = 20240917
BUCKET_HEX = 3          # 4096 ranges of the key to find the cutoff in
BLOCK_HEX = 2           # 256 blocks a pass
SHARDS = 64             # leaves of the splitting tree (a power of two)
GROUP = 512             # sources (or groups of them) whose quotas one row of the tree holds
MAX_SOURCES = 20_000    # rows of the per-source table that may be broadcast


def word_size(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))).cast("long")


def mix_key(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Keyed place of a row in its source's permutation (hex, uniform)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)),
                             F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                             F.md5(text_or_empty(text_col))))


def ranked(rows: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """Adds ``place`` (from 0, in ``order``) and for each column of ``sums`` its sum before the row.

    Rows are dealt into ranges of the order; inside a range a window runs, and the
    ranges' own totals (a row a range) are what is summed in one task.  ``order`` must
    leave no ties.  Runs jobs when called.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    totals = parts.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums])
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead")
                                      for c in ("rows", *sums)])
    here = Window.partitionBy("range").orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(totals, "range")
    return out.select(*rows.columns, (F.col("rows_ahead") + F.row_number().over(here) - 1).alias("place"), *[
        (F.col(f"{c}_ahead") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"{c}_before") for c in sums])


def _by_name() -> list[Column]:
    return [F.col("source").asc_nulls_last()]


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> target words a source, by water filling.

    Sources in code point order (null last) take the weights in turn and share
    the sum of all sizes; a target stops at ``max_repeat`` times its source's
    size and the excess is shared again by weight.  In order of
    cap/weight a source is capped exactly when its cap is no more than its
    share of what the capped sources before it leave.  Runs jobs when called.
    """
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("place") % n + 1).cast("int")).cast("long")
    s = (ranked(sizes, _by_name()).withColumn("weight", w)
         .withColumn("cap", F.lit(max_repeat) * F.col("source_size")))
    s = ranked(s.drop("place"), [(F.col("cap") / F.col("weight")).asc(), *_by_name()], ["cap", "weight"])
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, all_weights = F.lit(whole["size"]).cast("long"), F.lit(whole["weight"]).cast("long")
    s = written(s.withColumn("capped", F.col("cap").cast("double") * (all_weights - F.col("weight_before"))
                             <= (total - F.col("cap_before")).cast("double") * F.col("weight")), "mix-capped")
    sums = s.groupBy("capped").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).collect()
    full = sum(r["cap"] for r in sums if r["capped"])
    open_weight = sum(r["weight"] for r in sums if not r["capped"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        ((total - full) * F.col("weight")).cast("double") / F.lit(open_weight or None).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` fall into ``draws``, by inversion.

    The weights are built outwards from the mode by the ratio of neighbouring
    probabilities, over the support within 12 standard deviations.
    """
    t, g, d = (x.cast("double") for x in (total, good, draws))
    lo = F.greatest(F.lit(0.0), d + g - t)
    hi = F.least(g, d)
    mode = F.least(hi, F.greatest(lo, F.floor((d + 1) * (g + 1) / (t + 2)).cast("double")))
    var = d * g * (t - g) * (t - d) / F.greatest(t * t * (t - 1), F.lit(1.0))
    reach = F.ceil(12 * F.sqrt(var)).cast("double") + 2
    first, last = F.greatest(lo, mode - reach), F.least(hi, mode + reach)

    def ratio(k):   # p(k + 1) / p(k)
        return (g - k) * (d - k) / ((k + 1) * (t - g - d + k + 1))

    def walk(stop, step):
        count = F.greatest(F.lit(0), F.abs(stop - mode).cast("int"))
        steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        start = F.array(F.struct(mode.alias("k"), F.lit(1.0).alias("p")))

        def add(acc, i):
            k, p = F.element_at(acc, -1)["k"], F.element_at(acc, -1)["p"]
            nk = k + step
            np_ = p * ratio(k) if step > 0 else p / ratio(nk)
            return F.concat(acc, F.array(F.struct(nk.alias("k"), np_.alias("p"))))
        return F.aggregate(steps, start, add)

    up = walk(last, 1)
    down = walk(first, -1)
    cells = F.concat(F.reverse(F.slice(down, 2, F.greatest(F.size(down) - 1, F.lit(0)))), up)

    def draw(c):
        mass = F.aggregate(c, F.lit(0.0), lambda a, x: a + x["p"])
        return F.transform(F.array(mass), lambda m: F.aggregate(
            c, F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("k")),
            lambda a, x: F.struct((a["sum"] + x["p"]).alias("sum"),
                                  F.when((a["k"] < 0) & (a["sum"] + x["p"] >= u * m), x["k"])
                                  .otherwise(a["k"]).alias("k")),
            lambda a: F.when(a["k"] < 0, last).otherwise(a["k"])))[0]
    return F.transform(F.array(cells), draw)[0].cast("long")


def _deal(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """(held, given) -> (id, name, leaves array<long>): the quotas of each member at every leaf.

    A row holds the members (id, label, name, q) of one group.  A node deals its
    members' quotas to two children by sequential draws; the left child gets half
    of them or, where ``given`` has the group's own quotas by leaf, what those say.
    Uniforms are hashes of (seed, node, label).
    """
    nodes, width = rows.withColumn("node", F.lit(1).cast("long")), 1
    while width < shards:
        total = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        half = shards // (2 * width)    # leaves of a child
        told = F.aggregate(F.slice("given", ((F.col("node") - width) * (2 * half) + 1).cast("int"), half),
                           F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.withColumn("total", total).withColumn(
            "want", F.coalesce(told, F.floor(F.col("total") / 2).cast("long")))

        def deal(a, x):
            named = F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string"), x["label"])
            u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
            k = _hypergeometric(a["rest"], x["q"], a["want"], u)
            return F.transform(F.array(k), lambda got: F.struct(
                (a["rest"] - x["q"]).alias("rest"), (a["want"] - got).alias("want"),
                F.concat(a["out"], F.array(got)).alias("out")))[0]
        left = F.aggregate("held", F.struct(
            F.col("total").alias("rest"), F.col("want"), F.array().cast("array<bigint>").alias("out")),
            deal, lambda a: a["out"])
        nodes = nodes.withColumn("left", F.explode(F.array(left)))   # a generator: evaluated once
        kids = F.array(*[F.struct(
            (F.col("node") * 2 + side).alias("node"),
            F.zip_with("held", "left", lambda h, k: F.struct(
                h["id"].alias("id"), h["label"].alias("label"), h["name"].alias("name"),
                (k if side == 0 else h["q"] - k).alias("q"))).alias("held")) for side in (0, 1)])
        nodes = nodes.select("given", F.explode(kids).alias("kid")).select("given", "kid.*")
        width *= 2
    leaves = nodes.select("node", F.explode("held").alias("h"))
    return (leaves.groupBy(F.col("h.id").alias("id"), F.col("h.name").alias("name"))
            .agg(F.sort_array(F.collect_list(F.struct("node", F.col("h.q").alias("q")))).alias("by"))
            .select("id", "name", F.transform("by", lambda x: x["q"]).alias("leaves")))


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(source, blocks) -> (source, ends array<long>): cumulative quota after each shard.

    ``group`` neighbouring sources form a group, as many groups a group of the next
    level, up to one.  The top is dealt first; then each group deals what it got to its
    members (a multivariate hypergeometric draw, taken in two steps), so a row holds
    at most ``group`` quotas.  Reruns draw the same numbers.  Runs jobs when called.
    """
    place = ranked(quotas, _by_name())
    levels = [written(place.select(
        F.col("place").alias("id"), F.col("source").alias("name"), F.col("blocks").cast("long").alias("q"),
        F.concat_ws("|", F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))).alias("label")),
        "mix-level")]
    upper = F.floor(F.col("id") / group).cast("long")
    while levels[-1].where(F.col("id") >= group).limit(1).count():
        levels.append(written(levels[-1].groupBy(upper.alias("id")).agg(F.sum("q").alias("q")).select(
            "id", F.lit(None).cast("string").alias("name"), "q",
            F.concat_ws("|", F.lit("group"), F.lit(str(len(levels))), F.col("id").cast("string")).alias("label")),
            "mix-level"))
    none = F.lit(None).cast("array<bigint>").alias("given")
    given = None
    for level in reversed(levels):
        rows = level.groupBy(upper.alias("of")).agg(F.sort_array(F.collect_list(
            F.struct("id", "label", "name", "q"))).alias("held"))
        rows = rows.select("held", none) if given is None else (
            rows.join(given.select(F.col("id").alias("of"), F.col("leaves").alias("given")), "of").select("held", "given"))
        given = written(_deal(rows, shards, seed), "mix-dealt")
    return given.select(F.col("name").alias("source"), F.transform("leaves", lambda x, i: F.aggregate(
        F.slice("leaves", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y)).alias("ends"))


def mix_plan(measured: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT,
             shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row a source: source_size, target, full passes, cutoff key, shard ends.

    ``measured`` has (source, key, size).  Sums are combined before any
    shuffle; only the boundary bucket of each source (1/4096 of its keys) is
    put in order.
    """
    bucket = F.substring("key", 1, BUCKET_HEX)
    cells = written(measured.groupBy("source", bucket.alias("bucket"))
                    .agg(F.sum("size").alias("words")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = source_targets(sizes, weights, max_repeat)
    passes = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("passes", passes).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size"))
    goals = written(goals, "mix-goals")
    small = bounded(goals, MAX_SOURCES)
    before = (Window.partitionBy("source").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    edge = (cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
            .join(small.withColumnRenamed("source", "name").select("name", "rest"),
                  F.col("source").eqNullSafe(F.col("name")))
            .where(F.col("before") < F.col("rest"))
            .groupBy("source").agg(F.max(F.struct("bucket", "before", "rest")).alias("e"))
            .select(F.col("source").alias("name"), F.col("e.bucket").alias("edge"),
                    F.col("e.before").alias("before"), F.col("e.rest").alias("rest")))
    edge = written(edge, "mix-edge")
    run = (Window.partitionBy("source").orderBy("key", "size")
           .rowsBetween(Window.unboundedPreceding, -1))
    last = (measured.join(bounded(edge, MAX_SOURCES), F.col("source").eqNullSafe(F.col("name"))
                          & (F.substring("key", 1, BUCKET_HEX) == F.col("edge")))
            .withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
            .where(F.col("at") + F.col("size") / 2.0 < F.col("rest"))
            .groupBy(F.col("name").alias("of")).agg(F.max("key").alias("last_key")))
    plan = (goals.join(edge.select("name", "edge"), F.col("source").eqNullSafe(F.col("name")), "left")
            .drop("name").join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
            .withColumn("cutoff", F.coalesce("last_key", "edge", F.lit(""))))
    per_pass = 16 ** BLOCK_HEX
    partial = F.when(F.col("cutoff") == "", 0).otherwise(
        F.conv(F.rpad(F.substring("cutoff", 1, BLOCK_HEX), BLOCK_HEX, "0"), 16, 10).cast("long") + 1)
    plan = written(plan.withColumn("blocks", F.col("passes") * per_pass + partial), "mix-plan")
    ends = splitting_tree(plan.select("source", "blocks"), shards, seed)
    return written(plan.join(ends.withColumnRenamed("source", "of"),
                             F.col("source").eqNullSafe(F.col("of")))
                   .select("source", "source_size", "target", "passes", "cutoff", "ends"), "mix-shards")


def assign(keyed: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and copies array<struct<copy, shard, place>>.

    ``keyed`` needs (source, key); a row takes part in every full pass, and
    once more if its key is at most its source's cutoff.
    """
    per_pass = 16 ** BLOCK_HEX
    of = "__of"
    while of in keyed.columns:
        of += "_"
    p = bounded(plan.withColumnRenamed("source", of), MAX_SOURCES)
    block0 = F.conv(F.substring("key", 1, BLOCK_HEX), 16, 10).cast("long")
    taken = (F.col("passes") + (F.col("key") <= F.col("cutoff")).cast("long")).cast("int")
    passes = F.when(taken > 0, F.sequence(F.lit(0), taken - 1)).otherwise(F.array().cast("array<int>"))
    copies = F.transform(passes, lambda e: F.struct(
        e.alias("copy"),
        F.size(F.filter("ends", lambda x: x <= e * F.lit(per_pass) + block0)).alias("shard"),
        F.xxhash64(F.lit(seed), F.col("key"), e).alias("place")))
    return (keyed.join(p, F.col("source").eqNullSafe(F.col(of)))
            .withColumn("copies", copies).drop(of, "passes", "cutoff", "ends"))


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, key, size) of every row, written once."""
    return written(docs.select("doc_id", "source", mix_key(seed).alias("key"),
                               word_size(text_or_empty()).alias("size")), "mix-sizes")


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT,
                  shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` repeated as drawn, all columns kept.

    Defined results: null and empty texts have size 0 and ride along with
    every full pass; a null source is a source of its own (last in the order);
    rows equal in id and text share a key and are taken alike; an empty table
    gives an empty mix.  Columns other than doc_id, text and source are
    carried untouched.  Rows of a shard come out in the order of a keyed hash.
    """
    plan = mix_plan(measure(docs, seed), weights, max_repeat, shards, seed)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col("source"), mix_key(seed).alias("key"))
    out = assign(keyed, plan, seed).select("row", F.explode("copies").alias("c"))
    # rows of a shard are spread over several tasks by their place, so a shard has no size limit
    return (out.repartition("c.shard", F.pmod(F.col("c.place"), F.lit(8)))
            .sortWithinPartitions("c.shard", "c.place").select("row.*"))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the output shard of each of its copies."""
    measured = measure(table(spark, sf_dir, "documents"))
    got = assign(measured, mix_plan(measured))
    return got.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.size("copies")).cast("long").alias("taken"),
                      F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",").alias("shards"))


def _oracle() -> str:
    """The mix in SQL, the splitting tree included: a recursive query, a level a step."""
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    # h: total t, good g, draws d; then bounds, mode and the cells outwards from it
    bounds = "{'lo': greatest(0.0::DOUBLE, h.d + h.g - h.t), 'hi': least(h.g, h.d)}"
    mode = ("{'lo': s.lo, 'hi': s.hi, 'm': least(s.hi, greatest(s.lo, floor((h.d + 1) * (h.g + 1) / (h.t + 2)))), 'reach': "
            "ceil(12 * sqrt(h.d * h.g * (h.t - h.g) * (h.t - h.d) / greatest(h.t * h.t * (h.t - 1), 1.0::DOUBLE))) + 2}")
    ends = "{'m': s.m, 'a': greatest(s.lo, s.m - s.reach), 'b': least(s.hi, s.m + s.reach)}"
    ratio = lambda k: f"((h.g - ({k})) * (h.d - ({k})) / ((({k}) + 1) * (h.t - h.g - h.d + ({k}) + 1)))"
    start = "[{'k': e.m, 'p': 1.0::DOUBLE}]"
    up = (f"list_reduce(range(1, CAST(e.b - e.m AS BIGINT) + 1), lambda c, i: list_append(c, "
          f"{{'k': c[-1].k + 1, 'p': c[-1].p * {ratio('c[-1].k')}}}), {start})")
    down = (f"list_reduce(range(1, CAST(e.m - e.a AS BIGINT) + 1), lambda c, i: list_append(c, "
            f"{{'k': c[-1].k - 1, 'p': c[-1].p / {ratio('c[-1].k - 1')}}}), {start})")
    cells = f"list_concat(list_reverse(({down})[2:]), {up})"
    mass = "list_reduce(c, lambda a, x: a + x.p, 0.0::DOUBLE)"
    pick = ("list_reduce(c, lambda a, x: {'sum': a.sum + x.p, 'k': CASE WHEN a.k < 0 AND a.sum + x.p >= h.u * mass THEN x.k ELSE a.k END}, "
            "{'sum': 0.0::DOUBLE, 'k': -1.0::DOUBLE}).k")
    drawn = let(bounds, "s", let(mode, "s", let(ends, "e", let(cells, "c", let(mass, "mass", let(
        pick, "k", "CAST(CASE WHEN k < 0 THEN e.b ELSE k END AS BIGINT)"))))))
    step = let("{'t': a.rest::DOUBLE, 'g': x.q::DOUBLE, 'd': a.want::DOUBLE, 'u': x.u}", "h", let(
        drawn, "got", "{'rest': a.rest - x.q, 'want': a.want - got, 'out': list_append(a.out, got)}"))
    total = "list_sum(list_transform(held, lambda x: x.q))::BIGINT"
    levels = SHARDS.bit_length() - 1
    per_pass = 16 ** BLOCK_HEX
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), 'null'),
        md5(coalesce(text, '')))) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left, sum(source_size) OVER () AS total
    FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * weight_left <= (total - cap_before) * weight AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST((total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) * weight AS DOUBLE)
    / CAST(sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
o AS (SELECT d.*, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
bk AS (SELECT source, substr(key, 1, {BUCKET_HEX}) AS bucket, min(before) AS before, any_value(rest) AS rest FROM o GROUP BY ALL),
ed AS (SELECT source, max(bucket) AS edge FROM bk WHERE before < rest GROUP BY source),
k AS (SELECT ed.source, coalesce(max(key) FILTER (WHERE before + size / 2.0 < rest), any_value(edge)) AS cutoff
    FROM ed JOIN o ON o.source IS NOT DISTINCT FROM ed.source AND substr(key, 1, {BUCKET_HEX}) = edge GROUP BY ed.source),
q AS (SELECT g.source, passes * {per_pass} + CASE WHEN cutoff IS NULL THEN 0
    ELSE CAST('0x' || substr(cutoff, 1, {BLOCK_HEX}) AS BIGINT) + 1 END AS blocks
    FROM g LEFT JOIN k ON g.source IS NOT DISTINCT FROM k.source),
tree(level, node, held) AS (
    SELECT 0, 1::BIGINT, list({{'none': source IS NULL, 'name': source, 'q': blocks::BIGINT}} ORDER BY source NULLS LAST) FROM q
    UNION ALL
    SELECT level + 1, node * 2 + side, list_transform(held, lambda h, i: {{'none': h.none, 'name': h.name,
            'q': CASE side WHEN 0 THEN lefts[i] ELSE h.q - lefts[i] END}})
    FROM (SELECT level, node, held, list_reduce(list_transform(held, lambda x: {{'q': x.q, 'u': (CAST('0x' || substr(md5(
                concat_ws('|', '{SEED}', CAST(node AS VARCHAR), CAST(x.none AS VARCHAR), coalesce(x.name, ''))), 1, 13) AS BIGINT)
                + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE}}),
            lambda a, x: {step}, {{'rest': {total}, 'want': {total} // 2, 'out': []::BIGINT[]}}).out AS lefts
        FROM tree WHERE level < {levels}) AS n, (VALUES (0), (1)) AS v(side)),
leaf AS (SELECT node - {SHARDS} AS shard, unnest(held) AS h FROM tree WHERE level = {levels}),
ends AS (SELECT h.name AS source, list(CAST(e AS BIGINT) ORDER BY shard) AS ends FROM (
    SELECT shard, h, sum(h.q) OVER (PARTITION BY h.name, h.none ORDER BY shard) AS e FROM leaf) GROUP BY h.name, h.none)
SELECT o.doc_id, o.size, o.source_size, o.target,
    CAST(o.size * (o.passes + CASE WHEN o.key <= k.cutoff THEN 1 ELSE 0 END) AS BIGINT) AS taken,
    coalesce(array_to_string(list_transform(range(0, o.passes + CASE WHEN o.key <= k.cutoff THEN 1 ELSE 0 END), lambda e: len(list_filter(
        ends.ends, lambda x: x <= e * {per_pass} + CAST('0x' || substr(o.key, 1, {BLOCK_HEX}) AS BIGINT)))), ','), '') AS shards
FROM o LEFT JOIN k ON o.source IS NOT DISTINCT FROM k.source JOIN ends ON o.source IS NOT DISTINCT FROM ends.source
"""


ORACLE = _oracle()

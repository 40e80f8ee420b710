"""Conversation prefix trie, built as a z-fast trie in batches.

A conversation is a sequence of turns; the prefix of its first d turns is named by a
128-bit chained hash.  The trie is kept compacted: a node is a prefix where
conversations part or end (its extent), and its edge runs from its parent's
extent down to its own; the node knows the hashes along its path.  Each node stands
in a dictionary under its handle: the prefix whose length is the two-fattest number
between the parent's depth (excluded) and its own, the one divisible by the largest
power of two.

A batch is inserted in four steps, each over all its conversations at once:

1. *Locate.*  Fat binary search: every conversation halves the range of depths that
   is open to it by probing the dictionary with one prefix hash, an equi-join a step;
   about log2(longest conversation) joins reach the deepest node above its exit.
2. *Exit node.*  The edge below that starts with the conversation's next prefix is
   found by one more equi-join, and the depth where the two part is read off it.
3. *Insert.*  Of the conversations that leave the trie at one place with one next
   prefix, a random one is inserted.  Edges are cut at all places of the batch at once.
4. The others are the next batch, and search on from the place they have reached.

At each place the others follow one random member, so the number of batches grows
with the logarithm of a branching chain's length, not with the length itself.

Statistics belong to compacted nodes: each node adds its own members, leaf flag and
bytes to the nodes above it, which its path hashes name.  Values along an edge follow
from those of its node; the edges are then expanded into one row a depth.

Scale: what travels is 24 bytes a turn, never text.  Equal conversations are one
entry with a count, so a common conversation costs its id list only; that list is
hashed in blocks of bounded size.  Joins at a common prefix are between one node and
many conversations, which Spark splits; sums are combined before they are shuffled.
A conversation's hashes must fit in a row (a million turns take 24 MB).  Every batch
is written to the shared checkpoint folder.

Defined results: a null turn number comes first, equal ones stand by the hash of role
and text; null roles and texts count as empty; repeated rows are turns of their own; rows
without a conv_id belong to no conversation and make no node; an empty table gives an
empty table; other columns of the caller do not enter the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm.common import table, text_or_empty, written

ROOT = hashlib.blake2b(b"", digest_size=16).digest()
#: Ids of equal conversations that are hashed as one piece.
BLOCK_IDS = 1000
#: Turns that one batch of a Python task returns, a conversation at least.
BATCH_TURNS = 50_000

_SEQUENCES = "conv_id long, cls binary, size int, keys array<binary>, upto array<long>"
_NODES = "node binary, depth int, parent binary, above int, path array<binary>, upto array<long>"


# -- sequences ---------------------------------------------------------------

def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests and text sizes."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text).cast("binary"), 256), 1, 32)
    row = F.struct("turn", F.unhex(digest).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return (turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id")
            .agg(F.transform(F.sort_array(F.collect_list(row)), lambda t: F.struct(t["digest"], t["n_bytes"])).alias("turns")))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chained prefix hashes and summed bytes of each conversation."""
    def flush() -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=["conv_id", "cls", "size", "keys", "upto"])

    for batch in batches:
        rows, held = [], 0
        for conv, turns in zip(batch.column("conv_id"), batch.column("turns"), strict=True):
            key, total, keys, upto = ROOT, 0, [], []
            for digest, n in zip(turns.values.field(0).to_pylist(), turns.values.field(1).to_pylist(), strict=True):
                key = hashlib.blake2b(key + digest, digest_size=16).digest()
                total += n
                keys.append(key)
                upto.append(total)
            rows.append((conv.as_py(), key, len(keys), keys, upto))
            held += len(keys)
            if held >= BATCH_TURNS:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()


def sequences(lists: DataFrame) -> DataFrame:
    """(conv_id, cls, size, keys, upto) of (conv_id, turns): ``cls`` names the whole sequence,
    ``keys`` its prefixes, ``upto`` has their bytes."""
    return lists.select("conv_id", "turns").mapInArrow(_chain, _SEQUENCES)


# -- the compacted trie ------------------------------------------------------

def fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the largest power of two divides (low < high)."""
    top = f"length(bin(CAST({low} ^ {high} AS BIGINT))) - 1"
    return F.expr(f"CAST(CAST({high} AS BIGINT) & shiftleft(CAST(-1 AS BIGINT), {top}) AS INT)")


def _never() -> Column:
    """A key that no node has, another one for each conversation: no hot key of nulls."""
    return F.concat(F.col("cls"), F.lit(b"\0"))


def locate(active: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Fat binary search for the deepest node whose extent starts the conversation.

    ``active`` has (cls, size, keys, low); the depth of that node replaces ``low``, the
    depth of a node known to start it.  One equi-join with the handles a step.
    """
    book = nodes.where(F.col("depth") > 0).select(
        F.get("path", fattest("above", "depth") - 1).alias("handle"), F.col("node").alias("h_node"),
        F.col("depth").alias("h_depth"), F.col("above").alias("h_above"))
    found = active.withColumn("high", F.col("size"))
    for _ in range(steps):
        open_ = F.col("low") < F.col("high")
        found = found.withColumn("f", F.when(open_, fattest("low", "high")))
        found = (found.withColumn("probe", F.when(open_, F.get("keys", F.col("f") - 1)).otherwise(_never()))
                 .join(book, F.col("probe") == F.col("handle"), "left"))
        hit = F.col("h_node").isNotNull()
        passes = hit & F.coalesce(F.get("keys", F.col("h_depth") - 1) == F.col("h_node"), F.lit(False))
        # a handle that is hit while the extent is no prefix belongs to the exit node: its parent is the one
        found = found.select(
            "cls", "size", "keys",
            F.when(passes, F.col("h_depth")).when(hit, F.col("h_above")).otherwise(F.col("low")).alias("low"),
            F.when(~open_ | passes, F.col("high")).when(hit, F.col("h_above")).otherwise(F.col("f") - 1).alias("high"))
    return found.drop("high")


def exits(located: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, exit, at, place): where each conversation leaves the trie.

    ``exit`` is the node on whose edge it does (null: none), ``at`` the depth of the
    last shared prefix, ``place`` the first prefix that is not shared, or its end.
    """
    edges = nodes.where(F.col("depth") > 0).select(
        F.get("path", F.col("above")).alias("name"), F.col("node").alias("exit"),
        F.slice("path", F.col("above") + 1, F.col("depth") - F.col("above")).alias("edge"))
    met = (located.withColumn("next", F.coalesce(F.get("keys", F.col("low")), _never()))
           .join(edges, F.col("next") == F.col("name"), "left"))
    # prefixes of two sequences agree up to one depth and nowhere below it
    shared = F.size(F.filter("edge", lambda k, i: k == F.get("keys", F.col("low") + i)))
    at = F.col("low") + F.when(F.col("exit").isNull(), 0).otherwise(shared)
    met = met.select("cls", "exit", at.cast("int").alias("at"), "keys")
    return met.select("cls", "exit", "at", F.coalesce(F.get("keys", F.col("at")), F.concat(F.lit(b"."), F.col("cls"))).alias("place"))


def _prefix(path: str, depth: Column) -> Column:
    return F.when(depth == 0, F.lit(ROOT)).otherwise(F.get(path, depth - 1))


def insert(nodes: DataFrame, winners: DataFrame) -> DataFrame:
    """The trie with winners (cls, size, keys, upto, exit, at): edges cut, leaves added."""
    cuts = winners.where(F.col("exit").isNotNull()).groupBy("exit").agg(F.collect_set("at").alias("cuts"))
    met = nodes.join(cuts, nodes["node"] == cuts["exit"], "left")
    met = met.withColumn("stops", F.array_sort(F.array_distinct(
        F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("depth")))))
    span = F.transform("stops", lambda s, i: F.struct(
        F.when(i == 0, F.col("above")).otherwise(F.get("stops", i - 1)).alias("start"), s.alias("stop")))
    start, stop = F.col("piece.start"), F.col("piece.stop")
    pieces = met.withColumn("piece", F.explode(span)).select(
        _prefix("path", stop).alias("node"), stop.alias("depth"),
        F.when(stop > 0, _prefix("path", start)).alias("parent"), start.alias("above"),
        F.slice("path", F.lit(1), stop).alias("path"), F.slice("upto", F.lit(1), stop).alias("upto"))
    leaves = winners.where(F.col("at") < F.col("size")).select(
        F.col("cls").alias("node"), F.col("size").alias("depth"), _prefix("keys", F.col("at")).alias("parent"),
        F.col("at").alias("above"), F.col("keys").alias("path"), "upto")
    return pieces.unionByName(leaves)


def build(classes: DataFrame) -> DataFrame:
    """The compacted trie of distinct sequences (cls, size, keys, upto).

    Nodes (node, depth, parent, above, path, upto): ``above`` is the parent's depth,
    ``path`` the prefix hashes down to the node, ``upto`` their bytes.  Runs jobs when
    called, a batch at a time.
    """
    nodes = classes.sparkSession.createDataFrame([(bytearray(ROOT), 0, None, 0, [], [])], _NODES)
    active = classes.where(F.col("size") > 0).select("cls", "size", "keys", F.lit(0).alias("low"))
    steps = 0    # nothing to search in a trie that is only a root
    while True:
        left = written(exits(locate(active, nodes, steps), nodes), "trie-exits")
        chosen = written(left.groupBy("place").agg(F.min(F.struct(F.xxhash64("cls").alias("h"), "cls"))["cls"].alias("cls"))
                         .select("cls"), "trie-batch")
        winners = chosen.join(left, "cls").join(classes, "cls")
        nodes = written(insert(nodes, winners), "trie-nodes")
        rest = left.join(chosen, "cls", "left_anti").select("cls", F.col("at").alias("low"))
        active = written(rest.join(classes, "cls").select("cls", "size", "keys", "low"), "trie-active")
        widest = active.agg(F.max(F.col("size") - F.col("low"))).first()[0]
        if widest is None:
            return nodes
        steps = int(widest).bit_length() + 1    # the open range is halved from the second probe on


# -- statistics and expansion ------------------------------------------------

def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's ids; rows come by (cls, block), and a list may span batches."""
    def out(names: list, hashes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends"])

    held, digest = None, hashlib.sha256()
    for batch in batches:
        names, hashes = [], []
        for cls, ids in zip(batch.column("cls"), batch.column("ids"), strict=True):
            cls = cls.as_py()
            if cls == held:
                digest.update(b",")
            else:
                if held is not None:
                    names.append(held)
                    hashes.append(digest.hexdigest())
                held, digest = cls, hashlib.sha256()
            digest.update(ids.as_py().encode())
        yield out(names, hashes)
    if held is not None:
        yield out([held], [digest.hexdigest()])


def hash_members(members: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids of (cls, conv_id), ascending and comma-joined.

    Close ids are joined to pieces first, so the one task that hashes a long list
    (a hash has an order) reads few rows and holds one batch of them.
    """
    block = F.floor(F.col("conv_id") / BLOCK_IDS).alias("block")
    joined = members.groupBy("cls", block).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return (joined.repartition("cls").sortWithinPartitions("cls", "block")
            .select("cls", "ids").mapInArrow(_hash_lists, "node binary, ends string"))


def totals(nodes: DataFrame) -> DataFrame:
    """(node, conv_id, n_convs, n_leaves, once, each) of (node, depth, above, path, upto, n_own, first_own, leaf):
    sums over each subtree, ``once`` of edge bytes and ``each`` of the bytes of all members from the root on.

    Every node adds to itself and all nodes above; sums are combined before the shuffle.
    """
    total = _total(F.col("depth"))
    own = nodes.select(
        F.explode(F.concat(F.array(F.lit(ROOT)), "path")).alias("node"), "first_own", "n_own", "leaf",
        (total - _total(F.col("above"))).alias("once"), (F.col("n_own") * total).alias("each"))
    return (own.groupBy("node").agg(F.min("first_own").alias("conv_id"), *[F.sum(c).alias(n) for c, n in (
        ("n_own", "n_convs"), ("leaf", "n_leaves"), ("once", "once"), ("each", "each"))])
        .where(F.col("n_convs") > 0)    # without a conversation there is not even a root
        .join(nodes.select("node"), "node", "left_semi"))


def _total(depth: Column) -> Column:
    """Bytes of the turns down to ``depth``."""
    return F.when(depth > 0, F.get("upto", depth - 1)).otherwise(F.lit(0).cast("long"))


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row a node of the expanded trie of (conv_id, cls, size, keys, upto).  Runs jobs when called."""
    members = written(seqs, "trie-members")
    groups = members.groupBy("cls").agg(F.count("*").alias("n_own"), F.min("conv_id").alias("conv_id"))
    classes = written(groups.join(members.drop("cls"), "conv_id"), "trie-classes")
    nodes = build(classes)
    children = (nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node"))
                .agg(F.count("*").alias("n_children")))
    known = written(
        nodes.join(children, "node", "left")
        .join(classes.select(F.col("cls").alias("node"), "n_own", F.col("conv_id").alias("first_own")), "node", "left")
        .withColumns({"n_own": F.coalesce("n_own", F.lit(0)), "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0)}),
        "trie-known")
    sums = written(totals(known), "trie-sums")
    above = sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("above_conv_id"))
    edges = (known.select("node", "parent", "depth", "above", "upto", "n_children").join(sums, "node")
             .join(hash_members(members), "node", "left").join(above, "parent", "left"))
    rows = edges.withColumn("at", F.explode(F.sequence(F.least(F.col("above") + 1, F.col("depth")), F.col("depth"))))
    last, before = F.col("at") == F.col("depth"), _total(F.col("at") - 1)
    each = F.col("each") - F.col("n_convs") * before
    once = F.col("once") - F.when(F.col("at") > 0, before - _total(F.col("above"))).otherwise(0)
    return rows.select(
        "conv_id", F.col("at").cast("long").alias("depth"),
        F.when(F.col("at") > F.col("above") + 1, F.col("conv_id")).otherwise(F.col("above_conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        "n_leaves", (each - once).alias("saved_tokens"),
        F.when(last, F.col("ends")).alias("ends"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of another one."""
    own = written(turn_lists(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "trie-turns")
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    heads = own.where(F.col("conv_id") % 5 == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", F.lit(1), F.lit(8)).alias("head"))
    rebuilt = own.join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    none = F.slice("turns", F.lit(1), F.lit(0))
    rebuilt = rebuilt.select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
        F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    trie = prefix_trie(sequences(rebuilt))
    return trie.withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest()))).drop("ends")


ORACLE = """
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(CAST(length(role) AS VARCHAR) || ':' || role || ':' || text)) AS pos FROM c),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM c),
crc(conv_id, s, k, bit, x) AS (SELECT conv_id, s, 0, 8, 4294967295::BIGINT FROM ids
    UNION ALL SELECT conv_id, s, CASE WHEN bit = 8 THEN k + 1 ELSE k END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
    CASE WHEN bit = 8 THEN xor(x, ascii(substr(s, k + 1, 1))::BIGINT)
        WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
    FROM crc WHERE NOT (bit = 8 AND k = length(s))),
h AS (SELECT conv_id, xor(x, 4294967295) % 9 AS h FROM crc WHERE bit = 8 AND k = length(s)),
r AS (SELECT h.conv_id, 0 AS part, o.pos, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.pos <= h.h
    UNION ALL SELECT h.conv_id, 1, o.pos, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos > h.h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d,
    sha256(sha256(role) || sha256(text)) AS x, strlen(text) AS n_bytes FROM r),
p AS (SELECT a.conv_id, a.d, a.n_bytes, sha256(string_agg(b.x, ',' ORDER BY b.d)) AS node
    FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.d <= a.d GROUP BY ALL
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM h),
e AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
n AS (SELECT node, p.d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (e.d = p.d), '')) AS ends_sha256
    FROM p JOIN (SELECT conv_id AS own, d FROM e) AS e ON own = conv_id GROUP BY node, p.d),
up AS (SELECT n.node, a.node AS parent, a.conv_id AS parent_conv_id
    FROM n JOIN p ON p.conv_id = n.conv_id AND p.d = n.d - 1 JOIN n AS a ON a.node = p.node),
k AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
s AS (SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved
    FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN k ON k.node = n.node GROUP BY p.node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
    n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM n LEFT JOIN up ON up.node = n.node LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node
"""

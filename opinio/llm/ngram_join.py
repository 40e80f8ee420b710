"""N-gram Jaccard self-join by MinHash banding, verified on the full shingle sets.

Shingles are five consecutive words (lower-cased in A-Z, split at ASCII white
space) of the whole text.  Documents with equal shingle sets form a class, and
one representative a class goes on.  Band and row counts are chosen for the
target recall at the similarity threshold.  Representatives are shuffled on
their band hashes; buckets that hold the same members are kept once.  A bucket
is cut into chunks by hash, and each pair of chunks is verified in one small
task on full shingle sets: a pair counts in the first kept bucket that both
share.  A task returns, for each member, how many documents it links to and
the root of its local component, so output stays linear in the members however
large a group is, and no links or sets come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import row_key, table, text_or_empty, written
from opinio.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
CHANCE_AT, CHANCE = 0.3, 0.05   # at most so likely may a pair of this similarity share a band
CHUNK_MEMBERS, CHUNK_SHINGLES = 400, 200_000
PIECE_BYTES = 1 << 20           # text hashed at a time within a worker
SEED = 20240917


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows) with the fewest hashes that reach the recall at the threshold
    while pairs of similarity CHANCE_AT share a band with probability CHANCE at most."""
    best = None
    for rows in range(1, 17):
        for bands in range(1, 257):
            if (1 - (1 - threshold ** rows) ** bands >= recall
                    and 1 - (1 - CHANCE_AT ** rows) ** bands <= CHANCE):
                if best is None or rows * bands < best[0] * best[1]:
                    best = (bands, rows)
                break
    return best or (64, 4)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Shingler:
    """64-bit shingle sets of many texts at once, from their UTF-8 bytes."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self.fold = np.arange(256, dtype=np.uint64)
        self.fold[65:91] += np.uint64(32)
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        base = np.uint64(0x9E3779B97F4A7C15)
        n = PIECE_BYTES + 1
        self.power = np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        self.inverse = np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)]))

    def _word_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start byte, hash) of every word in at most PIECE_BYTES bytes."""
        n = len(data)
        gap = self.space[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            (self.fold[data] + np.uint64(1)) * self.power[:n], dtype=np.uint64)])
        h = (sums[end] - sums[start]) * self.inverse[start]
        return start, _scramble(h + (end - start).astype(np.uint64))

    def _long(self, text: bytes) -> np.ndarray:
        """Word hashes of a text of any length, piece by piece at white space."""
        out, at = [], 0
        while at < len(text):
            stop = min(len(text), at + PIECE_BYTES)
            if stop < len(text):
                cut = max(text.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
                if cut > at:
                    stop = cut + 1
            out.append(self._word_hashes(np.frombuffer(text, np.uint8)[at:stop])[1])
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _set(self, words: np.ndarray) -> np.ndarray:
        if len(words) == 0:
            return words
        k = min(self.width, len(words))
        m = len(words) - k + 1
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = _scramble(h + words[j:j + m])
        return np.unique(h)

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) + 1 <= PIECE_BYTES:
                size += len(texts[j]) + 1
                j += 1
            if j == i:
                yield self._set(self._long(texts[i]))
                i += 1
                continue
            part = texts[i:j]
            start, h = self._word_hashes(np.frombuffer(b" ".join(part), np.uint8))
            begin = np.cumsum([0] + [len(t) + 1 for t in part])
            at = np.searchsorted(start, begin)
            for a, b in zip(at[:-1], at[1:]):
                yield self._set(h[a:b])
            i = j


def _digest(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes())


def signatures(docs: DataFrame, bands: int, rows: int, width: int = SHINGLE) -> DataFrame:
    """(key, doc_id, cls, n, bands): class of the shingle set, its size, a hash a band.

    Texts without a word have a null class.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(width)
        draw = np.random.default_rng(SEED)
        flip = draw.integers(0, 1 << 32, size=(bands * rows, 1), dtype=np.uint64).astype(np.uint32)
        odd = draw.integers(0, 1 << 31, size=(bands * rows, 1), dtype=np.uint64).astype(np.uint32) * 2 + 1
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            texts = [t.encode() for t in b["text"].to_pylist()]
            cls, n, hashes = [], [], []
            for s in shingler.sets(texts):
                if len(s) == 0:
                    cls.append(None), n.append(0), hashes.append(None)
                    continue
                x = (s >> np.uint64(32)).astype(np.uint32)
                low = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
                for i in range(0, len(x), 2048):
                    np.minimum(low, ((x[None, i:i + 2048] ^ flip) * odd).min(axis=1), out=low)
                h = salt.copy()
                for r in range(rows):
                    h = _scramble(h + low[r::rows].astype(np.uint64))
                cls.append(_digest(s)), n.append(len(s)), hashes.append(h.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b["key"], b["doc_id"], pa.array(cls, pa.string()), pa.array(n, pa.int32()),
                 pa.array(hashes, pa.list_(pa.int64()))], ["key", "doc_id", "cls", "n", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("key"), text_or_empty().alias("text")).mapInArrow(
        run, f"key string, doc_id {id_type}, cls string, n int, bands array<bigint>")


def shingle_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Replaces text by shingles (binary, sorted 64-bit hashes)."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(width)
        for b in batches:
            # a long batch is handed on in parts: sets are larger than texts
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [s.tobytes() for s in shingler.sets([t.encode() for t in part["text"].to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [part[f.name] for f in others] + [pa.array(sets, pa.binary())],
                    [f.name for f in others] + ["shingles"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", shingles binary"
    return docs.select(*[f.name for f in others], "text").mapInArrow(run, schema)


def _common(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Sizes of all pairwise intersections, in bounded slices of the shared vocabulary."""
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    vocabulary, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((m, m), dtype=np.float64)
    width = 8192
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [lo, lo + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[owner[a:b], code[a:b] - lo] = 1
        total += x @ x.T
    return total.astype(np.int64)


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of chunks of one bucket: links and local roots of its members."""
    pdf = pdf.sort_values("cls", ignore_index=True)
    m = len(pdf)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    n = np.array([len(s) for s in sets])
    common = _common(sets, m)
    both = common * 5 >= (n[:, None] + n[None, :] - common) * 4     # common / union >= 0.8
    np.fill_diagonal(both, False)
    here, i, j = pdf["h"].iat[0], pdf["i"].iat[0], pdf["j"].iat[0]
    if i != j:      # members of one chunk meet in their own task
        chunk = pdf["chunk"].to_numpy()
        both &= chunk[:, None] != chunk[None, :]
    earlier = sorted({h for hs in pdf["buckets"] for h in hs if h < here})
    if earlier:     # a pair belongs to the first bucket that both share
        at = {h: k for k, h in enumerate(earlier)}
        y = np.zeros((m, len(earlier)), dtype=np.float32)
        for r, hs in enumerate(pdf["buckets"]):
            y[r, [at[h] for h in hs if h < here]] = 1
        both &= (y @ y.T) == 0
    links = both @ pdf["copies"].to_numpy(np.int64)
    root = np.arange(m)
    while True:     # smallest label among the neighbours, then its own label
        near = np.where(both, root[None, :], m).min(axis=1, initial=m)
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    cls = pdf["cls"].to_numpy()
    hit = links > 0
    return pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": cls[root[hit]]})


def ngram_join(docs: DataFrame) -> DataFrame:
    """key, doc_id, class_id, n_links, component_id, cls, component for every row of ``docs``.

    class_id is the smallest doc_id with the same shingle set, n_links the
    number of other rows with Jaccard similarity of 0.8 or more (copies
    included), component_id the smallest doc_id reachable by links.  cls and
    component name the class and the component themselves (null without a word):
    components apart from each other may share a component_id where ids are
    null or repeated.

    Defined results: texts without a word (null, empty, white space) link with
    nothing and are their own class and component; texts under five words have
    the one shingle of all their words; repeated rows are copies of each other;
    null ids come last among a class's ids; an empty table gives an empty
    result; further columns are ignored.  Runs jobs when called.
    """
    bands, rows = choose_bands()
    signed = written(signatures(docs, bands, rows), "ngram-signatures")
    classes = written(signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"),
        F.max("n").alias("n"), F.first("bands").alias("bands")), "ngram-classes")
    places = classes.select("cls", "n", F.explode("bands").alias("h"))
    cell = F.xxhash64("cls")
    buckets = (places.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"),
                                       F.bit_xor(cell).alias("x1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x2"))
               .where(F.col("m") > 1))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK_MEMBERS), F.ceil(F.col("shingles") / CHUNK_SHINGLES),
                        F.lit(1)).cast("int")
    kept = written(buckets.groupBy("m", "shingles", "x1", "x2").agg(F.min("h").alias("h"))
                   .select("h", chunks.alias("chunks")), "ngram-buckets")
    members = (places.join(kept, "h").groupBy("cls")
               .agg(F.collect_list(F.struct("h", "chunks")).alias("at")))   # at most one a band
    members = members.join(classes.select("cls", "key", "copies"), "cls")
    texts = docs.select(row_key().alias("key"), text_or_empty().alias("text"))
    sets = shingle_sets(texts.join(members, "key").dropDuplicates(["cls"])
                        .select("cls", "copies", "at", "text"))
    spread = (sets.select("cls", "copies", "shingles", F.transform("at", lambda x: x["h"]).alias("buckets"),
                          F.explode("at").alias("b"))
              .withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(SEED)), F.col("b.chunks").cast("long")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b.chunks") - 1))))
    tasks = spread.select("cls", "copies", "shingles", "buckets", F.col("b.h").alias("h"), "chunk",
                          F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    found = written(tasks.groupBy("h", "i", "j").applyInPandas(
        _verify, "cls string, links long, root string"), "ngram-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("cls", "root").distinct(), "cls", "root")
    state = (classes.select("cls", "class_id", "copies").join(links, "cls", "left")
             .join(groups.withColumnRenamed("node", "cls"), "cls", "left")
             .select("cls", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "cls").alias("component")))
    lowest = state.groupBy("component").agg(F.min("class_id").alias("component_id"))
    state = state.join(lowest, "component").select("cls", "class_id", "n_links", "component_id", "component")
    out = signed.select("key", "doc_id", "cls").join(state, "cls", "left")
    return out.select("key", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "doc_id").alias("component_id"), "cls", "component")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    with the smallest doc_id (then key) stays; texts without a word all stay."""
    joined = written(ngram_join(docs), "ngram-joined")
    first = (joined.where(F.col("cls").isNotNull()).groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
             .select(F.col("best.key").alias("key")))
    # the caller's row as a struct: none of its columns can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("key"),
                       text_or_empty().rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    chosen = rows.where("worded").join(first, "key", "leftsemi").dropDuplicates(["key"])
    return chosen.unionByName(rows.where("not worded")).select("row.*")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "component_id")


#: Every pair of different shingle sets that share a shingle, on their whole sets: no bands.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) > 0 THEN list_sort(list_distinct(list_transform(
        range(1, greatest(len(words) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')))) END AS shingles
    FROM d),
c AS (SELECT row_number() OVER () AS cid, * FROM (SELECT shingles, len(shingles) AS n, min(doc_id) AS class_id, count(*) AS copies
    FROM s WHERE shingles IS NOT NULL GROUP BY shingles)),
x AS (SELECT cid, n, unnest(shingles) AS shingle FROM c),
p AS (SELECT a.cid AS a, b.cid AS b FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.cid < b.cid
        AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
    GROUP BY a.cid, b.cid, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 4),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(cid, other) AS (SELECT cid, cid FROM c UNION SELECT reach.cid, l.b FROM reach JOIN l ON l.a = reach.other),
k AS (SELECT reach.cid, min(c.class_id) AS component_id FROM reach JOIN c ON c.cid = reach.other GROUP BY reach.cid),
n AS (SELECT l.a AS cid, sum(c.copies) AS links FROM l JOIN c ON c.cid = l.b GROUP BY l.a)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id,
    CAST(coalesce(n.links, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links,
    coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN n ON n.cid = c.cid LEFT JOIN k ON k.cid = c.cid
"""

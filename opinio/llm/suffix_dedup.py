"""Removal of long repeated byte strings by suffix sorting.

A byte goes when some string of ``WIDTH`` bytes that covers it starts at
another place too.  Finding those places:

1.  Each window of WIDTH bytes has an anchor, the gram with the smallest hash
    inside it.  Equal windows have equal anchors, so only the windows of one
    anchor hash need to meet.  The windows of one anchor in one text form a
    span.  Texts that are equal as a whole meet by their hash alone.
2.  Equal spans are counted; anchors with several different spans go on.
3.  The spans of an anchor are sorted as suffixes: Lyndon prefixes are grouped
    from the largest group down along previous-smaller pointers, and a second
    pass emits the order inside each group, in linear time and without
    renaming.  Neighbours that agree in WIDTH bytes are repeats.
    Anchors met in very many different spans (a passage in a third of all
    texts) would make one long task; their windows are counted by hash in a
    grouped sum instead, which gives the same places.
4.  The places go back to all texts that hold the span, and each text is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import row_key, table, text_or_empty, written

WIDTH = 400
GRAM = 100
PIECE = 1 << 20         # window starts handled at a time
MAX_SPANS = 1000        # different spans of an anchor that one suffix sort takes
SORT_BYTES = 1 << 18    # spans of several anchors are sorted together up to this size
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
_UP = bytes([(b + 1) & 255 for b in range(256)])    # UTF-8 has no byte 255; 0 ends a span


class _Anchors:
    def __init__(self, width: int = WIDTH, gram: int = GRAM):
        self.width, self.gram = width, gram
        n = PIECE + width + 1
        self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
        self.inverse = np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)]))
        draw = np.random.default_rng(20240917)
        self.byte = draw.integers(0, 1 << 63, 256, dtype=np.uint64)

    def spans(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(anchor hash, first window, last window, hash of the bytes) in order."""
        out = []
        last = len(text) - self.width
        for at in range(0, last + 1, PIECE):
            stop = min(last + 1, at + PIECE)    # windows at .. stop - 1
            part = np.frombuffer(text, np.uint8)[at:stop - 1 + self.width]
            n, k = len(part), self.gram
            sums = np.concatenate([np.zeros(1, np.uint64),
                                   np.cumsum(self.byte[part] * self.power[:n], dtype=np.uint64)])
            g = (sums[k:] - sums[:-k]) * self.inverse[:n - k + 1]
            g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(32)
            # smallest hash, leftmost place: the place rides in the low bits
            low = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
            need, have = self.width - k + 1, 1
            while have < need:
                step = min(have, need - have)
                low = np.minimum(low[:-step], low[step:])
                have += step
            place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            end = np.append(first[1:], len(place)) - 1
            h = g[place[first]].astype(np.int64)
            for a, lo, hi in zip(h.tolist(), first.tolist(), end.tolist()):
                lo, hi = lo + at, hi + at
                out.append((a, lo, hi, xxhash.xxh3_64_intdigest(text[lo:hi + self.width]) - (1 << 63)))
        return out


def lyndon_pointers(s: bytes) -> tuple[list[int], list[int]]:
    """Next and previous smaller suffix of each place (len(s) and -1 where none)."""
    n = len(s)
    nxt, prv = [n] * n, [-1] * n
    for i in range(n - 2, -1, -1):
        c, j = s[i], i + 1
        while j < n:
            d = s[j]
            if c > d or (c == d and s[i:j] >= s[j:nxt[j]]):
                break
            prv[j] = i
            j = nxt[j]
        nxt[i] = j
    return nxt, prv


def suffix_order(s: bytes) -> list[int]:
    """Suffix array of ``s`` by linear grouping.

    Suffixes start out grouped by their first byte.  The groups are taken from
    the largest down: when a group is taken, its members' Lyndon prefixes are
    known to be equal, and the previous-smaller places that they hang on move
    up, to a new group just above their old one, once for each such member.
    Afterwards every group holds the suffixes of one Lyndon prefix.  The second
    pass walks the order from the smallest suffix and puts each place whose
    next smaller suffix has just been met at the front of its group.
    """
    n = len(s)
    if n == 0:
        return []
    nxt, prv = lyndon_pointers(s)
    data = np.frombuffer(s, np.uint8)
    order = np.argsort(data, kind="stable")
    sa = order.tolist()
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    isa = where.tolist()
    begin = np.searchsorted(data[order], data, side="left")
    group = begin.tolist()                          # first slot of a suffix's group
    size = [0] * n
    for b, c in zip(*np.unique(begin, return_counts=True)):
        size[b] = int(c)
    end = n
    while end:
        lo = group[sa[end - 1]]
        times: dict[int, int] = {}
        for i in sa[lo:end]:
            p = prv[i]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        movers = list(times)
        k = 1
        while movers:
            moved: dict[int, int] = {}
            for p in movers:
                g = group[p]
                m = moved.get(g, 0) + 1
                moved[g] = m
                slot = g + size[g] - m
                at = isa[p]
                other = sa[slot]
                sa[at], sa[slot] = other, p
                isa[other], isa[p] = at, slot
            start = {g: g + size[g] - m for g, m in moved.items()}
            for p in movers:
                group[p] = start[group[p]]
            for g, m in moved.items():
                size[g] -= m
                size[start[g]] = m                  # also where the whole group moved
            k += 1
            movers = [p for p in movers if times[p] >= k]
        end = lo
    out = [0] * n
    front = list(range(n))
    # first the suffixes that have only the end of the text after them, then slot by slot
    for slot in range(-1, n):
        i = out[slot] if slot >= 0 else n
        j = i - 1
        while j >= 0 and nxt[j] == i:
            g = group[j]
            f = front[g]
            out[f] = j
            front[g] = f + 1
            j = prv[j]
    return out


def candidate_runs(spans: list[tuple[bytes, int]], width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(span, first window, last window): windows whose short grams all occur twice or more.

    A window with a gram that no other place has cannot be repeated; this cuts
    away what surrounds a repeat, which differs from text to text.
    """
    gram = min(64, width)
    text = np.frombuffer(b"".join(t.translate(_UP) + b"\0" for t, _ in spans), np.uint8)
    n = len(text)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
    back = np.multiply.accumulate(np.concatenate(
        [np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[text] * power[:n], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * back[:n - gram + 1]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    lone = np.concatenate([[0], np.cumsum(~twice)])
    out, at = [], 0
    for k, (t, windows) in enumerate(spans):
        i = np.arange(at, at + windows)
        ok = np.concatenate([[False], lone[i + width - gram + 1] == lone[i], [False]])
        edge = np.flatnonzero(ok[1:] != ok[:-1])
        out += [(k, a, z - 1) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist())]
        at += len(t) + 1
    return out


def repeated_windows(spans: list[tuple[bytes, int]], groups: list | None = None,
                     width: int = WIDTH) -> list[list[int]]:
    """For (bytes, number of windows) spans: the window starts that occur twice or more.

    Equal candidate runs need no sorting.  The others are sorted as suffixes,
    with one of each set of equal runs, within the groups (anchors) that have
    any run on its own.
    """
    groups = groups or [0] * len(spans)
    out: list[list[int]] = [[] for _ in spans]
    runs_: dict[tuple, list[tuple[int, int, int]]] = {}
    for k, a, z in candidate_runs(spans, width):
        runs_.setdefault((groups[k], spans[k][0][a:z + width]), []).append((k, a, z))
    several: dict = {}
    for (g, _), places in runs_.items():
        n, lone = several.get(g, (0, False))
        several[g] = (n + 1, lone or len(places) == 1)
        if len(places) > 1:
            for k, a, z in places:
                out[k] += range(a, z + 1)
    sort = [(t, places) for (g, t), places in runs_.items() if several[g][0] > 1 and several[g][1]]
    if not sort:
        return out
    text = b"".join(t.translate(_UP) + b"\0" for t, _ in sort)
    owner, base, at = {}, [], 0
    for r, (t, _) in enumerate(sort):
        base.append(at)
        for i in range(len(t) - width + 1):
            owner[at + i] = r
        at += len(t) + 1
    sorted_ = [i for i in suffix_order(text) if i in owner]
    same = [text[i:i + width] == text[j:j + width] for i, j in zip(sorted_, sorted_[1:])]
    for x, i in enumerate(sorted_):
        r = owner[i]
        if len(sort[r][1]) == 1 and ((x and same[x - 1]) or (x < len(same) and same[x])):
            k, a, _ = sort[r][1][0]
            out[k].append(a + i - base[r])
    return out


def runs(starts: list[int], width: int = WIDTH) -> list[tuple[int, int]]:
    """Ranges of bytes covered by the windows at ``starts``."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + width)
        else:
            out.append((s, s + width))
    return out


def scan_anchors(docs: DataFrame) -> DataFrame:
    """(key, doc_id, cls, n, whole, spans): the spans of each text, and its own digests."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors()
        kind = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("d", pa.int64())]))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [t.encode() for t in part["text"].to_pylist()]
                spans = [[dict(zip(("h", "lo", "hi", "d"), x)) for x in anchors.spans(t)] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["doc_id"], pa.array([xxhash.xxh3_128_hexdigest(t) for t in texts]),
                     pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(spans, kind)],
                    ["key", "doc_id", "cls", "n", "whole", "spans"])

    return docs.select(row_key().alias("key"), "doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"key string, doc_id {id_type}, cls string, n bigint, whole string, "
             "spans array<struct<h:bigint,lo:int,hi:int,d:bigint>>")


def cut_spans(texts: DataFrame) -> DataFrame:
    """(text, wanted array<struct<h, d, lo, hi>>) -> (h, d, windows, span), a row a wanted span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                h, d, w, s = [], [], [], []
                for t, wanted in zip(part["text"].to_pylist(), part["wanted"].to_pylist()):
                    raw = t.encode()
                    for x in wanted:
                        h.append(x["h"]), d.append(x["d"]), w.append(x["hi"] - x["lo"] + 1)
                        s.append(raw[x["lo"]:x["hi"] + WIDTH])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(w, pa.int32()),
                     pa.array(s, pa.binary())], ["h", "d", "windows", "span"])

    return texts.select("text", "wanted").mapInArrow(run, "h bigint, d bigint, windows int, span binary")


_FOUND = "h bigint, d bigint, ranges array<struct<lo:int,hi:int>>"
_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def sort_spans(spans: DataFrame) -> DataFrame:
    """(h, d, ranges): bytes of each span that repeated windows cover, by suffix sorting.

    Rows of an anchor lie together; several anchors share one sort, which
    changes nothing, as equal windows have equal anchors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def solve(rows):
            got = repeated_windows([(s, w) for _, _, w, s in rows], [r[0] for r in rows])
            hit = [(r, runs(g)) for r, g in zip(rows, got) if g]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r, _ in hit], pa.int64()), pa.array([r[1] for r, _ in hit], pa.int64()),
                 pa.array([[{"lo": a, "hi": z} for a, z in g] for _, g in hit], _RANGES)],
                ["h", "d", "ranges"])

        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("h", "d", "windows", "span"))):
                if held and r[0] != held[-1][0] and sum(len(x[3]) for x in held) >= SORT_BYTES:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)

    near = spans.repartition("h").sortWithinPartitions("h", "d")
    return near.mapInArrow(run, _FOUND)


def count_windows(spans: DataFrame) -> DataFrame:
    """As sort_spans, for anchors with very many spans: windows counted by their hash."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("h", "d", "windows", "span"))):
                n = r[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0]] * n, pa.int64()), pa.array([r[1]] * n, pa.int64()),
                     pa.array(range(n), pa.int32()),
                     pa.array([xxhash.xxh3_128_digest(r[3][i:i + WIDTH]) for i in range(n)], pa.binary())],
                    ["h", "d", "i", "x"])

    windows = spans.mapInArrow(hashes, "h bigint, d bigint, i int, x binary")
    twice = windows.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("x")
    hit = windows.join(twice, "x", "leftsemi").groupBy("h", "d").agg(F.sort_array(F.collect_list("i")).alias("at"))
    # windows of a span are few (one anchor reaches no further than a window's width)
    merged = F.aggregate("at", F.array().cast("array<struct<lo:int,hi:int>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["hi"] >= s),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(a, F.lit(-1))["lo"].alias("lo"), (s + WIDTH).cast("int").alias("hi")))))
        .otherwise(F.concat(a, F.array(F.struct(s.alias("lo"), (s + WIDTH).cast("int").alias("hi"))))))
    return hit.select("h", "d", merged.alias("ranges"))


def cut_texts(texts: DataFrame) -> DataFrame:
    """(key, text, ranges) -> (key, n_removed, n_spans, kept): the text without its ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                removed, spans, kept = [], [], []
                for t, ranges in zip(part["text"].to_pylist(), part["ranges"].to_pylist()):
                    raw, at, gone, n, out = t.encode(), 0, 0, 0, []
                    for lo, hi in sorted((x["lo"], x["hi"]) for x in ranges):
                        if lo > at or not n:
                            out.append(raw[at:lo])
                            n += 1
                        gone += max(0, hi - max(at, lo))
                        at = max(at, hi)
                    out.append(raw[at:])
                    removed.append(gone), spans.append(n), kept.append(b"".join(out))
                yield pa.RecordBatch.from_arrays(
                    [part["key"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept"])

    return texts.select("key", "text", "ranges").mapInArrow(
        run, "key string, n_removed bigint, n_spans bigint, kept binary")


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    and with ``keep_bytes`` the remaining bytes (null where they are the whole text).

    Defined results: null texts count as empty; texts under WIDTH bytes have
    nothing removed; repeated rows of WIDTH bytes or more lose everything;
    ranges may cut inside a character, so the remainder is bytes; an empty
    table gives an empty result; further columns are ignored.  Runs jobs when
    called.
    """
    scan = written(scan_anchors(docs), "suffix-scan")
    classes = written(scan.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("rep")),
                      "suffix-classes")
    # one text of each class speaks for its copies
    reps = (scan.join(classes.select("rep"), F.col("key") == F.col("rep"), "leftsemi")
            .where(F.size("spans") > 0).dropDuplicates(["cls"]))
    places = written(reps.select("key", F.explode("spans").alias("s")).select("key", "s.*"), "suffix-places")
    spans = places.groupBy("h", "d").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "lo", "hi")).alias("at"))
    anchors = (spans.groupBy("h").agg(F.sum("c").alias("places"), F.count(F.lit(1)).alias("kinds"))
               .where(F.col("places") > 1))
    shared = written(spans.join(anchors, "h").select("h", "d", "c", "kinds", "at.*"), "suffix-shared")
    twice = shared.where(F.col("c") > 1).select("h", "d", F.array(F.struct(
        F.lit(0).alias("lo"), (F.col("hi") - F.col("lo") + WIDTH).cast("int").alias("hi"))).alias("ranges"))
    # all texts that hold such an anchor are needed once or twice from here on
    single = scan.join(classes.where(F.col("copies") == 1).select("rep"), F.col("key") == F.col("rep"), "leftsemi")
    held = places.join(shared.select("h").distinct(), "h", "leftsemi").select("key").distinct()
    text = docs.select(row_key().alias("key"), text_or_empty().alias("text"))
    texts = written(text.join(held, "key", "leftsemi").dropDuplicates(["key"]), "suffix-texts")
    wanted = (shared.where(F.col("kinds") > 1).groupBy("key")
              .agg(F.collect_list(F.struct("h", "d", "lo", "hi", "kinds")).alias("wanted")))    # within one text

    def chosen(test):
        rows = texts.join(wanted, "key").select("text", F.filter("wanted", test).alias("wanted"))
        return cut_spans(rows.where(F.size("wanted") > 0))

    found = (twice.unionByName(sort_spans(chosen(lambda x: x["kinds"] <= MAX_SPANS)))
             .unionByName(count_windows(chosen(lambda x: x["kinds"] > MAX_SPANS))))
    found = written(found, "suffix-found")
    hits = (places.join(found, ["h", "d"])
            .select("key", F.explode(F.transform("ranges", lambda r: F.struct(
                (r["lo"] + F.col("lo")).alias("lo"), (r["hi"] + F.col("lo")).alias("hi")))).alias("r")))
    ranges = hits.groupBy("key").agg(F.collect_set("r").alias("ranges"))    # within one text
    cut = cut_texts(texts.join(ranges, "key"))
    cut = written(cut.withColumn("kept_sha256", F.sha2("kept", 256)) if keep_bytes else
                  cut.select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "suffix-cut")
    nothing = hashlib.sha256(b"").hexdigest()
    rows = scan.select("key", "doc_id", "cls", "n", "whole")
    alone = rows.join(single.select("key"), "key", "leftsemi").join(cut, "key", "left")
    alone = alone.select(
        "doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *([F.col("kept")] if keep_bytes else []))
    copied = rows.join(classes.where(F.col("copies") > 1).select("cls"), "cls", "leftsemi")
    gone = F.col("n") >= WIDTH
    copied = copied.select(
        "doc_id", F.col("n").alias("n_bytes"), F.when(gone, F.col("n")).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.col("whole")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.lit(None)).cast("binary").alias("kept")] if keep_bytes else []))
    return alone.unionByName(copied)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)

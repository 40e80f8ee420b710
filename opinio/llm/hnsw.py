"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors are dealt by label and hash into shards of bounded size, and every
shard gets its own graph, built and stored as one row.  Each block of queries
meets each shard of its label.  A search descends the upper layers and then
keeps a beam of the nearest nodes at the bottom; many queries advance in step.
Beams are widened twice over: for a query that has links, as far as nodes above
the threshold hang together, and for a whole block until a recall audit of
sampled queries against all vectors of the shard passes: they must find their links
and, so that a shard without links is audited too, their nearest vectors.  The lowest
audited recall of a label is returned with its rows.  Links are verified by
cosine in double precision, counted per vector, and only the edges of local
spanning stars leave a task, so output grows with the vectors, not the links.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import table, written
from opinio.llm.components import connected_components

THRESHOLD = 0.98
SHARD_ROWS = 16_384     # vectors of one graph, on average at most
BLOCK_ROWS = 2_048      # queries of one task, on average at most
NEIGHBOURS = 12         # of a node in the upper layers; twice as many at the bottom
BUILD_BEAM = 48
FIRST_BEAM = 32
AUDIT_QUERIES = 64      # of each block and shard
AUDIT_NEAREST = 5       # true nearest vectors that an audited query must find, however far they are
AUDIT_RECALL = 0.99     # of the links of audited queries
NEAREST_RECALL = 0.95   # of their nearest vectors
STEP_ROWS = 256         # queries that advance together
PAGE = 512              # nodes whose cosines with the queries of a step are computed together
AT_ONCE = 8             # a beam follows one of its nodes for each so many of its width, at a time
SEED = 20240917


class Cosines:
    """Cosines of a step's queries with the nodes that its searches meet.

    Nodes are fetched a page at a time, when a search first meets one of the page: a product of
    two matrices costs less than a row of nodes for each query, and is shared by all layers."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray):
        self.v, self.queries = vectors, queries
        self.sim = np.empty((len(queries), len(vectors)), np.float32)
        self.flat = self.sim.ravel()
        self.unmet = np.ones(-(-len(vectors) // PAGE), bool)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        """By place: the query's row times the number of nodes, and the node."""
        if self.unmet.any():
            met = np.bincount(places % len(self.v) // PAGE, minlength=len(self.unmet)) > 0
            for k in np.flatnonzero(met & self.unmet).tolist():
                page = slice(k * PAGE, (k + 1) * PAGE)
                self.sim[:, page] = self.queries @ self.v[page].T
                self.unmet[k] = False
        return self.flat.take(places)


class Graph:
    """One shard: unit vectors and, a layer each, the neighbour table."""

    def __init__(self, vectors: np.ndarray, seed: int = SEED):
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed)
        level = np.minimum((-np.log(draw.random(n) + 1e-12) / math.log(NEIGHBOURS)).astype(int), 6)
        self.level = level
        self.layers: list[np.ndarray] = []
        top = int(level.max()) if n else -1
        for k in range(top + 1):
            self.layers.append(np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32))
        self.incoming = [np.zeros(n, np.int32) for _ in self.layers]    # links to each node
        self.entry = -1
        self.height = -1
        order = draw.permutation(n)
        at = 0
        while at < n:   # batches double: a batch searches the graph of all before it, and itself
            part = order[at:at + max(1, min(STEP_ROWS, at))]
            self._insert(part)
            at += len(part)
        self.both_ways()

    def both_ways(self) -> None:
        """The bottom layer's links in both directions, as one list with a range a node."""
        n = len(self.v)
        table_ = self.layers[0] if self.layers else np.zeros((0, 1), np.int32)
        a, k = np.nonzero(table_ >= 0)
        b = table_[a, k].astype(np.int64)
        pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.ends = (pairs % n).astype(np.int32) if n else pairs
        self.range = np.searchsorted(pairs // max(n, 1), np.arange(n + 1))

    def _beam(self, cosines: Cosines, rows: np.ndarray, start: np.ndarray, layer: int,
              width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of a beam search in one layer, all queries (rows of ``cosines``) in
        step; -1 pads.  A wide beam follows several of its best nodes at a time."""
        table_, n, q = self.layers[layer], len(self.v), len(rows)
        at_once = max(1, width // AT_ONCE)
        base = rows.astype(np.int64) * n        # places of a query's nodes in ``cosines``
        seen = np.zeros(len(cosines.flat), bool)
        ids = np.full((q, width), -1, np.int32)
        sim = np.full((q, width), -np.inf, np.float32)
        done = np.ones((q, width), bool)
        a, k = np.nonzero(start[:, :width] >= 0)
        places = base[a] + start[a, k]
        ids[a, k], sim[a, k], done[a, k] = start[a, k], cosines(places), False
        seen[places] = True
        live = np.arange(q)
        while len(live):
            open_ = np.where(done[live], -np.inf, sim[live])
            pick = (open_.argmax(axis=1)[:, None] if at_once == 1
                    else np.argpartition(open_, width - at_once, axis=1)[:, width - at_once:])
            here = np.take_along_axis(open_, pick, axis=1) > -np.inf
            go = here.any(axis=1)
            live, pick, here = live[go], pick[go], here[go]
            if not len(live):
                break
            done[live[:, None], pick] = True
            a, k = np.nonzero(here)
            near = table_.take(ids[live[a], pick[a, k]], axis=0)
            places = (base[live[a], None] + near)[near >= 0]
            places = places[~seen.take(places)]
            seen[places] = True
            # only what is nearer than the worst of its beam; what stood in several lists once
            worst = np.full(len(cosines.queries), -np.inf, np.float32)
            worst[rows[live]] = sim[live].min(axis=1)
            places = places[cosines(places) > worst.take(places // n)]
            places.sort()
            places = places[np.diff(places, prepend=-1) > 0]
            if not len(places):
                continue
            got = np.searchsorted(places, base[live])
            size = np.append(got[1:], len(places)) - got
            x = np.repeat(np.arange(len(live)), size)
            y = width + np.arange(len(places)) - np.repeat(got, size)
            wide = (len(live), width + int(size.max()))
            all_ids, all_sim, all_done = np.full(wide, -1, np.int32), np.full(wide, -np.inf, np.float32), np.ones(wide, bool)
            all_ids[:, :width], all_sim[:, :width], all_done[:, :width] = ids[live], sim[live], done[live]
            all_ids[x, y], all_sim[x, y], all_done[x, y] = places % n, cosines(places), False
            keep = np.argpartition(all_sim, wide[1] - width, axis=1)[:, wide[1] - width:]
            x = np.arange(len(live))[:, None]
            ids[live], sim[live], done[live] = all_ids[x, keep], all_sim[x, keep], all_done[x, keep]
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)

    def _descend(self, cosines: Cosines, rows: np.ndarray, to: int) -> np.ndarray:
        """Entry nodes for layer ``to``: the best of a small beam in each layer above."""
        start = np.full((len(rows), 1), self.entry, np.int32)
        for layer in range(self.height, to, -1):
            start = self._beam(cosines, rows, start, layer, 4)[0]
        return start

    def _choose(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row of candidates (-1: none) neighbours in different directions: nearer to the
        row's node (``sim``) than to a chosen one.  -1 pads."""
        order = np.argsort(np.where(cand >= 0, -sim, np.inf), axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
        v = self.v[cand]
        among = v @ v.transpose(0, 2, 1)
        block = np.full(cand.shape, -np.inf, np.float32)    # cosine with the nearest chosen one
        left = cand >= 0
        for _ in range(most // 2 + 1):
            free = left & (sim > block)
            k = free.argmax(axis=1)
            some = np.flatnonzero(free[np.arange(len(cand)), k])
            if not len(some):
                break
            left[some, k[some]] = False
            block[some] = np.maximum(block[some], among[some, k[some]])
        # the chosen ones, then simply the nearest
        rank = np.argsort(np.where(cand < 0, 2, left), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, rank, axis=1)

    def _link(self, layer: int, nodes: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        """Links between new nodes and the neighbours chosen among their rows of candidates, both
        ways.  A full list gives way by choice."""
        table_, incoming = self.layers[layer], self.incoming[layer]
        n, most = table_.shape
        mine = self._choose(cand, sim, max(1, most // 2))
        a, k = np.nonzero(mine >= 0)
        a, b = nodes[a].astype(np.int64), mine[a, k].astype(np.int64)
        who = np.unique(np.concatenate([a, b]))
        have = table_[who]
        x, k = np.nonzero(have >= 0)
        pairs = np.unique(np.concatenate([a * n + b, b * n + a, who[x] * n + have[x, k]]))
        first = np.searchsorted(pairs, who * n)
        size = np.append(first[1:], len(pairs)) - first
        ends = (pairs % n).astype(np.int32)
        old = np.bincount(have[x, k], minlength=n)
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order):      # longest lists first, so many at a time that their cosines stay few
            wide = max(int(size[order[at]]), most)
            some = order[at:at + max(1, (1 << 21) // wide ** 2)]
            place = np.arange(wide)[None, :]
            lists = np.where(place < size[some][:, None], ends[np.minimum(first[some][:, None] + place, len(ends) - 1)], -1)
            if wide > most:
                near = np.einsum("ad,akd->ak", self.v[who[some]], self.v[lists])
                short = size[some] <= most
                chosen = self._choose(lists, near, most)
                lists = np.where(short[:, None], lists[:, :most], chosen)
            table_[who[some]] = lists[:, :most]
            at += len(some)
        now = table_[who]
        incoming += (np.bincount(now[now >= 0], minlength=n) - old).astype(np.int32)
        for node in np.unique(ends[incoming[ends] == 0]).tolist():
            self._adopt(layer, node)

    def _adopt(self, layer: int, node: int) -> None:
        """A link to a node that no list holds any more, from the nearest of its neighbours that has
        room or a link which is not the last to its end."""
        table_, incoming = self.layers[layer], self.incoming[layer]
        mine = table_[node][table_[node] >= 0]
        for other in mine[np.argsort(-(self.v[mine] @ self.v[node]), kind="stable")].tolist():
            theirs = table_[other]
            spare = np.flatnonzero(theirs < 0)
            if not len(spare):
                spare = np.flatnonzero(incoming[theirs] > 1)
                if not len(spare):
                    continue
                spare = spare[(self.v[theirs[spare]] @ self.v[other]).argsort()]
                incoming[theirs[spare[0]]] -= 1
            theirs[spare[0]] = node
            incoming[node] += 1
            return

    def _insert(self, part: np.ndarray) -> None:
        if self.entry < 0:
            self.entry, self.height = int(part[0]), int(self.level[part[0]])
            part = part[1:]
            if not len(part):
                return
        cosines = Cosines(self.v, self.v[part])
        own = cosines.queries @ cosines.queries.T
        np.fill_diagonal(own, -np.inf)
        for layer in range(min(self.height, int(self.level[part].max())), -1, -1):
            who = np.flatnonzero(self.level[part] >= layer)
            if not len(who):
                continue
            cand, sim = self._beam(cosines, who, self._descend(cosines, who, layer), layer, BUILD_BEAM)
            mates = np.argsort(-own[np.ix_(who, who)], axis=1)[:, :min(BUILD_BEAM // 2, len(who) - 1)]
            near = np.take_along_axis(own[np.ix_(who, who)], mates, axis=1)
            self._link(layer, part[who], np.concatenate([cand, part[who[mates]].astype(np.int32)], axis=1),
                       np.concatenate([sim, near], axis=1))
        tall = part[self.level[part].argmax()]
        if self.level[tall] > self.height:
            self.entry, self.height = int(tall), int(self.level[tall])

    def _flood(self, query: np.ndarray, found: np.ndarray, least: float) -> np.ndarray:
        """The beam without a limit: all nodes at ``least`` or more that hang together with ``found``."""
        seen = np.zeros(len(self.v), bool)
        seen[found] = True
        out = [found]
        while len(found):
            first, size = self.range[found], self.range[found + 1] - self.range[found]
            stop = np.cumsum(size)
            near = self.ends[np.arange(stop[-1]) + np.repeat(first - (stop - size), size)]
            near = np.unique(near[~seen[near]]).astype(np.int64)
            seen[near] = True
            found = near[self.v[near] @ query >= least]
            out.append(found)
        return np.concatenate(out)

    def _found(self, queries: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, ids, cosines) of their beams at the bottom, a step at a time."""
        step = max(1, min(STEP_ROWS, (1 << 23) // max(len(self.v), 1)))
        for i in range(0, len(queries), step):
            q = queries[i:i + step].astype(np.float32)
            cosines, rows = Cosines(self.v, q), np.arange(len(q))
            yield q, *self._beam(cosines, rows, self._descend(cosines, rows, 0), 0, width)

    def within(self, queries: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
        """Nodes that each query's search finds at ``threshold`` or more (single precision,
        a little slack); a beam that ends among such nodes is widened as far as they reach."""
        slack = threshold - 1e-4
        out: list[np.ndarray] = []
        for q, ids, sim in self._found(queries, min(beam, len(self.v))):
            for k in range(len(q)):
                good = ids[k][(sim[k] >= slack) & (ids[k] >= 0)].astype(np.int64)
                out.append(self._flood(q[k], good, slack) if len(good) > 1 else good)
        return out

    def nearest(self, queries: np.ndarray, k: int, beam: int) -> np.ndarray:
        """The k best nodes that each query's beam finds; -1 pads."""
        parts = [ids[:, :k] for _, ids, _ in self._found(queries, min(max(beam, k), len(self.v)))]
        return np.concatenate(parts) if parts else np.zeros((0, k), np.int64)


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, dtype=np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def build_shards(vectors: DataFrame) -> DataFrame:
    """(label, shard, graph): one stored graph a shard.  Runs a job when called (the number of shards)."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "same"], ignore_index=True)
        unit = _unit(pdf["embedding"].tolist())
        g = Graph(unit)
        stored = pickle.dumps({"v": unit.astype(np.float64), "ids": pdf["node"].to_numpy(np.int64),
                               "copies": pdf["copies"].to_numpy(np.int64), "layers": g.layers,
                               "entry": g.entry, "height": g.height}, protocol=5)
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "shard": pdf["shard"].iloc[:1], "graph": [stored]})

    label = vectors.schema["label"].dataType.simpleString()
    # a graph is long work on few rows: so many partitions that few hold two, not merged by their size
    shards = vectors.select("label", "shard").distinct().count()
    return (vectors.repartition(max(1, 8 * shards), "label", "shard").groupBy("label", "shard")
            .applyInPandas(build, f"label {label}, shard int, graph binary"))


def _search(stored: dict, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Verified links (query place, node) of a block in a shard, audited recall, final beam."""
    g = Graph.__new__(Graph)
    g.v, g.layers, g.entry, g.height = stored["v"].astype(np.float32), stored["layers"], stored["entry"], stored["height"]
    g.both_ways()
    exact = stored["v"]
    draw = np.random.default_rng(SEED)
    audit = draw.permutation(len(ids))[:AUDIT_QUERIES]

    def verified(found, who):
        size = np.array([len(f) for f in found], np.int64)
        a = np.repeat(who, size)
        b = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
        ok = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            s = slice(i, i + (1 << 16))
            ok[s] = np.einsum("kd,kd->k", unit[a[s]], exact[b[s]]) >= THRESHOLD
        return a[ok], b[ok]

    links, near = _truth(unit, audit, exact, ids, stored["ids"])
    beam = FIRST_BEAM
    while True:
        got = set(zip(*(x.tolist() for x in verified(g.within(unit[audit], THRESHOLD, beam), audit))))
        linked = len(got & links) / len(links) if links else 1.0
        # a node as near as the last true one counts, whichever of several equal ones it is
        top = g.nearest(unit[audit], AUDIT_NEAREST + 1, beam)
        sims = np.where((top >= 0) & (stored["ids"][top] != ids[audit][:, None]),
                        np.einsum("qd,qkd->qk", unit[audit], exact[top]), -np.inf)
        right = np.minimum((sims >= near[:, -1:] - 1e-6).sum(axis=1), (near > -np.inf).sum(axis=1)).sum()
        recall = float(right / max(1, (near > -np.inf).sum())) if (near > -np.inf).any() else 1.0
        if (linked >= AUDIT_RECALL and recall >= NEAREST_RECALL) or beam >= len(exact):
            break
        beam *= 2
    a, b = verified(g.within(unit, THRESHOLD, beam), np.arange(len(ids)))
    return a, b, min(linked, recall), beam


def _truth(unit: np.ndarray, audit: np.ndarray, exact: np.ndarray, ids: np.ndarray,
           stored_ids: np.ndarray) -> tuple[set, np.ndarray]:
    """By brute force, a few queries at a time: the audited links, and each query's nearest cosines
    to other vectors (descending; -inf where there are fewer)."""
    links, near = set(), np.full((len(audit), AUDIT_NEAREST), -np.inf)
    for i in range(0, len(audit), 16):
        who = audit[i:i + 16]
        sims = unit[who] @ exact.T
        links |= {(int(who[r]), int(c)) for r, c in zip(*np.nonzero(sims >= THRESHOLD))}
        sims = np.where(stored_ids[None, :] == ids[who][:, None], -np.inf, sims)
        best = -np.sort(-sims, axis=1)[:, :AUDIT_NEAREST]
        near[i:i + 16, :best.shape[1]] = best
    return links, np.where(near > -np.inf, near, -np.inf)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked with it here) for the edges a - b, labels spread by rounds."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def search_shards(pairs: DataFrame) -> DataFrame:
    """(label, graph, qids, qvecs) -> (label, node, links, root, recall): every block against a
    shard.  One row a pair has its audited recall and no node; the others name what was linked."""
    kind = pairs.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                stored = pickle.loads(batch["graph"][k].as_py())
                qids = np.array(batch["qids"][k].as_py(), np.int64)
                unit = _unit(batch["qvecs"][k].as_py())
                a, b, recall, _ = _search(stored, qids, unit)
                other = qids[a] != stored["ids"][b]
                a, b = a[other], b[other]
                links = np.bincount(a, weights=stored["copies"][b], minlength=len(qids)).astype(np.int64)
                nodes, roots = _stars(qids[a], stored["ids"][b])
                hit = np.flatnonzero(links)
                n = len(hit) + len(nodes)
                said = lambda *parts: pa.array([None, *np.concatenate(parts).tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["label"].take(pa.array([k] * (n + 1))), said(qids[hit], nodes),
                     said(links[hit], np.zeros(len(nodes), np.int64)), said(qids[hit], roots),
                     pa.array([recall] + [None] * n, pa.float64())], ["label", "node", "links", "root", "recall"])

    return pairs.select("label", "graph", "qids", "qvecs").mapInArrow(
        run, f"label {kind}, node bigint, links bigint, root bigint, recall double")


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for every row of ``embeddings``.

    Rows of equal label (not null) with a cosine of 0.98 or more are linked.  ``recall`` is
    the lowest that an audit of the row's label has measured (null for rows that are not
    searched).
    Defined results: null labels, and vectors that are null, empty, zero or
    hold null or non-finite components, link with nothing; vectors are compared
    only with those of equal length; equal vectors of a label share one node
    and count as links of each other; rows that repeat a vec_id are rows of
    their own with equal ids; an empty table gives an empty result; further
    columns are ignored.  Runs jobs when called.
    """
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.aggregate("embedding", F.lit(True), lambda ok, x: ok & F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    biggest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
                        & whole & (biggest > 0), F.lit(False))
    # scaled by the largest component, so that squares stay finite; nodes are distinct vectors of a label
    scaled = F.transform("embedding", lambda x: x / biggest)
    good = written(rows.where(usable).select("vec_id", F.struct(F.col("label").alias("of"), F.size("embedding").alias("size"))
                                             .alias("label"), scaled.alias("embedding"))
                   .withColumn("same", F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256)),
                   "hnsw-vectors")
    nodes = written(good.groupBy("label", "same").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "hnsw-nodes")     # a vec_id may name several
    held = (good.join(nodes.select("label", "same", "vec_id", "copies", "node"), ["label", "same", "vec_id"])
            .dropDuplicates(["label", "same"]))
    sizes = held.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("rows"))
    spread = F.xxhash64("vec_id", "same", F.lit(SEED))
    dealt = written(held.join(sizes, F.col("label") == F.col("l")).select(
        "label", "vec_id", "same", "node", "copies", "embedding",
        F.pmod(spread, F.ceil(F.col("rows") / SHARD_ROWS)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("vec_id", "same", F.lit(SEED + 1)), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int").alias("block")),
        "hnsw-dealt")
    graphs = written(build_shards(dealt.drop("block")), "hnsw-graphs")
    blocks = dealt.groupBy("label", "block").agg(F.collect_list(F.struct("node", "embedding")).alias("q"))
    blocks = written(blocks.select("label", "block", F.transform("q", lambda x: x["node"]).alias("qids"),
                                   F.transform("q", lambda x: x["embedding"]).alias("qvecs")), "hnsw-blocks")
    # each block against each shard of its label: the pairs are dealt out one by one
    keys = written(graphs.select("label", "shard").join(blocks.select("label", "block"), "label"), "hnsw-pairs")
    tasks = (keys.join(graphs, ["label", "shard"]).join(blocks, ["label", "block"]))
    told = written(search_shards(tasks), "hnsw-links")
    audits = told.where(F.col("node").isNull()).groupBy("label").agg(F.min("recall").alias("recall"))
    found = told.where(F.col("node").isNotNull())
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("node", "root").distinct(), "node", "root")
    state = (nodes.join(links, "node", "left").join(groups, "node", "left")
             .select("label", "same", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "node").alias("component")))
    lowest = state.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    state = state.join(lowest, "component").join(audits, "label").select("label", "same", "n_links", "component_id", "recall")
    linked = good.select("vec_id", "label", "same").join(state, ["label", "same"]).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", "recall")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                       F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id",
                      F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

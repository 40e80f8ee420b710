"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary windows, another on the segments that
set toxic text apart (toxic documents are mostly ordinary prose, so a
dictionary of their whole text would equal the ordinary one).  A window of a
document, one word with its boundaries, is compressed once with the ordinary
dictionary and once with the ordinary plus the toxic one.  The pair of lengths
falls into a cell; the log-odds of the cells among labelled documents give
calibrated thresholds, and a logistic fit turns the evidence of a document's
windows into a score.

Evidence is judged against the number of windows: every window costs the
midpoint of what a clean and a toxic window bring on average, and the best
region of the whole text counts (all of it if toxic words are spread, a passage
if they stand together).  In clean text that maximum grows with the logarithm
of the length only; it is divided by a growth with it, chosen with the logistic fit
on the labelled documents of the fit.

The fit uses at most ``MAX_LABELLED`` labelled documents a class (by hash
order, one text an id) and nothing else.  Scoring covers every window of every text and keeps only the
dictionaries and the cell table (a few KB) in each worker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import table, text_or_empty, written

MAX_LABELLED = 3000         # labelled documents a class that the fit may use
ORDINARY_WINDOWS = 20_000   # windows to train the ordinary dictionary on
WINDOW_CHARS = 96
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2_048
REPEAT = 3                  # a window repeats its word so that short words compress at all
LEVEL = 3
MIN_CONTEXTS = 4            # a segment must follow this many different words in toxic text
FLAG = 0.7
LONG_TEXTS = 25             # labelled texts in one of the long ones that the calibration adds
LONG_SHARE = 0.2            # of the calibration's weight
GROWTHS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)   # of the best clean region with length, to choose from
MEMO = 250_000              # words remembered by a worker (only to save time)
SLICE = 200                 # texts whose words a worker holds at a time
_WORD = re.compile(r"[^\W\d_]{1,48}")


@dataclass
class ToxicityModel:
    ordinary: bytes         # dictionary content
    toxic: bytes
    cells: dict             # (word bytes, difference, length) -> log-odds, flagged cells only
    slope: float
    offset: float
    cost: float = 0.0       # of a window
    typical: float = 1.0    # windows of a labelled text
    growth: float = 0.0     # of the best clean region, as a share, with each e-fold of length


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little text for the trainer, the text itself."""
    try:
        return zstd.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


class _Scorer:
    """Evidence of words, by compression with both dictionaries."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.sides = []
        for content in (model.ordinary, model.ordinary + model.toxic):
            d = zstd.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.sides.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                  write_checksum=False, write_dict_id=False))
        self.known: set[str] = set()
        self.weights: dict[str, float] = {}

    def cells(self, words: list[str]) -> list[tuple[int, int, int]]:
        if not words:
            return []
        raw = [((" " + w) * REPEAT + " ").encode() for w in words]
        sizes = np.array([len(x) for x in raw], dtype=np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
        at = np.stack([starts, sizes], axis=1).tobytes()
        data = b"".join(raw)
        a, b = ([len(x) for x in side.multi_compress_to_buffer(zstd.BufferWithSegments(data, at))]
                for side in self.sides)
        return [(min(len(w.encode()), 30), x - y, y) for w, x, y in zip(words, a, b)]

    def evidence(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(texts), SLICE):
            found = [_WORD.findall(t.lower()) for t in texts[i:i + SLICE]]
            if len(self.known) > MEMO:
                self.known, self.weights = set(), {}
            new = sorted(set().union(*map(set, found)) - self.known)
            for w, cell in zip(new, self.cells(new)):
                weight = self.model.cells.get(cell)
                if weight is not None:
                    self.weights[w] = weight
            self.known.update(new)
            out += (self._best(f) / (1 + self.model.growth * self.length(f)) for f in found)
        return out

    def length(self, words: list[str]) -> float:
        return math.log1p(len(words) / self.model.typical)

    def regions(self, texts: list[str]) -> list[tuple[float, float]]:
        """Each text's best region, not yet divided, and the logarithm of its length."""
        raw = _Scorer(replace(self.model, growth=0.0)).evidence(texts)
        return [(x, self.length(_WORD.findall(t.lower()))) for x, t in zip(raw, texts, strict=True)]

    def _best(self, words: list[str]) -> float:
        """The best region's log-odds less the cost of its windows."""
        hit, cost = self.weights, self.model.cost
        best = run = 0.0
        last = -1
        for i, weight in [(i, hit[w]) for i, w in enumerate(words) if w in hit]:
            run = max(0.0, run - cost * (i - last - 1)) + weight - cost
            last = i
            if run > best:
                best = run
        return best


def _cell_odds(counts: pd.DataFrame) -> dict:
    """Flagged cells: the log-odds toxic to ordinary stay above 2 after two standard errors."""
    wide = counts.pivot_table(index="cell", columns="toxic", values="n", aggfunc="sum", fill_value=0)
    for c in (0, 1):
        if c not in wide:
            wide[c] = 0
    n0, n1 = max(1, wide[0].sum()), max(1, wide[1].sum())
    odds = np.log((wide[1] + 0.5) / n1) - np.log((wide[0] + 0.5) / n0)
    sure = odds - 2 / np.sqrt(np.maximum(wide[1], 1))
    return {tuple(map(int, k.split(","))): float(min(v, 6.0))
            for k, v, s, c in zip(wide.index, odds, sure, wide[1]) if s > 2 and c >= 3}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Ridge logistic fit with one feature (Newton steps; classes weigh the same)."""
    a, b = 0.0, 0.0
    for c in (0, 1):
        w = np.where(y == c, w / max(1e-9, w[y == c].sum()), w)
    w = w * 1000
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(w * (p - y) * x) + a, np.sum(w * (p - y)) + 0.1 * b])
        q = w * p * (1 - p)
        h = np.array([[np.sum(q * x * x) + 1, np.sum(q * x)], [np.sum(q * x), np.sum(q) + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled rows (labels: doc_id, toxic); null labels are left out."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    picks = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(MAX_LABELLED) for c in (0, 1)]
    named = docs.select("doc_id", text_or_empty().alias("text"))
    sample = written(named.join(picks[0].unionByName(picks[1]), "doc_id").groupBy("doc_id", "toxic")
                     .agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text"), "toxic-sample")
    # distinctive segments: words by the number of different words before them
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]{1,48}"), F.lit(0))
    pairs = (sample.select("toxic", words.alias("w"))
             .select("toxic", "w", F.posexplode("w").alias("i", "word"))
             .select("toxic", "word", F.when(F.col("i") > 0, F.get("w", F.col("i") - 1))
                     .otherwise("").alias("before")))
    seen = written(pairs.distinct().groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("c1"), F.count_if(F.col("toxic") == 0).alias("c0")),
        "toxic-words")
    n = seen.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).first()
    n1, n0 = max(1, n.n1 or 0), max(1, n.n0 or 0)
    odds = F.log((F.col("c1") + 0.5) / n1) - F.log((F.col("c0") + 0.5) / n0)
    segments = (seen.where(F.col("c1") >= MIN_CONTEXTS).withColumn("odds", odds - 2 / F.sqrt("c1"))
                .where(F.col("odds") > 2).orderBy(F.desc("odds"), "word").collect())     # words of the sample
    windows = (sample.where(F.col("toxic") == 0).select(F.explode(F.regexp_extract_all(
        "text", F.lit(rf"(?s).{{1,{WINDOW_CHARS}}}"), F.lit(0))).alias("w"))
        .orderBy(F.xxhash64("w"), "w").limit(ORDINARY_WINDOWS).collect())
    ordinary = _train([r.w.lower().encode() for r in windows], ORDINARY_BYTES)
    # a segment counts as often as its contexts, dealt out so that neighbours differ
    again = [f" {r.word} ".encode() for k in range(50) for r in segments if r.c1 > k]
    toxic = _train([b"".join(again[i:i + 8]) for i in range(0, len(again), 8)], TOXIC_BYTES) if again else b""
    model = ToxicityModel(ordinary, toxic, {}, 0.0, 0.0)
    if not toxic:
        return model

    def count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, memo = _Scorer(model), {}
        for b in (x.iloc[i:i + SLICE] for x in batches for i in range(0, len(x), SLICE)):
            found = [_WORD.findall(t.lower()) for t in b["text"]]
            new = sorted(set().union(*map(set, found)) - memo.keys()) if found else []
            memo.update(zip(new, scorer.cells(new)))
            cells: dict = {}
            for t, ws in zip(b["toxic"], found):
                for w in ws:
                    k = (int(t), "%d,%d,%d" % memo[w])
                    cells[k] = cells.get(k, 0) + 1
            if len(memo) > MEMO:
                memo = {}
            yield pd.DataFrame([(t, c, n) for (t, c), n in cells.items()], columns=["toxic", "cell", "n"])

    counts = (sample.mapInPandas(count_cells, "toxic int, cell string, n long")
              .groupBy("toxic", "cell").agg(F.sum("n").alias("n")).toPandas())
    model.cells = _cell_odds(counts)
    counts["odds"] = [model.cells.get(tuple(map(int, k.split(","))), 0.0) for k in counts["cell"]]
    rates = [float((c["n"] * c["odds"]).sum() / max(1, c["n"].sum()))
             for c in (counts[counts["toxic"] == t] for t in (0, 1))]
    model.cost = sum(rates) / 2
    model.typical = max(1.0, float(counts["n"].sum()) / max(1, sample.count()))

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for b in (x.iloc[i:i + SLICE] for x in batches for i in range(0, len(x), SLICE)):
            yield pd.DataFrame([(int(t), int(k), *r) for t, k, r in zip(
                b["toxic"], b["long"], scorer.regions(b["text"].tolist()))], columns=["toxic", "long", "best", "length"])

    # a row a labelled text of the sample, and a few long texts made of them
    texts = sample.withColumn("long", F.lit(0)).unionByName(_long_texts(sample))
    seen = texts.mapInPandas(regions, "toxic int, long int, best double, length double").toPandas()
    if seen["toxic"].nunique() == 2:
        _calibrate(model, seen)
    return model


def _long_texts(sample: DataFrame) -> DataFrame:
    """(toxic, text, long = 1): clean texts of the sample joined by LONG_TEXTS, and each once
    more with a toxic text at its end."""
    clean = sample.where(F.col("toxic") == 0)
    n = -(-clean.count() // LONG_TEXTS)
    of = F.pmod(F.xxhash64("text"), F.lit(max(1, n))).alias("of")
    joined = clean.groupBy(of).agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    toxic = sample.where(F.col("toxic") == 1).groupBy(of).agg(F.min_by("text", F.xxhash64("text")).alias("tail"))
    both = joined.join(toxic, "of").select(F.lit(1).alias("toxic"), F.concat("text", F.lit(" "), "tail").alias("text"))
    return joined.select(F.lit(0).alias("toxic"), "text").unionByName(both).withColumn("long", F.lit(1))


def _calibrate(model: ToxicityModel, seen: pd.DataFrame) -> None:
    """Sets growth, slope and offset: of the growths, the one whose logistic fit has the least loss.
    The classes weigh the same; in each the joined texts have a share of LONG_SHARE."""
    best, length, toxic = seen[["best", "length", "toxic"]].to_numpy(float).T
    weight = (1 / seen.groupby(["toxic", "long"])["best"].transform("size")).to_numpy(float)
    weight = weight * np.where(seen["long"] == 1, LONG_SHARE, 1 - LONG_SHARE)
    fits = []
    for growth in GROWTHS:
        x = np.minimum(best / (1 + growth * length), 20.0)
        a, b = _logistic(x, toxic, weight)
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        right = np.where(toxic == 1, p, 1 - p)
        fits.append((-(weight * np.log(right)).sum(), growth, a, b))
    _, model.growth, model.slope, model.offset = min(fits)


def evidence(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds evidence: the log-odds of a text's best region, judged by its length."""
    cols = docs.columns

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(model)
        for texts in batches:
            yield pd.Series(scorer.evidence([t or "" for t in texts]), dtype="float64")

    udf = F.pandas_udf(run, "double")
    return docs.select(*[F.col(f"`{c}`") for c in cols], udf(text_or_empty()).alias("evidence"))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds toxic_score (0 to 1) to every row of ``docs``; other columns are kept.

    Defined results: null and empty texts have no windows and the score of no
    evidence; without toxic labels to learn from every score is 0; repeated
    rows score alike; an empty table stays empty; a column that is already
    called toxic_score is replaced.
    """
    if not model.cells:
        return docs.withColumn("toxic_score", F.lit(0.0))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    x = F.least(F.col("evidence"), F.lit(20.0))
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * x + F.lit(model.offset))))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "toxic_score"]
    return evidence(packed, model).select(*kept, score.alias("toxic_score"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out()))
    got = score_toxicity(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                      F.col("toxic_score").alias("score"),
                      (F.col("toxic_score") >= FLAG).cast("int").alias("predicted"))

"""Word counting over Arrow batches: words joined by spaces come in, counts go out.

A batch is split and its words are numbered by Arrow; only distinct words are hashed, and
the counts of all rows are one ``bincount``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def _helpers():
    # made here, so that they travel with the functions that use them
    def words_of(texts: pa.Array):
        """The row of each word of the texts, and the words ('' too)."""
        lists = pc.split_pattern(texts, " ")
        return np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()

    def as_lists(table: np.ndarray) -> pa.Array:
        n, width = table.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(table.ravel()))
    return words_of, as_lists


def hashed_counts(dim: int):
    """Function words -> how many of them fall into each bucket (md5 prefix modulo ``dim``)."""
    buckets: dict = {}
    words_of, as_lists = _helpers()

    def bucket(word):
        found = buckets.get(word)
        if found is None:
            if len(buckets) >= 200_000:     # bounded: the words of one worker
                buckets.clear()
            found = buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim if word else -1
        return found

    @F.arrow_udf("array<float>")
    def counts(texts: pa.Array) -> pa.Array:
        row, words = words_of(texts)
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(bucket, distinct), dtype=np.int64, count=len(distinct))[words.indices.to_numpy()]
        held = place >= 0
        return as_lists(np.bincount(row[held] * dim + place[held], minlength=len(texts) * dim)
                     .astype(np.float32).reshape(len(texts), dim))
    return counts


def list_hits(lists):
    """Function words -> for each list (word -> weight) the sum of its words' weights."""
    width = len(lists)
    held: dict = {}
    words_of, as_lists = _helpers()
    for k, entries in enumerate(lists):
        for word, weight in entries.items():
            held.setdefault(word, np.zeros(width, dtype=np.int64))[k] += weight
    held.pop("", None)
    listed, weights = pa.array(held, pa.string()), np.array([*held.values()], dtype=np.int64).reshape(-1, width)

    @F.arrow_udf("array<int>")
    def hits(texts: pa.Array) -> pa.Array:
        row, words = words_of(texts)
        of = pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy()
        row, of = row[of >= 0], of[of >= 0]
        table = np.empty((len(texts), width), dtype=np.int32)
        for k in range(width):
            table[:, k] = np.bincount(row, weights=weights[of, k], minlength=len(texts))
        return as_lists(table)
    return hits


def contains_one(phrases):
    """Function text -> does it contain one of the phrases (one pass for all of them)."""
    pattern = "|".join(map(re.escape, phrases))

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)
    return found

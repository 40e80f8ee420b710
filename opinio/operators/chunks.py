"""Chunks of bounded token length, by any tokenizer, as a table function.

``aspects.chunk_by_budget`` counts words; here the caller's tokenizer counts.
Lengths of tokenizers do not add up, so each candidate is measured as a whole; a chunk
never holds more than the budget, so the work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions.text import word_count


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[Any]: ...

    def decode(self, tokens: list[Any]) -> str: ...


class Words:
    """Words between white space, put together with single spaces."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


class Characters:
    """Code points."""

    def encode(self, text: str) -> list[str]:
        return list(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


def pack(text: str | None, tokenizer: Tokenizer, max_tokens: int) -> Iterator[str]:
    """Sentences joined by a space while they fit; a longer one is cut every ``max_tokens`` tokens."""
    current = ""
    for sentence in filter(None, re.split(r"(?<=[.!?])\s+", (text or "").strip())):
        longer = f"{current} {sentence}" if current else sentence
        if len(tokenizer.encode(longer)) <= max_tokens:
            current = longer
            continue
        if current:
            yield current
        current = sentence
        tokens = tokenizer.encode(sentence)
        if len(tokens) > max_tokens:
            for at in range(0, len(tokens), max_tokens):
                yield tokenizer.decode(tokens[at:at + max_tokens])
            current = ""
    if current:
        yield current


def chunk_table(df: DataFrame, text_col: str = "text", max_tokens: int = 900,
                tokenizer: Callable[[], Tokenizer] = Words) -> DataFrame:
    """The columns of ``df`` with ``chunk_id`` (from 0) and ``chunk``; a row without text has no chunk.

    ``tokenizer`` is a factory that runs once a task (it may load a vocabulary there).
    Chunks leave the Python worker in Arrow batches as they are made.
    """
    class Chunker:
        def __init__(self) -> None:
            self.tokenizer = tokenizer()

        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(pack(text, self.tokenizer, max_tokens))

    chunks = F.udtf(Chunker, returnType="chunk_id int, chunk string", useArrow=True)
    return df.lateralJoin(chunks(F.col(text_col).outer()))


def drop_short_parts(chunks: DataFrame, min_words: int = 10, chunk_col: str = "chunk") -> DataFrame:
    """Chunks of at least ``min_words`` words: shorter ones are not worth a summary of their own."""
    return chunks.where(word_count(chunk_col) >= min_words)

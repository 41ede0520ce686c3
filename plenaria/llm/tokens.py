"""Token ids of a whole corpus by a public byte-level BPE vocabulary (problem 8).

Method: every word of the pre-tokenizer becomes a doubly linked list of symbols; a priority queue of
merge ranks joins neighbours, lowest rank and leftmost first, and entries that earlier merges made
stale are skipped. Decoding concatenates vocabulary strings. Words are remembered within a task.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter everywhere, the files are never copied.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# Fixed value: the pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words remembered by one task; beyond it the memory starts anew.
REMEMBERED = 300_000


class Bpe:
    """Encoder and decoder of one vocabulary given as {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.strings = {v: k for k, v in ranks.items()}
        self.words = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def encode_word(self, data: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < n and (r := ranks.get(symbol[a] + symbol[b])) is not None:
                heapq.heappush(queue, (r, a, len(symbol[a]) + len(symbol[b])))

        for i in range(n - 1):
            offer(i)
        while queue:
            rank, a, size = heapq.heappop(queue)
            if symbol[a] is None or (b := right[a]) >= n or len(symbol[a]) + len(symbol[b]) != size or ranks.get(symbol[a] + symbol[b]) != rank:
                continue  # stale: one of the two has been merged since
            symbol[a] += symbol[b]
            symbol[b] = None
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            if left[a] >= 0:
                offer(left[a])
            offer(a)
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; strings of special tokens are ordinary text. Null and empty give []."""
        out: list[int] = []
        known = self.known
        for w in self.words.findall(text or ""):
            ids = known.get(w)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.encode_word(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    known[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


def load(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a vocabulary file."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def _apply(spark: SparkSession, text: Column, folder: str, name: str, kind: str) -> Column:
    ranks = spark.sparkContext.broadcast(load(folder, name))  # a vocabulary: 50,000 entries whatever the corpus

    @F.pandas_udf(kind)
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe(ranks.value)
        for s in parts:
            got = [bpe.encode(t) for t in s]
            yield pd.Series(got if kind.startswith("array") else [len(x) for x in got], index=s.index)

    return ids(text)


def encode(df: DataFrame, text: str, out: str = "ids", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``out``; null and empty texts have no tokens ([])."""
    return df.withColumn(out, _apply(df.sparkSession, F.col(text), folder, name, "array<int>"))


def count(df: DataFrame, text: str, out: str = "n_tokens", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in ``out`` (0 for null and empty)."""
    return df.withColumn(out, _apply(df.sparkSession, F.col(text), folder, name, "int"))


def decode(df: DataFrame, ids: str, out: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of the token ids in ``ids``; null ids give null, [] gives ''."""
    ranks = df.sparkSession.sparkContext.broadcast(load(folder, name))

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe(ranks.value)
        for s in parts:
            yield s.map(lambda x: None if x is None else bpe.decode(x))

    return df.withColumn(out, text(F.col(ids)))

"""Byte-level BPE of a public tokenizer over a whole corpus.

Short words hold their part boundaries and the ranks of adjacent pairs in contiguous arrays: the
minimum is scanned for, its boundary deleted and the neighbouring ranks refreshed. That costs the
square of a word's length, so words beyond SHORT bytes go through a heap over linked parts, which
makes the same merges in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Where the tokenizer files lie; only the driver reads them.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which the contiguous array is used; entries a worker remembers.
SHORT, REMEMBERED = 256, 200_000
_NONE = 1 << 30


class Bpe:
    """Encoder over the lines of a rank file (base64 token, blank, rank)."""

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.words = regex.compile(pattern)
        self.seen: dict[str, list[int]] = {}

    def short_word(self, word: bytes) -> list[int]:
        get = self.ranks.get
        bounds = list(range(len(word) + 1))
        near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while near:
            low = min(near)
            if low == _NONE:
                break
            i = near.index(low)
            del bounds[i + 1], near[i]
            if i < len(near):
                near[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
        return [self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def long_word(self, word: bytes) -> list[int]:
        get, n = self.ranks.get, len(word)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(word[p:stop], _NONE)) != _NONE:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode_word(self, text: str) -> list[int]:
        word = text.encode("utf-8")
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self.short_word(word) if len(word) <= SHORT else self.long_word(word)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty or null text has none."""
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for found in self.words.finditer(text):
            w = found[0]
            ids = seen.get(w)
            if ids is None:
                ids = self.encode_word(w)
                if len(w) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[w] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[int, int], Bpe] = {}


def _encoder(lines: Broadcast) -> Bpe:
    """One encoder for each worker process and vocabulary."""
    raw = lines.value
    key = (len(raw), hash(raw))
    if key not in _ENCODERS:
        _ENCODERS[key] = Bpe(raw)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Broadcast:
    """The rank file, read once by the driver; its size is fixed by the vocabulary (under 1 MB)."""
    return spark.sparkContext.broadcast(Path(folder, f"{name}.tiktoken").read_bytes())


def token_ids(text: Column, lines: Broadcast) -> Column:
    """Token ids of each text; an empty and a null text both give an empty list."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _encoder(lines)
        for s in parts:
            yield pd.Series([np.array(bpe.encode(t), dtype=np.int32) for t in s], dtype=object)

    return ids(text)


def token_count(text: Column, lines: Broadcast) -> Column:
    """Number of tokens of each text; only the counts leave the worker."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _encoder(lines)
        for s in parts:
            yield pd.Series([len(bpe.encode(t)) for t in s], dtype="int32")

    return count(text)

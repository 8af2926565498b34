"""Splitting texts into words and numbers, for code that runs inside tasks.

Texts travel as UTF-8 bytes: ``bytes.split()`` breaks at exactly the six ASCII blanks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.columns import col


def as_bytes(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, text as bytes, more columns); every other column, whatever its name, stays behind."""
    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"), *more)


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches, turned into Python objects ``size`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns), strict=True)


class Batcher:
    """Collects rows and hands out Arrow batches of bounded rows and bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 20_000, cost: int = 16 << 20):
        self.schema, self.rows, self.cost = schema, rows, cost
        self.held: list[tuple] = []
        self.spent = 0

    def add(self, row: tuple, cost: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.spent += cost
        if len(self.held) >= self.rows or self.spent >= self.cost:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = zip(*self.held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.held, self.spent = [], 0


class WordHashes(dict):
    """word -> place of its 128-bit hash, remembered up to a bound of words and bytes."""

    def __init__(self, most: int = 400_000, most_bytes: int = 32 << 20):
        super().__init__()
        self.most, self.most_bytes, self.spent = most, most_bytes, 0
        self.high, self.low = np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        if place == len(self.high):
            self.high, self.low = (np.concatenate([x, np.empty_like(x)]) for x in (self.high, self.low))
        h = xxhash.xxh3_128_intdigest(word)
        self.high[place], self.low[place] = h >> 64, h & 0xFFFFFFFFFFFFFFFF
        self[word] = place
        self.spent += len(word)
        return place

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most or self.spent > self.most_bytes:
            self.clear()
            self.spent = 0
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def pair(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the hashes, as two independent hashes of 64 bits."""
        places = self._places(words)
        return self.high[places], self.low[places]

    def of(self, words: list[bytes]) -> np.ndarray:
        places = self._places(words)  # may put a longer table in place
        return self.high[places]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_STEPS = tuple(np.ones(1, np.uint64) for _ in range(2))  #: powers of the base and of its inverse, as far as they were needed


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _STEPS
    if len(_STEPS[0]) < n:
        size, out = max(n, 1 << 16), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            each = np.full(size, np.uint64(base))
            each[0] = 1
            out.append(np.cumprod(each, dtype=np.uint64))
        _STEPS = tuple(out)
    return _STEPS[0][:n], _STEPS[1][:n]


def window_hashes(h: np.ndarray, k: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive items, or of those that begin at ``starts``: a polynomial of the items mod 2^64, mixed."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=upto[1:])
    if starts is None:
        return mix((upto[k:] - upto[:-k]) * down[: n - k + 1])
    return mix((upto[starts + k] - upto[starts]) * down[starts])

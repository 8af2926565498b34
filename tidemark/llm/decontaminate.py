"""Benchmark decontamination: an FM-index per shard of the training text.

Each task indexes its documents shard by shard and looks up all test phrases by backward search;
nothing is shuffled. A phrase is ``window`` consecutive words of an item, or the whole of a
shorter item. Words that no phrase has break the indexed text, and stretches between breaks that
are shorter than the shortest phrase cannot hold one, so neither enters the index; every word of
every document is looked at.

The phrases reach the tasks in blocks of at most ``block_words`` words, whatever the size of the
benchmark; with several blocks the spans found for a document are merged afterwards.

Defined results: null and empty texts have no words and no hits; an item without words matches
nothing; equal items all count; an item without an id hits like any other, but has no place in
``items``; repeated rows are judged alike; other columns are not read. Ids are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import col
from tidemark.llm.fmindex import FMIndex
from tidemark.llm.tokens import Batcher, as_bytes, rows_of
from tidemark.llm.workspace import Workspace

WINDOW = 13
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 1_000_000
#: ASCII letters and digits stay, A-Z in lower case; every other ASCII character parts words.
_TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
FOUND = "doc_id bigint, row bigint, n_words bigint, starts array<int>, lengths array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Phrases:
    """A block of test items as numbered words and phrases."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.number: dict[bytes, int] = {}
        by_phrase: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(0, len(ids) - window) + 1) if ids else ():
                own = by_phrase.setdefault(tuple(ids[at : at + window]), set())
                if item is not None:
                    own.add(item)
        self.phrases = sorted(by_phrase, key=len)
        self.items = [sorted(by_phrase[p]) for p in self.phrases]
        self.shortest = len(self.phrases[0]) if self.phrases else 0

    def by_length(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first phrase, phrases of one length as rows)."""
        lengths = np.array([len(p) for p in self.phrases])
        for n in np.unique(lengths):
            first = int(np.searchsorted(lengths, n))
            yield first, np.array(self.phrases[first : int(np.searchsorted(lengths, n, "right"))], np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Shard:
    """Documents gathered until they are indexed together."""

    def __init__(self, phrases: Phrases, number: _Numbers):
        self.phrases, self.number = phrases, number
        self.docs: list[tuple] = []
        self.n_words = 0
        self.text: list[np.ndarray] = []
        self.doc_of: list[np.ndarray] = []
        self.word_of: list[np.ndarray] = []

    def add(self, doc_id, row: int, text: bytes | None) -> None:
        words = words_of(text)
        self.docs.append((doc_id, row, len(words)))
        self.n_words += len(words)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.r_[0, ids > 0, 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.phrases.shortest:
                self.text += [ids[a:b], np.zeros(1, np.int64)]
                self.doc_of.append(np.full(b - a + 1, len(self.docs) - 1))
                self.word_of.append(np.arange(a, b + 1))

    def found(self) -> Iterator[tuple]:
        """Rows of FOUND for every document added."""
        spans: dict[int, list[tuple[int, int, int]]] = {}
        if self.text:
            index = FMIndex(np.concatenate(self.text), len(self.number))
            doc_of, word_of = np.concatenate(self.doc_of), np.concatenate(self.word_of)
            for first, patterns in self.phrases.by_length():
                lo, hi = index.search(patterns)
                many = hi - lo
                which = np.repeat(np.arange(len(patterns)), many)
                rows = np.arange(many.sum()) + np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many)
                at = index.locate(rows)
                for d, w, p in zip(doc_of[at].tolist(), word_of[at].tolist(), (which + first).tolist(), strict=True):
                    spans.setdefault(d, []).append((w, patterns.shape[1], p))
        for k, (doc_id, row, n_words) in enumerate(self.docs):
            own = spans.get(k, ())
            yield doc_id, row, n_words, [s[0] for s in own], [s[1] for s in own], sorted({i for s in own for i in self.phrases.items[s[2]]})


def _search(block, shard_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        number = _Numbers(phrases.number)
        out, shard = Batcher(schema), Shard(phrases, number)

        def close() -> Iterator[pa.RecordBatch]:
            for row in shard.found():
                yield from out.add(row, 12 * len(row[3]))

        for doc_id, text, row in rows_of(batches):
            shard.add(doc_id, row, text)
            if shard.n_words >= shard_words:
                yield from close()
                shard = Shard(phrases, number)
        yield from close()
        yield from out.flush()

    return task


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    out = Batcher(schema)
    for doc_id, row, n_words, starts, lengths, items in rows_of(batches):
        spans: list[list[int]] = []
        for a, n in sorted(zip(starts, lengths, strict=True)):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], a + n)
            else:
                spans.append([a, a + n])
        yield from out.add((doc_id, row, n_words, sum(b - a for a, b in spans), sorted(set(items)), [a for a, _ in spans], [b for _, b in spans]))
    yield from out.flush()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    held, n = [], 0
    for item, text in benchmark.select(col(item_col).cast("string"), col(text_col).cast("binary")).toLocalIterator():
        text = None if text is None else bytes(text)
        held.append((item, text))
        n += len(words_of(text))
        if n >= block_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, row, n_words, n_hit, items, starts, ends, contaminated): merged spans of hit words.

    Contaminated: some word is hit and at least one word in twenty is. ``row`` numbers input rows.
    """
    spark = docs.sparkSession
    texts = as_bytes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    merged = "doc_id bigint, row bigint, n_words bigint, n_hit bigint, items array<string>, starts array<int>, ends array<int>"
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks, []), next(blocks, None)
    work = Workspace(spark, "decontaminate")
    if second is not None:
        texts = work.write(texts, "texts")  # row numbers must hold over all passes
    look = lambda items: texts.mapInArrow(_search(spark.sparkContext.broadcast(Phrases(items, window)), shard_words), FOUND)
    found = look(first)
    if second is not None:
        parts = [work.write(found, "block_0"), work.write(look(second).where("size(starts) > 0"), "block_1")]
        parts += [work.write(look(items).where("size(starts) > 0"), f"block_{k}") for k, items in enumerate(blocks, 2)]
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("starts"), flat("lengths"), flat("items")).select("doc_id", "row", "n_words", "starts", "lengths", "items")
    return found.mapInArrow(_merge, merged).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

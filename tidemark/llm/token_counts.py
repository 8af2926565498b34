"""Token counts by a two-tier lookup of pre-token lengths, all on the map side.

A text's token count is the sum of the lengths of its pre-tokens. Tier one is a compact table of
frequent pre-tokens and their lengths, fitted on about ``SAMPLE_DOCS`` rows drawn at random and
broadcast (at most ``FREQUENT`` entries, whatever the input). A pre-token that it lacks is looked
up in the worker's own cache and encoded by the tokenizer if it is not there either. Pre-tokens are
never shuffled: a task hands on its part of the sample's commonest as one bounded table, and these tables
are added up in a tree, each sum being bounded again. They only save work: any sample gives the same counts.

Texts with characters outside a set whose treatment is certain (printable ASCII, blanks, accented
Latin-1 letters, common marks), or with a special token's string, are encoded whole by the
tokenizer library itself.

Defined results: null text has 0 bytes and 0 tokens, as has the empty text; repeated rows give
repeated rows; other columns are not read, whatever their names. Texts are never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import col

SAMPLE_DOCS, SAMPLE_SEED = 10_000, 11
FREQUENT, OF_A_TASK = 65_536, 16_384
CACHE, CACHED_CHARS = 200_000, 64
LIMIT = 2048
_LETTERS = "a-zß-öø-ÿ"
#: The pre-tokens of lower-cased texts that consist of PLAIN characters.
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
#: Characters that need no composing and whose lower case and class all versions of Unicode agree on.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-§«®°±¶·»¿-ÿ–—‘-”…€]*")


class Lengths:
    """Both tiers, inside a worker."""

    def __init__(self, tokenizer: str, frequent: tuple[str, bytes], most: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pieces, lengths = frequent
        self.frequent = dict(zip(pieces.split("\n"), lengths, strict=True)) if lengths else {}
        self.known = dict(self.frequent)

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        split = {k: PRE_TOKENS.findall(t.lower()) for k, t in enumerate(texts) if t and self.plain(t)}
        whole = [k for k, t in enumerate(texts) if t and k not in split]
        for k, n in zip(whole, self.encode([texts[k] for k in whole]), strict=True):
            out[k] = n
        if len(self.known) > self.most:
            self.known = dict(self.frequent)
        missing = list(set().union(*split.values()).difference(self.known))
        self.known.update(zip(missing, self.encode(missing), strict=True))
        length = self.known.__getitem__
        for k, pieces in split.items():
            out[k] = sum(map(length, pieces))
        for piece in missing:  # long ones are not worth their memory
            if len(piece) > CACHED_CHARS:
                del self.known[piece]
        return out


def _by_size(column: pa.Array, most: int = 1 << 19) -> Iterator[list[str | None]]:
    """Texts of a column, as many at a time as have together about ``most`` characters: few are Python objects at once."""
    held, n = [], 0
    for at in range(0, len(column), 64):
        for t in column.slice(at, 64).to_pylist():
            held.append(t)
            n += len(t or "")
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _common(most: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for texts in _by_size(batch.column(0)):
                for text in texts:
                    if text and PLAIN.fullmatch(text):
                        seen.update(p for p in PRE_TOKENS.findall(text.lower()) if len(p) <= CACHED_CHARS)
                if len(seen) > 8 * most:
                    seen = Counter(dict(seen.most_common(4 * most)))
        pieces, counts = _table(seen, most)
        yield pa.RecordBatch.from_arrays([pa.array([pieces], pa.string()), pa.array([counts], pa.binary())], ["pieces", "counts"])

    return task


def _table(seen: Counter[str], most: int) -> tuple[str, bytes]:
    """The ``most`` commonest, joined by newlines (which no piece holds), and their counts."""
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]
    return "\n".join(p for p, _ in top), np.array([n for _, n in top], "<i8").tobytes()


def _added(a: tuple[str, bytes], b: tuple[str, bytes]) -> tuple[str, bytes]:
    """Two tables as one of at most ``FREQUENT`` entries."""
    both: Counter[str] = Counter()
    for pieces, counts in (a, b):
        both.update(dict(zip(pieces.split("\n"), np.frombuffer(counts, "<i8").tolist(), strict=False)))
    return _table(both, FREQUENT)


def frequent_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> tuple[str, bytes]:
    """The commonest pre-tokens of a bounded sample, joined by newlines, and their lengths (1 to 255)."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.select(col(text_col).alias("text")).where(F.rand(SAMPLE_SEED) < share)
    tables = sample.mapInArrow(_common(OF_A_TASK), "pieces string, counts binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    pieces, counts = tables.treeReduce(_added) if tables.getNumPartitions() else ("", b"")
    n = int((np.frombuffer(counts, "<i8") > 1).sum())  # they come by falling count
    pieces = pieces.split("\n")[: min(n, most)]
    sized = [(p, n) for p, n in zip(pieces, Lengths(tokenizer, ("", b"")).encode(pieces), strict=True) if 0 < n < 256]
    return "\n".join(p for p, _ in sized), bytes(n for _, n in sized)


def _count(tokenizer: str, frequent):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(tokenizer, frequent.value)
        for batch in batches:
            ids, n_bytes, texts = batch.columns
            counts = [n for part in _by_size(texts) for n in lengths.count(part)]
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return task


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; ``tokenizer``: a tokenizers file."""
    text = col(text_col)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text_col, sample_docs))
    read = docs.select(col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("text"))
    counted = read.mapInArrow(_count(tokenizer, frequent), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Alignment of two tokenizers' tokens on the bytes of a corpus, with document counts of linked pairs.

A text is encoded by both. Where tokens of both end, a group ends; tokens whose bytes share a group
are linked. A pair of ids is packed into one int64 key.

Counting: every task folds its documents' distinct keys with ``np.unique`` into partial counts; these
are sorted over the whole cluster by ranges of the key, and equal keys, which lie side by side, are
summed run by run. That leaves sorted shards of keys and counts (at most one entry for each pair of
vocabulary entries, whatever the input). Lookup: the shards' files go to every executor, which keeps
them as plain arrays beside it; workers map them into memory and search them by ``searchsorted``. A
lost executor's successor fetches them again, so the shared folder has to stay while the session lasts.
What is broadcast is each left id's highest count, which the vocabulary bounds.

A corpus is encoded once: the ids are kept in a table of the shared folder, two or four bytes each, from which
both later passes (counts, then the result) align them anew, all documents of a batch at a time in numpy.

Defined results: null and empty texts, and texts whose joined token bytes are not those of a space and
the text (as when it holds U+2581), have no tokens; they count nothing. Repeated rows are documents
of their own. Other columns are not read, whatever their names. Texts are never cut.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import col
from tidemark.llm.packing import Encoder
from tidemark.llm.tokens import Batcher
from tidemark.llm.workspace import Workspace

SHIFT = 32
HELD_KEYS = 1 << 21  #: keys that a task holds before it folds them
SHARD_ROWS = 1 << 21
AT_ONCE = 1 << 19  #: bytes of text, or of ids, that are aligned together
HUGE = 4096  #: links of a group that are told apart by its distinct ids alone
_TENS = np.array([10**k for k in range(1, 19)])
ALIGNED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups", pa.string())])
ALIGNED_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def byte_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, inside a worker. ``a``: a tokenizers file, byte-level; ``b``: a sentencepiece model; ``ranks`` as for ``packing.Encoder``."""

    def __init__(self, a: str, b: str, ranks: str | None = None, pattern: str = ""):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(a, ranks, pattern), SentencePieceProcessor(model_file=b)
        slow = self.a.slow
        slow.encode_special_tokens = True  # their strings in a text are ordinary text
        of, added = byte_of_characters(), {t.content for t in slow.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * slow.get_vocab_size()
        for piece, k in slow.get_vocab().items():
            self.a_bytes[k] = piece.encode() if piece in added else bytes(map(of.__getitem__, piece))
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) < 1 << 16 else "<u4")
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)]

    def _piece(self, k: int) -> bytes:
        return bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes] | None]:
        """Ids of each text by both, as numbers of ``kind``; None where it has no tokens."""
        some = [t for t in texts if t]
        others = iter(self.b.encode(some, num_threads=1))
        for t in texts:
            if not t:
                yield None
                continue
            a, b = self.a.ids(" " + t), next(others)
            raw = b" " + t.encode()
            whole = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            yield (np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()) if whole else None

    def aligned(self, left: list[bytes | None], right: list[bytes | None]) -> tuple[Aligned, np.ndarray]:
        """Encoded documents aligned, and which of them those are that have tokens."""
        good = [k for k, x in enumerate(left) if x is not None]
        ids, many = [], []
        for x in (left, right):
            ids.append(np.frombuffer(b"".join([x[k] for k in good]), self.kind).astype(np.int64))
            many.append(np.fromiter((len(x[k]) // self.kind.itemsize for k in good), np.int64, len(good)))
        return Aligned(*ids, *(size[x] for size, x in zip(self.sizes, ids, strict=True)), *many), np.array(good, np.int64)


class Aligned:
    """Groups and links of some documents' tokens, which lie one document behind the other."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, of_a: np.ndarray, of_b: np.ndarray):
        """Ids, the bytes of each token, and the tokens of each document."""
        ends, others = np.cumsum(a_size), np.cumsum(b_size)
        _, i, j = np.intersect1d(ends, others, assume_unique=True, return_indices=True)
        self.a, self.b = a, b
        self.a_from, self.b_from = np.r_[0, i[:-1] + 1].astype(np.int64)[: len(i)], np.r_[0, j[:-1] + 1].astype(np.int64)[: len(j)]
        self.n, self.m = i + 1 - self.a_from, j + 1 - self.b_from  # tokens of each group
        doc_ends = np.searchsorted(i, np.cumsum(of_a) - 1, side="right") if len(i) else np.zeros(len(of_a), np.int64)
        self.groups = np.diff(np.r_[0, doc_ends])  # of each document; a document's end is a common end
        self.doc_ends = doc_ends

    def sums(self, each: np.ndarray) -> np.ndarray:
        """By documents, of numbers of groups."""
        upto = np.r_[0, np.cumsum(each)]
        return upto[self.doc_ends] - upto[self.doc_ends - self.groups]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, how often) of all links, by documents; of very large groups by their distinct ids."""
        doc = np.repeat(np.arange(len(self.groups)), self.groups)
        many = self.n * self.m
        small = many <= HUGE
        size = np.where(small, many, 0)
        of = np.repeat(np.arange(len(many)), size)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        left, right = self.a[self.a_from[of] + nth // self.m[of]], self.b[self.b_from[of] + nth % self.m[of]]
        docs, keys, times = [doc[of]], [left << SHIFT | right], [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            x, n = np.unique(self.a[self.a_from[g] : self.a_from[g] + self.n[g]], return_counts=True)
            y, m = np.unique(self.b[self.b_from[g] : self.b_from[g] + self.m[g]], return_counts=True)
            keys.append((x[:, None] << SHIFT | y).ravel())
            times.append((n[:, None] * m).ravel())
            docs.append(np.full(len(keys[-1]), doc[g]))
        if len(docs) == 1:
            return docs[0], keys[0], times[0]
        d, k, t = map(np.concatenate, (docs, keys, times))
        order = np.argsort(d, kind="stable")
        return d[order], k[order], t[order]

    def texts(self) -> list[str]:
        """Of each document ``a1,a2|b1;a3|b2``."""
        total = len(self.a) + len(self.b)
        ids, after = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        start = self.a_from + self.b_from
        at_a = np.arange(len(self.a)) + np.repeat(self.b_from, self.n)
        at_b = np.arange(len(self.b)) + np.repeat(self.a_from + self.n, self.m)
        ids[at_a], ids[at_b] = self.a, self.b
        after[start + self.n - 1] = ord("|")
        after[start + self.n + self.m - 1] = ord(";")
        width = np.searchsorted(_TENS, ids, side="right") + 1
        ends = np.cumsum(width + 1)
        out = np.empty(int(ends[-1]) if total else 0, np.uint8)
        out[ends - 1] = after
        rest, place = ids, ends - 2
        for k in range(int(width.max(initial=0))):
            some = width > k
            out[place[some] - k] = rest[some] % 10 + ord("0")
            rest = rest // 10
        last = self.doc_ends[self.groups > 0] - 1
        cuts = np.zeros(len(self.groups), np.int64)
        cuts[self.groups > 0] = ends[(start + self.n + self.m - 1)[last]]
        cuts = np.maximum.accumulate(cuts)
        data, begin, found = out.tobytes(), 0, []
        for end in cuts.tolist():
            found.append(data[begin : end - 1].decode() if end > begin else "")
            begin = max(begin, end)
        return found


class Counts:
    """The sorted shards of counts, mapped into memory."""

    def __init__(self, names: list[str], best: np.ndarray):
        shards = [self._mapped(name) for name in names]
        shards = sorted((s for s in shards if len(s[0])), key=lambda s: s[0][0])
        self.shards, self.firsts, self.best = shards, np.array([s[0][0] for s in shards], np.int64), best

    @staticmethod
    def _mapped(name: str) -> tuple[np.ndarray, np.ndarray]:
        """A shard's file as two arrays beside it, which the first worker that asks leaves there for all."""
        source = SparkFiles.get(name)
        target = f"{source}.npy"
        if not os.path.exists(target):
            t = pq.read_table(source, columns=["key", "n"])
            own = f"{target}.{os.getpid()}.npy"
            np.save(own, np.stack([t.column("key").to_numpy(), t.column("n").to_numpy()]) if t.num_rows else np.zeros((2, 0), np.int64))
            os.replace(own, target)
        both = np.load(target, mmap_mode="r")
        return both[0], both[1]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which some shard holds."""
        out = np.empty(len(keys), np.int64)
        ends = np.r_[np.searchsorted(keys, self.firsts), len(keys)]
        for (known, n), a, b in zip(self.shards, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if a < b:
                out[a:b] = n[np.searchsorted(known, keys[a:b])]
        return out

    def weigh(self, docs: np.ndarray, keys: np.ndarray, times: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, the links whose count is the highest of their left id, and the sum of the counts over its links."""
        distinct, back = np.unique(keys, return_inverse=True)
        counts = self.of(distinct)
        top = (counts == self.best[distinct >> SHIFT])[back] * times
        upto = np.searchsorted(docs, np.arange(many + 1))
        by_doc = lambda v: np.diff(np.r_[0, np.cumsum(v)][upto])
        return by_doc(top), by_doc(counts[back] * times)


_HELD: dict[tuple, Pair] = {}


def _pair(*files: str | None) -> Pair:
    """A worker's tokenizers, which it keeps from task to task."""
    if files not in _HELD:
        _HELD.clear()
        _HELD[files] = Pair(*files)
    return _HELD[files]


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows one behind the other, with about ``most`` bytes of a column together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0)
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, before + most)))
        yield batch.slice(at, upto - at)
        at = upto


def _encoded(files: tuple):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files)
        for batch in batches:
            for part in _slices(batch, 1, AT_ONCE):
                found = list(pair.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x and x[w] for x in found], pa.binary()) for w in range(2))], ["doc_id", "a", "b"])

    return task


def _partials(files: tuple):
    def folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, back = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(back, n, len(distinct)).astype(np.int64)

    def batch(pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in pairs], ["key", "n"])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files)
        held, n = [], 0
        for rows in batches:
            for part in _slices(rows, 1, AT_ONCE):
                aligned, _ = pair.aligned(*(c.to_pylist() for c in part.columns[1:]))
                docs, keys, _ = aligned.links()
                ends = np.searchsorted(docs, np.arange(len(aligned.groups) + 1)).tolist()
                once = [np.unique(keys[x:y]) for x, y in zip(ends, ends[1:], strict=False)]  # a document counts a pair once
                if not once:
                    continue
                keys = np.concatenate(once)
                held.append((keys, np.ones(len(keys), np.int64)))
                n += len(keys)
                if n >= HELD_KEYS:
                    held = [folded(held)]
                    n = len(held[0][0])
                    if n >= HELD_KEYS // 2:  # nothing to be gained by holding on to them
                        yield from batch(held[0])
                        held, n = [], 0
        if held:
            yield from batch(folded(held))

    return task


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths of runs of equal keys, weighed by their counts; rows come in order."""
    last, total = None, 0
    for rows in batches:
        keys, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if not len(keys):
            continue
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        distinct, sums = keys[first], np.add.reduceat(n, first)
        if last == distinct[0]:
            sums[0] += total
        elif last is not None:
            distinct, sums = np.r_[last, distinct], np.r_[total, sums]
        last, total = distinct[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(distinct[:-1]), pa.array(sums[:-1])], ["key", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], ["key", "n"])


def encoded(docs: DataFrame, files: tuple, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """(doc_id, a, b): the ids of every text by both tokenizers, as little-endian numbers; null where it has no tokens."""
    work = work or Workspace(docs.sparkSession, "alignment")
    read = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    return work.write(read.mapInArrow(_encoded(files), "doc_id bigint, a binary, b binary"), "encoded")


def pair_counts(ids: DataFrame, files: tuple, work: Workspace | None = None) -> DataFrame:
    """(key, n) of encoded documents: in how many of them each pair of ids is linked; sorted by key within and across its files."""
    work = work or Workspace(ids.sparkSession, "alignment")
    partial = work.write(ids.mapInArrow(_partials(files), "key bigint, n bigint"), "partial")
    shards = max(1, -(-partial.count() // SHARD_ROWS))
    ordered = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    counts = work.write(ordered.mapInArrow(_summed, "key bigint, n bigint"), "counts")
    work.drop("partial")
    return counts


def _aligned(files: tuple, names: list[str], best):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, counts = _pair(*files), Counts(names, best.value)
        out = Batcher(ALIGNED, cost=8 << 20)
        for rows in batches:
            for part in _slices(rows, 1, AT_ONCE):
                ids, *both = (c.to_pylist() for c in part.columns)
                aligned, good = pair.aligned(*both)
                tops, sums = counts.weigh(*aligned.links(), len(good))
                numbers = np.zeros((len(ids), 6), np.int64)
                numbers[good] = np.stack([aligned.sums(aligned.n), aligned.sums(aligned.m), aligned.groups, aligned.sums(aligned.n * aligned.m), tops, sums], 1)
                groups = dict(zip(good.tolist(), aligned.texts(), strict=True))
                for k, (doc_id, each) in enumerate(zip(ids, numbers.tolist(), strict=True)):
                    text = groups.get(k, "")
                    yield from out.add((doc_id, *each, text), len(text))
        yield from out.flush()

    return task


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = "") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    ``groups``: ``a1,a2|b1;a3|b2`` in decimal ids; ``a`` is a tokenizers file (byte-level), ``b`` a sentencepiece model.
    ``ranks`` and ``pattern``: the first vocabulary as byte ranks, for texts where a faster library is certain to agree.
    """
    spark, files = docs.sparkSession, (a, b, ranks, pattern)
    work = Workspace(spark, "alignment")
    ids = encoded(docs, files, id_col, text_col, work)
    counts = pair_counts(ids, files, work)
    highest = counts.groupBy(F.shiftright("key", SHIFT).alias("a")).agg(F.max("n").alias("n")).collect()  # a row for each entry of the vocabulary at most
    best = np.zeros(max((r["a"] for r in highest), default=0) + 1, np.int64)
    for r in highest:
        best[r["a"]] = r["n"]
    names = []
    for file in counts.inputFiles():
        spark.sparkContext.addFile(file)
        names.append(unquote(file.rsplit("/", 1)[1]))
    return ids.mapInArrow(_aligned(files, names, spark.sparkContext.broadcast(best)), ALIGNED_DDL)

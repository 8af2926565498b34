"""Packing documents into sequences by swap-based local search for the best fit.

Documents become token ids in one pass without a shuffle; only longer ones are cut. Whole-length
pieces are sequences of their own. The others are dealt by a hash of a stored row number into
groups of about ``GROUP_PIECES``, so that no key can crowd a group, and each group is packed by
one task. There every piece begins in a bin of its own. A step takes documents out of one underfull
bin for a fuller one: it moves a document or two, exchanges one for one, two for one or one for two,
whichever fits best of all that raise the sum of squared fills. So full bins fill up, and the emptiest
lose their documents until they are empty. The search ends where no such step is left (the sum is
a whole number that only grows, so it does end): every bin, every document and every pair of
documents is looked at, without a cap. Where it ends over the least possible number of bins, it
also starts from a best fit by falling length, and the smaller result is taken.

Defined results: null text is the empty text, which is the end token alone; repeated rows are
packed as often as they occur; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import col
from tidemark.llm.tokens import Batcher, rows_of
from tidemark.llm.workspace import Workspace

CAPACITY = 1024
END = 2
GROUP_PIECES = 16_384
PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Characters whose class all versions of Unicode agree on.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ–—‘-”…€]*")


class Encoder:
    """Ids of whole texts by a tokenizers file, through the same ranks in a faster library where that is certain to agree.

    ``ranks`` is the path of the same vocabulary as byte ranks; without it every text takes the
    tokenizers library.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str = ""):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(tokenizer), None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> Sequence[int]:
        if self.fast is not None and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def _pieces(tokenizer: str, ranks: str | None, pattern: str, capacity: int, end: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = Encoder(tokenizer, ranks, pattern), Batcher(PIECES)
        for row, doc_id, text in rows_of(batches):
            ids = np.array([*encoder.ids(text or ""), end], "<u4")
            cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                yield from out.add((row, doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        yield from out.flush()

    return task


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Best fit in order of falling length; bins as lists of places in ``lengths``."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r free
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[k]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            at = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
            bins[at].append(k)
        else:
            r, at = capacity, len(bins)
            bins.append([k])
        if r > n:
            free[r - n].append(at)
            mask |= 1 << (r - n)
    return bins


class LocalSearch:
    """Bins that get rearranged, always to a larger sum of squared fills.

    For every length, and every sum of two lengths that share a bin, a heap holds the underfull bins
    that have it, the emptiest on top. Entries of bins that have changed since are thrown away when
    they come up. As the emptiest bin is the best to take from, one look at a heap's top decides a length.
    """

    def __init__(self, lengths: Sequence[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.turn = [0] * len(bins)  # how often a bin has changed
        self.held: list[dict[int, list[int]]] = [{} for _ in bins]
        for at, b in enumerate(bins):
            for i in b:
                self.held[at].setdefault(lengths[i], []).append(i)
        self.singles: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.pairs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.single = self.double = 0  # bit n: the heap of length n is not empty
        for at in range(len(bins)):
            self._enter(at)

    def _pairs_of(self, at: int) -> set[tuple[int, int]]:
        """(sum, smaller length) of the pairs of documents in a bin."""
        held = self.held[at]
        each = sorted(held)
        return {(a + b, a) for k, a in enumerate(each) for b in each[k:] if a < b or len(held[a]) > 1}

    def _enter(self, at: int) -> None:
        fill = self.fill[at]
        if not 0 < fill < self.capacity:
            return
        turn = self.turn[at]
        for n in self.held[at]:
            heappush(self.singles[n], (fill, at, turn))
            self.single |= 1 << n
        for n, a in self._pairs_of(at):
            heappush(self.pairs[n], (fill, at, turn, a))
            self.double |= 1 << n

    def _emptiest(self, heap: list[tuple], but: int) -> tuple | None:
        """The entry of the emptiest bin other than ``but``."""
        turn, aside, found = self.turn, [], None
        while heap:
            top = heap[0]
            if turn[top[1]] != top[2]:
                heappop(heap)
            elif top[1] == but:
                aside.append(heappop(heap))
            else:
                found = top
                break
        for entry in aside:
            heappush(heap, entry)
        return found

    def _offer(self, pair: bool, at: int, gone: int, least: int) -> tuple[int, tuple] | None:
        """The longest gain of more than ``least``, in place of ``gone``, that fits and pays; and whose it is."""
        fill, heaps = self.fill[at], self.pairs if pair else self.singles
        low, high = gone + least + 1, gone + self.capacity - fill
        window = ((self.double if pair else self.single) & ((2 << high) - 1)) >> low if high >= low else 0
        while window:
            n = low + window.bit_length() - 1
            window ^= 1 << (n - low)
            found = self._emptiest(heaps[n], at)
            if found is None:
                if not heaps[n]:
                    if pair:
                        self.double &= ~(1 << n)
                    else:
                        self.single &= ~(1 << n)
            elif found[0] < fill + n - gone:
                return n - gone, found
        return None

    def _shift(self, lengths: Iterable[int], a: int, b: int) -> None:
        for n in lengths:
            own = self.held[a][n]
            self.held[b].setdefault(n, []).append(own.pop())
            if not own:
                del self.held[a][n]
            self.fill[a] -= n
            self.fill[b] += n

    def _improve(self, at: int) -> bool:
        """The step that fills bin ``at`` most, of those that pay."""
        free, least, best = self.capacity - self.fill[at], 0, None
        for out, pair in self._ways(at):
            found = self._offer(pair, at, sum(out), least)
            if found:
                least, entry = found
                into = (entry[3], sum(out) + least - entry[3]) if pair else (sum(out) + least,)
                best = out, into, entry[1]
                if least == free:
                    break
        if best is None:
            return False
        out, into, source = best
        self._shift(into, source, at)
        self._shift(out, at, source)
        for b in (at, source):
            self.turn[b] += 1
            self._enter(b)
        return True

    def _ways(self, at: int) -> Iterator[tuple[tuple[int, ...], bool]]:
        """What may leave a bin, and whether a pair comes for it."""
        yield (), False
        yield (), True
        singles = list(self.held[at])
        for n in singles:
            yield (n,), False
        for n in singles:
            yield (n,), True
        for n, a in self._pairs_of(at):
            yield (a, n - a), False

    def run(self) -> list[list[int]]:
        """Bins by falling fill, again and again, until none of them can be filled further."""
        todo = [at for at, f in enumerate(self.fill) if 0 < f < self.capacity]
        moved = True
        while moved:
            moved = False
            todo = sorted((at for at in todo if 0 < self.fill[at] < self.capacity), key=lambda at: (-self.fill[at], at))
            for at in todo:
                while 0 < self.fill[at] < self.capacity and self._improve(at):
                    moved = True
        return [[i for own in held.values() for i in own] for held in self.held if held]


def pack(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of places in ``lengths``."""
    found = LocalSearch(lengths, [[i] for i in range(len(lengths))], capacity).run()
    if len(found) > -(-sum(lengths) // capacity):
        found = min(found, LocalSearch(lengths, best_fit(lengths, capacity), capacity).run(), key=len)
    return found


def _pack_group(capacity: int):
    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_pylist()
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(pack(lengths, capacity)):
            at = 0
            for i in b:
                number[i], offset[i] = k, at
                at += lengths[i]
        group = table["group"][0].as_py() if len(lengths) else 0
        return table.drop_columns(["row", "group"]).append_column("sequence_id", pa.array((number + (group << 24)) * 2 + 1)).append_column("offset", pa.array(offset))

    return task


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str = "",
    capacity: int = CAPACITY,
    end: int = END,
    group_pieces: int = GROUP_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    work = Workspace(docs.sparkSession, "packing")
    read = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("doc_id"), col(text_col).alias("text"))
    pieces = work.write(read.mapInArrow(_pieces(tokenizer, ranks, pattern, capacity, end), PIECES_DDL), "pieces")
    whole = pieces.where(F.col("length") == capacity)
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    dealt = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("bigint"))
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    packed = dealt.groupBy("group").applyInArrow(_pack_group(capacity), out)
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.union(alone)

"""Line deduplication by content-defined chunks of lines.

Every line gets a number (32 bits of its MD5), and a rolling polynomial over the last ``WINDOW``
numbers a value. A chunk ends where the value is smaller than the one before and no larger than
the one after, and at the end of the text: boundaries depend on nearby lines only, so lines that
are put in or taken out move none but the nearest, and every chunk but that of a one-line text
has two lines at least. The fewer lines a boundary depends on, the more of a short passage it finds
again: with ``WINDOW`` 2 a boundary looks at four lines. A chunk that occurs more than once in all texts is kept where it comes
first (by id, then row, then place) and removed elsewhere.

Chunks are counted by hash with partial sums. Only for hashes met twice does the first place hand
out its bytes, and a chunk goes only if it equals them byte for byte; should two different chunks
share a hash, the later one stays. Texts move once, when they are numbered and dealt by number.

Defined results: null stays null and has no lines; an empty text is one empty line; chunks without
a word are left alone; repeated rows are repeats of each other, so all but the first become empty;
columns of the input pass through, under whatever names, except for those named like the two counts
(in any case), which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.columns import col, others, packed
from tidemark.llm.tokens import Batcher, rows_of
from tidemark.llm.workspace import Workspace

WINDOW = 2
BASE, PRIME = 1_000_003, 2**31 - 1
CHUNK = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("row", pa.int64()), ("k", pa.int32())])


def chunks(lines: list[bytes], window: int = WINDOW) -> list[tuple[int, int]]:
    """[first line, line after the last) of each chunk."""
    n = len(lines)
    if n < 4:
        return [(0, n)]
    numbers = np.fromiter((int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in lines), np.int64, n) % PRIME
    value = numbers.copy()
    for k in range(1, min(window, n)):
        value[k:] = (value[k:] + numbers[:-k] * pow(BASE, k, PRIME)) % PRIME
    low = np.flatnonzero((value[1:-2] < value[:-3]) & (value[1:-2] <= value[2:-1])) + 2
    cuts = [0, *low.tolist(), n]
    return list(zip(cuts, cuts[1:], strict=False))


def _multi_line(text: bytes, window: int) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """The lines, and (first, end, bytes) of the chunks that may be removed."""
    lines = text.split(b"\n")
    found = ((a, b, b"\n".join(lines[a:b])) for a, b in chunks(lines, window) if b - a > 1)
    return lines, [c for c in found if c[2].strip()]


def _fingerprint(window: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(CHUNK)
        for row, key, text in rows_of(batches):
            for k, (_, _, chunk) in enumerate(_multi_line(text or b"", window)[1]):
                yield from out.add((xxhash.xxh3_64_intdigest(chunk) - (1 << 63), key, row, k))
        yield from out.flush()

    return task


def _hand_out(window: int):
    """The bytes of the chunks that stay, asked for by document."""
    schema = pa.schema([("h", pa.int64()), ("chunk", pa.binary())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(schema)
        for text, wanted in rows_of(batches):
            found = _multi_line(text or b"", window)[1]
            for w in wanted:
                chunk = found[w["k"]][2]
                yield from out.add((w["h"], chunk), len(chunk))
        yield from out.flush()

    return task


def _remove(window: int, width: int = 512):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                texts, counts, removed = [], [], []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines, found = _multi_line(text, window) if text is not None else ([], [])
                    drop = np.zeros(len(lines), bool)
                    for g in gone or ():
                        a, b, chunk = found[g["k"]]
                        drop[a:b] |= chunk == g["chunk"]
                    kept = [x for x, d in zip(lines, drop.tolist(), strict=True) if not d]
                    texts.append(None if text is None else b"\n".join(kept).decode())
                    counts.append(len(lines))
                    removed.append(int(drop.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["d", "text", "n_lines", "n_removed"])

    return task


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that are left, and (n_lines, n_removed)."""
    work = Workspace(docs.sparkSession, "lines")
    own = others(docs.columns, ("n_lines", "n_removed"))
    rest = [c for c in own if c != text_col]
    table = work.write_bucketed(docs.select(packed(rest).alias("d"), col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")), "row")
    numbered = table.select("row", F.coalesce(F.col("d")[id_col].cast("bigint"), F.lit(-1)).alias("key"), "text")

    found = work.write(numbered.mapInArrow(_fingerprint(window), "h bigint, key bigint, row bigint, k int"), "chunks")
    place = F.struct("key", "row", "k")
    first = found.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h", "first")
    first = work.write(first, "first_places")
    wanted = first.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct(F.col("first.k").alias("k"), "h")).alias("wanted"))
    stay = work.write(numbered.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(_hand_out(window), "h bigint, chunk binary"), "first_chunks")

    later = found.join(first, "h").where(place != F.col("first")).select("h", "row", "k")
    gone = later.join(stay, "h").groupBy("row").agg(F.collect_list(F.struct("k", "chunk")).alias("gone"))
    wide = table.join(gone, "row", "left").select("d", "text", "gone")
    schema = StructType([wide.schema["d"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    left = wide.mapInArrow(_remove(window), schema)
    return left.select(*[(F.col("text") if c == text_col else F.col("d")[c]).alias(c) for c in own], "n_lines", "n_removed")

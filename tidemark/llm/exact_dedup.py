"""Exact duplicates by counting quotient filters, confirmed byte by byte.

Every task puts the 64-bit fingerprints of its texts into counting quotient filters, one for each
range of the fingerprint space, and only these are shuffled. A range's filters merge without loss by
their sorted remainders, in a task of its own. A fingerprint that the merged filter counts once is that
of a unique text: such texts never move. The others are routed to byte verification: they are grouped
by the bytes of the whole normalised text (and its SHA-256), pre-aggregated in every task, so that a
group of any size is one row a task.

Which texts to route is told by a bitmap of ``coarse_bits`` bits over the leading bits of repeated
fingerprints: a bound that does not depend on the data (8 MB), so it is broadcast. Where it fills
up, or fingerprints collide, more texts are verified; the result is the same.

Defined results: null counts as the empty text; only A-Z are lower-cased; of equal texts the row
with the largest doc_id stays, a null id being the smallest; of rows that agree in id and text exactly
one stays. Two different texts of one SHA-256 digest are an error, never a wrong group. Other columns
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quotient_filter import CountingQuotientFilter, summed
from tidemark.llm.tokens import Batcher, as_bytes, rows_of
from tidemark.llm.workspace import Workspace

BITS, COARSE_BITS = 64, 26
RANGE_ROWS = 1 << 20  #: fingerprints of a range, about
AT_ONCE = 1 << 22  #: fingerprints that a task holds
FILTERS = "range int, filter binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("body", pa.binary())])
_LEAST = -(1 << 63)


def normalised(text: bytes | None) -> bytes:
    return (text or b"").lower()  # of bytes, this lowers A-Z alone


def fingerprint(body: bytes, bits: int = BITS) -> int:
    return xxhash.xxh3_64_intdigest(body) >> (64 - bits)


def _filters(range_bits: int, bits: int):
    own = bits - range_bits

    def blocks(held: list[int]) -> Iterator[pa.RecordBatch]:
        prints, counts = np.unique(np.array(held, np.uint64), return_counts=True)
        part = (prints >> np.uint64(own)).astype(np.int32) if range_bits else np.zeros(len(prints), np.int32)
        ranges, first = np.unique(part, return_index=True)
        out = Batcher(pa.schema([("range", pa.int32()), ("filter", pa.binary())]))
        for k, a, b in zip(ranges.tolist(), first.tolist(), [*first[1:].tolist(), len(prints)], strict=True):
            packed = CountingQuotientFilter.build(prints[a:b] & np.uint64((1 << own) - 1), counts[a:b], own).to_bytes()
            yield from out.add((k, packed), len(packed))
        yield from out.flush()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for (text,) in rows_of(batches):
            held.append(fingerprint(normalised(text), bits))
            if len(held) >= AT_ONCE:
                yield from blocks(held)
                held = []
        if held:
            yield from blocks(held)

    return task


def partition_filters(docs: DataFrame, range_bits: int, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(range, filter): for each task and range of leading bits a filter of the rest of the fingerprints."""
    texts = as_bytes(docs, text_col, text_col).select("text")
    return texts.mapInArrow(_filters(range_bits, bits), FILTERS)


def _merge(own: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([CountingQuotientFilter.build(*summed(held), own).to_bytes()], pa.binary())], ["range", "filter"])
        for k, data in rows_of(batches, 64):
            if k != now:
                if held:
                    yield done()
                now, held, n = k, [], 0
            held.append(CountingQuotientFilter.from_bytes(data).items())
            n += len(held[-1][0])
            if n >= AT_ONCE:
                held = [summed(held)]
                n = 0
        if held:
            yield done()

    return task


def merged_filters(parts: DataFrame, range_bits: int, bits: int = BITS) -> DataFrame:
    """One filter for each range; filters of earlier batches can be merged in, by a union with them."""
    dealt = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(dealt, "range").sortWithinPartitions("range").mapInArrow(_merge(bits - range_bits), FILTERS)


def _coarse(own: int, span: int):
    """Of each range's repeated fingerprints the leading ``span`` bits behind the range, as a compressed bitmap."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, maps = [], []
        for k, data in rows_of(batches, 64):
            prints, counts = CountingQuotientFilter.from_bytes(data).items()
            repeated = prints[counts > 1]
            if len(repeated):
                bitmap = np.zeros(1 << span, bool)
                bitmap[repeated >> np.uint64(own - span)] = True
                ranges.append(k)
                maps.append(zlib.compress(np.packbits(bitmap).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(maps, pa.binary())], ["range", "bitmap"])

    return task


def coarse_bitmap(filters: DataFrame, range_bits: int, bits: int = BITS, coarse_bits: int = COARSE_BITS) -> np.ndarray:
    """2^coarse_bits bits, packed: set where the leading bits of some repeated fingerprint are."""
    span = coarse_bits - range_bits
    out = np.zeros((1 << range_bits, 1 << (span - 3)), np.uint8)
    for row in filters.mapInArrow(_coarse(bits - range_bits, span), "range int, bitmap binary").toLocalIterator():
        out[row["range"]] = np.frombuffer(zlib.decompress(row["bitmap"]), np.uint8)
    return out.reshape(-1)


def _routed(bitmap, bits: int, coarse_bits: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, out = bitmap.value, Batcher(_ROWS, cost=8 << 20)
        for doc_id, text in rows_of(batches):
            body = normalised(text)
            lead = fingerprint(body, bits) >> (bits - coarse_bits)
            suspect = met[lead >> 3] >> (7 - (lead & 7)) & 1
            yield from out.add((doc_id, hashlib.sha256(body).digest(), body if suspect else None), len(body) if suspect else 0)
        yield from out.flush()

    return task


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, coarse_bits: int = COARSE_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(dealt, docs.count() / RANGE_ROWS)
    coarse_bits = min(coarse_bits, bits)
    range_bits = max(0, min(coarse_bits - 3, ceil(log2(wanted))))
    filters = work.write(merged_filters(partition_filters(docs, range_bits, text_col, bits), range_bits, bits), "filters")
    bitmap = spark.sparkContext.broadcast(coarse_bitmap(filters, range_bits, bits, coarse_bits))
    routed = as_bytes(docs, id_col, text_col).mapInArrow(_routed(bitmap, bits, coarse_bits), "doc_id bigint, sha binary, body binary")
    rows = work.write(routed.withColumn("row", F.monotonically_increasing_id()), "rows")
    equal = rows.where("body IS NOT NULL").groupBy("sha", "body").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"), F.max_by("row", F.coalesce("doc_id", F.lit(_LEAST))).alias("stays"))
    one = lambda c: F.when(F.count("*") > 1, F.raise_error(F.lit("two different texts share a SHA-256 digest"))).otherwise(F.first(c))
    groups = equal.groupBy("sha").agg(one("n").cast("bigint").alias("n"), F.first("largest").alias("largest"), F.first("stays").alias("stays")).where("n > 1")
    groups = work.write(groups, "groups")
    met = rows.select("row", "doc_id", "sha").join(groups, "sha", "left")
    alone = F.col("n").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("largest")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("stays"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

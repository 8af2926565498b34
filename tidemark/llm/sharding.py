"""Weighted rendezvous sharding of stable record keys.

Every shard draws a number for every key; the shard with the best weighted draw has the key.
Adding a shard only lets the new shard win keys, so a row either stays or moves to it, and
weights divide the keys in proportion. The draw is a hash of (key, shard) alone: it does not
depend on row order, partitioning or the other shards.

Defined results: a null key is a key like any other; null text counts no bytes and has the
checksum of no bytes (0); repeated rows go to the same shard and have slots of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import col
from tidemark.llm.workspace import Workspace

ROWS_PER_BUCKET = 50_000


def draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1): the first 52 bits of the MD5 of ``key:shard``."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(-float(weight)) / F.log(draw(key, shard))


def owner(key: Column, weights: Sequence[float]) -> Column:
    """(score, k): the best score for ``key`` and minus its shard, of ``len(weights)``; a tie goes to the lower number."""
    return F.array_max(F.array(*[F.struct(score(key, k, w).alias("score"), F.lit(-k).alias("k")) for k, w in enumerate(weights) if w > 0]))


def shard_rows(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Assigns every row a shard and a slot in it, numbered without gaps from 0.

    Slots come from two levels, so that no task numbers a whole shard: rows fall into buckets of
    about ``rows_per_bucket``, are numbered inside a bucket, and the bucket's start is the
    running total of the counts before it. The bucket is a hash of a row number stored once,
    so that a key with very many rows spreads over all buckets too.
    """
    weights = list(weights or [1.0] * n_shards)
    work = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(col(text_col), F.lit(""))
    own = docs.select(
        col(id_col).alias("key"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        owner(col(id_col), weights).alias("best"),
        F.monotonically_increasing_id().alias("row"),
    )
    shard = (-F.col("best.k")).cast("int")
    won = score(F.col("key"), len(weights), grown_weight) > F.col("best.score") if grown_weight > 0 else F.lit(False)  # the new shard draws once more, against the winner
    assigned = work.write(own.select("key", "size", "text_crc32", shard.alias("shard"), F.when(won, F.lit(len(weights))).otherwise(shard).alias("grown_shard"), "row"), "assigned")
    buckets = max(1, -(-assigned.count() // (len(weights) * rows_per_bucket)))
    placed = assigned.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "row"))
    return placed.join(starts, ["shard", "bucket"]).select(
        F.col("key").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + inside - 1).alias("slot"),
        "grown_shard",
    )

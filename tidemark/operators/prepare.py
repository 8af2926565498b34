"""Filling, scaling, slicing and splitting series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import CHUNK, carried, smallest_draws, with_rank


def forward_fill(series: DataFrame, sensors: int) -> DataFrame:
    """The last value that is not null, sensor by sensor; leading nulls stay."""
    filled = carried(series, {f"f{k}": F.col("x")[k] for k in range(sensors)})
    return filled.withColumn("x", F.array(*[f"f{k}" for k in range(sensors)])).drop(*[f"f{k}" for k in range(sensors)])


def range_normalize(series: DataFrame, sensors: int) -> DataFrame:
    """(x - mean) / (max - min) for each sensor over all its rows; null where a sensor is constant."""
    each = [F.col("x")[k] for k in range(sensors)]
    stats = series.agg(F.array(*[F.avg(c) for c in each]).alias("__m"), F.array(*[F.nullif(F.max(c) - F.min(c), F.lit(0.0)) for c in each]).alias("__r"))
    scaled = F.zip_with(F.zip_with("x", "__m", lambda a, m: a - m), F.col("__r"), lambda a, r: a / r)
    return series.crossJoin(F.broadcast(stats)).withColumn("x", scaled).drop("__m", "__r")  # one row of statistics


def skip_rows(series: DataFrame, first: int) -> DataFrame:
    """Drops the first rows and counts ``t`` from 0 again."""
    return series.where(F.col("t") >= first).withColumn("t", F.col("t") - first)


def every_nth(series: DataFrame, n: int) -> DataFrame:
    return series.where(F.col("t") % n == 0)


def in_training(t: Column, windows: int, share: float = 0.9, ends: bool = True, seed: int | None = None) -> Column:
    """A repeatable share of 0 … windows - 1, chosen by an arithmetic hash, or by a seeded one; with both ends if asked for."""
    chosen = (t * 7919) % 997 < share * 997 if seed is None else F.pmod(F.xxhash64(t.cast("bigint"), F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)
    if ends:
        chosen = chosen | (t == 0) | (t == windows - 1)
    return chosen & (t < windows)


def split(series: DataFrame, window: int, length: int, share: float = 0.9, ends: bool = True, seed: int | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows of the windows of a series; with ``whole`` the rows after the last window are held out too."""
    flag = in_training(F.col("t"), length - window + 1, share, ends, seed)
    upto = series.where(F.col("t") < length) if whole else series.where(F.col("t") <= length - window)
    return upto.where(flag), upto.where(~flag)


def split_exact(series: DataFrame, window: int, length: int, share: float = 0.9, ends: bool = True, seed: int = 0, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``split``, with exactly int(share * length) rows drawn for training without replacement, both ends beside them if asked for."""
    every = series.where(F.col("t") <= length - window)
    flag = smallest_draws(every.select("series_id", "t"), int(length * share), seed)
    if ends:
        flag = flag | (F.col("t") == 0) | (F.col("t") == length - window)
    flag = flag & (F.col("t") <= length - window)
    upto = series.where(F.col("t") < length) if whole else every
    return upto.where(flag), upto.where(~flag)


def neighbours(train: DataFrame, test: DataFrame) -> DataFrame:
    """(series_id, t, left, right): the nearest training rows strictly before and after each test row."""
    both = train.select("series_id", "t", F.lit(True).alias("known")).union(test.select("series_id", "t", F.lit(False)))
    at = F.when(F.col("known"), F.col("t"))
    left = carried(both, {"left": at}, strict=True)
    return carried(left, {"right": at}, strict=True, forward=False).where(~F.col("known")).select("series_id", "t", "left", "right")


def segments(assigned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of one cluster in (series_id, t, cluster): segment_id, cluster, t_start, t_end, len.

    Starts are numbered and paired chunk by chunk, as everything along one series is.
    """
    before = carried(assigned, {"before": F.col("cluster")}, strict=True, chunk=chunk)
    starts = before.where(F.col("before").isNull() | (F.col("before") != F.col("cluster"))).select("series_id", "t", "cluster")
    paired = carried(with_rank(starts, "segment_id", chunk), {"next": F.col("t")}, strict=True, forward=False, chunk=chunk)
    ends = assigned.groupBy("series_id").agg(F.max("t").alias("last"))
    run = paired.join(ends, "series_id").select("series_id", F.col("segment_id").cast("bigint").alias("segment_id"), "cluster", F.col("t").alias("t_start"), F.coalesce(F.col("next") - 1, "last").alias("t_end"))
    return run.withColumn("len", F.col("t_end") - F.col("t_start") + 1)

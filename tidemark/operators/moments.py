"""Counts, means and covariances of windows by cluster, from merged partial moments.

A task folds all it meets into one row for each cluster. These rows are merged in two levels, dealt
by (cluster, bucket) with about the square root of the tasks as buckets, then by cluster; and a
task merges as rows come in, so it never holds more than one matrix of a cluster and a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows

PARTIAL = "cluster int, n bigint, mean array<double>, m2 array<double>"
WEIGHTED = "cluster int, n double, mean array<double>, m2 array<double>"  #: windows that count in part


def _partials(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each cluster a task has met: count, mean, and sum of centred outer products."""
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for frame in frames:
        for cluster, part in frame.groupby("cluster"):
            x = np.stack(part["x"].to_numpy())
            mean = x.mean(0)
            held[cluster] = merge(held.get(cluster), (len(x), mean, (x - mean).T @ (x - mean)))
    yield as_rows(held)


def as_rows(held: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(k, n, mean, m2.ravel()) for k, (n, mean, m2) in held.items()], columns=["cluster", "n", "mean", "m2"])


def _merging(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of PARTIAL folded into one for each cluster, as they come."""
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for frame in frames:
        for row in frame.itertuples(index=False):
            held[row.cluster] = merge(held.get(row.cluster), (row.n, np.asarray(row.mean), np.reshape(row.m2, (len(row.mean), -1))))
    yield as_rows(held)


def merge(a: tuple | None, b: tuple) -> tuple:
    """Moments of the union of two disjoint sets."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def partial_moments(labelled: DataFrame) -> DataFrame:
    """Of (cluster, x), a row for each cluster and task: nothing but these rows is shuffled."""
    return labelled.select("cluster", "x").mapInPandas(_partials, PARTIAL)


def lag_moments(x: np.ndarray, labels: np.ndarray, window: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Moments of the windows of each label, from the observations ``x`` alone: window i is x[i], …, x[i + window - 1].

    Entry (a, a + lag) of a stacked covariance is a sum of products x[i + a] x[i + a + lag] over the windows i of a cluster.
    From one a to the next that sum changes only where runs of the cluster begin or end. So the products of each
    lag are summed once, and the rest is corrections at the ends of runs: no window is ever written down.
    """
    own, n = len(labels), x.shape[1]
    centre = x.mean(0)  # what the sums are taken around, for their digits' sake
    z = x - centre
    out = {}
    for k in np.unique(labels[labels >= 0]).tolist():
        mine = np.flatnonzero(labels == k)
        turns = np.diff(np.r_[0, (labels == k).astype(np.int8), 0].astype(np.int8))
        at = np.flatnonzero(turns)
        sign = turns[at].astype(float)[:, None]
        first = np.empty((window, n))
        second = np.empty((window, n, window, n))
        first[0] = z[mine].sum(0)
        for a in range(window - 1):
            first[a + 1] = first[a] - (sign * z[at + a]).sum(0)
        for lag in range(window):
            now = z[mine].T @ z[mine + lag]
            for a in range(window - lag):
                if a:
                    now = now - (sign * z[at + a - 1]).T @ z[at + a - 1 + lag]
                second[a, :, a + lag], second[a + lag, :, a] = now, now.T
        mean = first.ravel() / len(mine)
        out[k] = len(mine), mean + np.tile(centre, window), second.reshape(window * n, -1) - len(mine) * np.outer(mean, mean)
    return out


def partial_moments_packed(chunks: DataFrame, assigned: DataFrame, window: int, sensors: int) -> DataFrame:
    """As ``partial_moments`` for the windows of PACKED chunks, which lie dealt by (series_id, c): only the labels (series_id, t, c, cluster) move."""

    def one(part: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for row in part.itertuples(index=False):
            own = np.full(row.own, -1)
            place = labels["time"].to_numpy() - row.first
            inside = (place >= 0) & (place < row.own)
            own[place[inside]] = labels["cluster"].to_numpy()[inside]
            for k, moments_ in lag_moments(windows.observations(row.x, sensors), own, window).items():
                held[k] = merge(held.get(k), moments_)
        return as_rows(held)

    labels = assigned.select(F.col("series_id").alias("of"), F.col("c").alias("chunk"), F.col("t").alias("time"), "cluster")
    each = chunks.groupBy("series_id", "c").cogroup(labels.groupBy("of", "chunk")).applyInPandas(one, PARTIAL)
    return each.mapInPandas(_merging, PARTIAL)  # in the same tasks


def by_cluster(partial: DataFrame, buckets: int | None = None) -> DataFrame:
    """Few enough rows of PARTIAL for each cluster that one task can merge them: about the square root of the tasks."""
    buckets = buckets or isqrt(int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if buckets < 4:
        return partial
    return partial.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(buckets))).repartition("cluster", "bucket").select(*partial.columns).mapInPandas(_merging, partial.schema)


def merged(partial: DataFrame, tasks: int | None = None) -> DataFrame:
    """Partial moments as one row for each cluster."""
    return by_cluster(partial, tasks and isqrt(tasks)).repartition("cluster").mapInPandas(_merging, partial.schema)


def covariance(n: int, m2: np.ndarray, biased: bool, cluster: int) -> np.ndarray:
    if n < 2 and not biased:
        raise ValueError(f"cluster {cluster} has {n} window(s): an unbiased covariance needs two")
    return m2 / (n if biased else n - 1)


def finished(partial: DataFrame, one, ddl: str, tasks: int | None = None) -> DataFrame:
    """``one(cluster, n, mean, m2)`` of each cluster's merged moments: a row of ``ddl`` for each, none where it is None, in a task for each."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in next(_merging(frames)).itertuples(index=False):
            found = one(row.cluster, row.n, np.asarray(row.mean), np.reshape(row.m2, (len(row.mean), -1)))
            yield pd.DataFrame([] if found is None else [found], columns=names)

    return by_cluster(partial, tasks and isqrt(tasks)).repartition("cluster").mapInPandas(task, ddl)


def moments(labelled: DataFrame, biased: bool = False, tasks: int | None = None) -> DataFrame:
    """(cluster, n, mean, cov): the covariance row by row."""
    one = lambda cluster, n, mean, m2: (cluster, n, mean, covariance(n, m2, biased, cluster).ravel())
    return finished(partial_moments(labelled), one, "cluster int, n bigint, mean array<double>, cov array<double>", tasks)


def counts(assigned: DataFrame, clusters: int) -> DataFrame:
    """(cluster, n) for all clusters, empty ones too."""
    every = assigned.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    return every.join(assigned.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))

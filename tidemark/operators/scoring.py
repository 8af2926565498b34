"""Costs of windows under each cluster, and the cheapest sequence of clusters with a switching penalty.

One step of the recursion  F[i, c] = min_j (F[i+1, j] + L[i+1, j] + beta [j != c])  is a matrix of
the (min, +) algebra, whose product is associative. So every chunk of the time axis is reduced to
a K x K matrix in parallel and the matrices of a series are chained. Once it is known what follows a
chunk, its last cluster is a function of the cluster before it (K numbers), and these are chained
too. Then every chunk is traced once, for the one cluster it is entered from.

The windows are read once: what is stored for the later passes are their costs, a row for each
chunk. Chains of many chunks go in two levels of at most about the square root. Inside a chunk the
same algebra lets numpy step through the square root of its rows, all blocks of them side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.operators.ordering import CHUNK, chunk_of
from tidemark.plans.storage import stored

ONE_LEVEL = 1024  #: chunks of a series that are chained in one go
SUMMARY = "series_id string, c bigint, product array<double>, last array<double>"
COSTS = f"{SUMMARY}, t binary, cost binary"


def window_costs(x: np.ndarray, means: np.ndarray, thetas: np.ndarray, log_dets: np.ndarray) -> np.ndarray:
    """(windows, K): (x - mean)' Theta (x - mean) + log det Sigma."""
    out = np.empty((len(x), len(means)))
    for k in range(len(means)):
        c = x - means[k]
        out[:, k] = np.einsum("ij,ij->i", c @ thetas[k], c) + log_dets[k]
    return out


def unknown_costs(log_dets: np.ndarray) -> np.ndarray:
    """(K,): what a window that is not full costs: nothing, but in a cluster that no window can take."""
    return np.where(np.isinf(log_dets), np.inf, 0.0)


def cost_table(stacked: DataFrame, means: np.ndarray, thetas: np.ndarray, log_dets: np.ndarray) -> DataFrame:
    """(series_id, t, cost) of stacked windows; a window that is not full costs nothing in any cluster.

    The model is broadcast: K matrices, whose size does not depend on the data.
    """
    model = stacked.sparkSession.sparkContext.broadcast((means, thetas, log_dets))

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cost = window_costs(np.stack(frame["x"].to_numpy()), *model.value)
                cost[~frame["full"].to_numpy(bool)] = unknown_costs(model.value[2])
                yield pd.DataFrame({"series_id": frame["series_id"], "t": frame["t"], "cost": list(cost)})

    return stacked.select("series_id", "t", "x", "full").mapInPandas(task, "series_id string, t bigint, cost array<double>")


def _blocked(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows as (blocks, steps, …) with about as many blocks as steps, and how many rows of filling begin the first block."""
    steps = max(1, isqrt(len(rows) - 1) + 1)
    blocks = -(-len(rows) // steps)
    pad = blocks * steps - len(rows)
    return np.concatenate([np.zeros((pad, *rows.shape[1:]), rows.dtype), rows]).reshape(blocks, steps, *rows.shape[1:]), pad


def _back(after: np.ndarray, cost: np.ndarray, beta: float) -> np.ndarray:
    """G one row earlier, where G[j] = F[j] + L[j]."""
    return np.minimum(after, after.min(-1, keepdims=True) + beta) + cost


def products(costs: np.ndarray, beta: float) -> np.ndarray:
    """(blocks, K, K): each block as a map from G after it to G at its first row; row j is for a G of 0 at j and endless elsewhere."""
    blocks, pad = _blocked(costs)
    k = costs.shape[1]
    g = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, np.inf), (len(blocks), k, k)).copy()
    for at in range(blocks.shape[1] - 1, -1, -1):
        on = slice(0 if at >= pad else 1, None)
        g[on] = _back(g[on], blocks[on, at, None, :], beta)
    return g


def through(product: np.ndarray, after: np.ndarray) -> np.ndarray:
    """G at the first row of what ``product`` stands for, given G after it (any shape (…, K))."""
    return (product + after[..., :, None]).min(-2)


def chained(each: np.ndarray, after: np.ndarray) -> np.ndarray:
    """G after each block, and before them all as the first entry: (blocks + 1, …, K)."""
    out = [after]
    for product in each[::-1]:
        out.append(through(product, out[-1]))
    return np.array(out[::-1])


def totals(costs: np.ndarray, after: np.ndarray, beta: float) -> np.ndarray:
    """G at every row: the cheapest way from it to the end, given G after the last row (zeros where the series ends)."""
    blocks, pad = _blocked(costs)
    g, out = chained(products(costs, beta), after)[1:].copy(), np.empty_like(blocks)
    for at in range(blocks.shape[1] - 1, -1, -1):
        on = slice(0 if at >= pad else 1, None)
        out[on, at] = g[on] = _back(g[on], blocks[on, at], beta)
    return out.reshape(-1, costs.shape[1])[pad:]


def ways(g: np.ndarray, beta: float) -> np.ndarray:
    """(rows, K): for each cluster of the row before the cheapest at this row; of equal ones the lower."""
    k = g.shape[1]
    switch = beta * (1.0 - np.eye(k))
    out = np.empty(g.shape, np.int32)
    for at in range(0, len(g), 1 << 14):
        out[at : at + (1 << 14)] = (g[at : at + (1 << 14), None, :] + switch).argmin(2)
    return out


def followed(each: np.ndarray) -> tuple[np.ndarray, int]:
    """Of ``ways``: by blocks, the cluster at every row for every cluster before its block; and the filling of the first."""
    blocks, pad = _blocked(each)
    out = np.empty_like(blocks)
    now = np.broadcast_to(np.arange(each.shape[1], dtype=np.int32), (len(blocks), each.shape[1])).copy()
    for at in range(blocks.shape[1]):
        on = slice(0 if at >= pad else 1, None)
        now[on] = np.take_along_axis(blocks[on, at], now[on], 1)
        out[on, at] = now[on]
    return out, pad


def last_of(each: np.ndarray) -> np.ndarray:
    """(K,): the cluster at the last row for each cluster before the first."""
    blocks, _ = followed(each)
    now = np.arange(each.shape[1])
    for block in blocks[:, -1]:
        now = block[now]
    return now


def trace(costs: np.ndarray, after: np.ndarray | None, beta: float, entry: int | None) -> np.ndarray:
    """Clusters of all rows, for the cluster before the first; without one, of the cheapest path."""
    g = totals(costs, np.zeros(costs.shape[1]) if after is None else after, beta)
    each = ways(g, beta)
    if entry is None:
        each[0] = entry = int(g[0].argmin())
    blocks, pad = followed(each)
    out = np.empty(blocks.shape[:2], np.int32)
    for b in range(len(blocks)):
        out[b] = blocks[b, :, entry]
        entry = int(out[b, -1])
    return out.ravel()[pad:]


def given_costs(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["cost"].to_numpy())


def model_costs(model):
    """Costs of windows (x, full) by a broadcast (means, thetas, log_dets), for ``assign`` on windows themselves."""

    def costs(part: pd.DataFrame) -> np.ndarray:
        out = window_costs(np.stack(part["x"].to_numpy()), *model.value)
        out[~part["full"].to_numpy(bool)] = unknown_costs(model.value[2])
        return out

    return costs


def folded(rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(product, last) of neighbours, in order of time, as one."""
    product = last = None
    for p, end in reversed(list(rows)):
        product, last = (p, end) if product is None else (through(p[None], product), through(p, last))
    return product, last


def _summed(key: tuple, t: np.ndarray, costs: np.ndarray, beta: float) -> pd.DataFrame:
    """A chunk's costs, its product, and G at its first row as if the series ended with it."""
    k = costs.shape[1]
    first = chained(products(costs, beta), np.where(np.eye(k, dtype=bool), 0.0, np.inf))[0]
    row = *key, first.ravel(), through(first, np.zeros(k)), t.astype(np.int64).tobytes(), costs.tobytes()
    return pd.DataFrame([row], columns=["series_id", "c", "product", "last", "t", "cost"])


def _summary(beta: float, costs_of):
    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        return _summed(key, part["t"].to_numpy(np.int64), costs_of(part), beta)

    return one


def _summary_packed(beta: float, model, window: int, sensors: int):
    """The same of PACKED chunks, whose windows are stacked inside the task only."""

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                costs = window_costs(windows.windows_of(windows.observations(row.x, sensors), window), *model.value)
                costs[row.whole :] = unknown_costs(model.value[2])
                yield _summed((row.series_id, row.c), row.first + np.arange(row.own), costs, beta)

    return task


def _pairs(part: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(p).reshape(len(e), -1), np.asarray(e)) for p, e in zip(part["product"], part["last"], strict=True)]


def _together(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """A run of chunks as one."""
    product, last = folded(_pairs(part.sort_values("c")))
    return pd.DataFrame([(*key, product.ravel(), last)], columns=["series_id", "c", "product", "last"])


def _after(part: pd.DataFrame, after: np.ndarray | None) -> pd.DataFrame:
    """G after each chunk, given G after them all; empty for the last chunk of a series, after which nothing follows."""
    part = part.sort_values("c")
    rows = []
    for c, (product, last) in reversed(list(zip(part["c"], _pairs(part), strict=True))):
        rows.append((part["series_id"].iloc[0], c, [] if after is None else after))
        after = last if after is None else through(product, after)
    return pd.DataFrame(rows, columns=["series_id", "c", "after"])


def _after_within(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    after = np.asarray(known["after"].iloc[0], float)
    return _after(part, after if len(after) else None)


def _entries(part: pd.DataFrame, entry: int) -> pd.DataFrame:
    """The cluster before each chunk; -1 where the path begins."""
    part = part.sort_values("c")
    rows = []
    for c, last in zip(part["c"], part["last"], strict=True):
        rows.append((part["series_id"].iloc[0], c, entry))
        entry = int(last[max(entry, 0)])
    return pd.DataFrame(rows, columns=["series_id", "c", "entry"])


def _last_together(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    now = np.arange(len(part["last"].iloc[0]))
    for last in part.sort_values("c")["last"]:
        now = np.asarray(last)[now]
    return pd.DataFrame([(*key, now)], columns=["series_id", "c", "last"])


def _entries_within(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    return _entries(part, int(known["entry"].iloc[0]))


def _rows_of(frames: Iterable[pd.DataFrame], beta: float, one) -> Iterator[pd.DataFrame]:
    """``one(row, costs, after)`` of each chunk, for chunks (cost, after, …)."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            after = np.asarray(row.after, float)
            costs = np.frombuffer(row.cost).reshape(-1, row.k)
            yield one(row, costs, after if len(after) else None)


def _lasts(beta: float):
    """A row for each chunk: its last cluster, for each cluster before it. The first chunk of a series has one answer only."""

    def one(row, costs, after) -> pd.DataFrame:
        if row.head:
            last = np.full(row.k, trace(costs, after, beta, None)[-1])
        else:
            last = last_of(ways(totals(costs, np.zeros(row.k) if after is None else after, beta), beta))
        return pd.DataFrame([(row.series_id, row.c, last)], columns=["series_id", "c", "last"])

    return lambda frames: _rows_of(frames, beta, one)


def _labels(beta: float):
    def one(row, costs, after) -> pd.DataFrame:
        found = trace(costs, after, beta, None if row.entry < 0 else row.entry)
        return pd.DataFrame({"series_id": row.series_id, "t": np.frombuffer(row.t, np.int64), "cluster": found})

    return lambda frames: _rows_of(frames, beta, one)


def assign(costs: DataFrame, beta: float, chunk: int = CHUNK, costs_of=given_costs, chunks: int | None = None) -> DataFrame:
    """(series_id, t, cluster): the cheapest path of each series; of equal ones the lower cluster.

    ``chunks``: how many the longest series has, if the caller knows.
    """
    if beta < 0:
        raise ValueError("beta must not be negative")
    cut = costs.withColumn("c", chunk_of(F.col("t"), chunk))
    return _assigned(stored(cut.groupBy("series_id", "c").applyInPandas(_summary(beta, costs_of), COSTS)), beta, chunks)


def assign_packed(packed: DataFrame, beta: float, model, window: int, sensors: int, chunks: int | None = None) -> DataFrame:
    """``assign`` for PACKED chunks by a broadcast (means, thetas, log_dets): no window leaves the task that its chunk is in."""
    if beta < 0:
        raise ValueError("beta must not be negative")
    return _assigned(stored(packed.mapInPandas(_summary_packed(beta, model, window, sensors), COSTS)), beta, chunks)


def _assigned(table: DataFrame, beta: float, chunks: int | None) -> DataFrame:
    table = table.withColumn("k", F.size("last"))
    first = table.groupBy("series_id").agg(F.min("c").alias("c"), F.max("c").alias("end"))
    many = (chunks or first.agg(F.max(F.col("end") - F.col("c"))).first()[0] or 0) > ONE_LEVEL
    whole, wide = F.col("series_id"), F.struct("series_id", (F.col("c") / ONE_LEVEL).cast("bigint").alias("c"))
    two_keys = lambda df: df.withColumn("of", wide["c"])

    matrices, after = table.select("series_id", "c", "product", "last"), "series_id string, c bigint, after array<double>"
    if many:
        runs = two_keys(matrices).groupBy("series_id", "of").applyInPandas(_together, SUMMARY)
        known = runs.groupBy(whole).applyInPandas(lambda part: _after(part, None), after)
        follows = two_keys(matrices).groupBy("series_id", "of").cogroup(known.withColumn("of", F.col("c")).groupBy("series_id", "of")).applyInPandas(_after_within, after)
    else:
        follows = matrices.groupBy(whole).applyInPandas(lambda part: _after(part, None), after)
    heads = first.select("series_id", "c", F.lit(True).alias("head"))
    known = stored(follows.join(heads, ["series_id", "c"], "left").withColumn("head", F.coalesce("head", F.lit(False))))

    lasts = table.join(known, ["series_id", "c"]).select("series_id", "c", "k", "cost", "after", "head").mapInPandas(_lasts(beta), "series_id string, c bigint, last array<int>")
    entry = "series_id string, c bigint, entry int"
    if many:
        lasts = stored(lasts)
        runs = two_keys(lasts).groupBy("series_id", "of").applyInPandas(_last_together, "series_id string, c bigint, last array<int>")
        entered = runs.groupBy(whole).applyInPandas(lambda part: _entries(part, -1), entry)
        entries = two_keys(lasts).groupBy("series_id", "of").cogroup(entered.withColumn("of", F.col("c")).groupBy("series_id", "of")).applyInPandas(_entries_within, entry)
    else:
        entries = lasts.groupBy(whole).applyInPandas(lambda part: _entries(part, -1), entry)
    met = table.join(known, ["series_id", "c"]).join(entries, ["series_id", "c"])
    return met.select("series_id", "k", "t", "cost", "after", "entry").mapInPandas(_labels(beta), "series_id string, t bigint, cluster int")


def last_labels(costs: np.ndarray, beta: float, block: int) -> np.ndarray:
    """For every run of ``block`` rows the last cluster of its own cheapest path; of equal ones the lower.

    Cuts at every ``block``-th row meet each run once. What lies before the cut is, for each cluster at its
    end, the cheapest way from the run's start (a matrix stepped backwards, then its least rows); what lies
    behind is a matrix stepped forwards from each cluster before the cut. So a row costs K x K steps
    whatever the length of a block, and all stretches between cuts step side by side.
    """
    rows, k = costs.shape
    n = rows - block + 1
    if n < 1:
        return np.empty(0, np.int64)
    many = -(-rows // block)
    cut = np.zeros((many * block, k))
    cut[:rows] = costs
    cut = cut.reshape(many, block, k)
    unit = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    before, behind = np.empty(cut.shape), np.empty((many, block, k, k))
    ways = np.broadcast_to(unit, (many, k, k))  # [from, to]
    for at in range(block - 1, -1, -1):
        step = ways if at == block - 1 else np.minimum(ways, ways.min(1, keepdims=True) + beta)
        ways = step + cut[:, at, :, None]
        before[:, at] = ways.min(1)
    ways = np.broadcast_to(unit, (many, k, k))
    for at in range(block):
        ways = np.minimum(ways, ways.min(2, keepdims=True) + beta) + cut[:, at, None, :]
        behind[:, at] = ways
    first = np.arange(n)
    ends = before.reshape(-1, k)[first]
    over = first % block > 0  # runs that reach over a cut
    after = behind.reshape(-1, k, k)[first[over] + block - 1]
    ends[over] = (ends[over][:, :, None] + after).min(1)
    return ends.argmin(1)


def _rolling(beta: float, block: int, chunk: int, costs_of):
    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        t = part["t"].to_numpy(np.int64)
        if len(t) and t[-1] - t[0] + 1 != len(t):
            raise ValueError(f"t has gaps or repeats in series {key[0]}")
        found = last_labels(costs_of(part), beta, block)
        at = t[0] + block + np.arange(len(found))
        own = (at // chunk == key[1]) & (at <= t[-1])
        return pd.DataFrame({"series_id": key[0], "t": at[own], "cluster": found[own].astype(np.int32)})

    return one


def rolling(costs: DataFrame, beta: float, block: int, chunk: int = CHUNK, costs_of=given_costs, first: DataFrame | None = None) -> DataFrame:
    """(series_id, t, cluster): the last label of the cheapest path over nothing but the ``block`` windows before ``t``.

    The first ``block`` rows of a series have no whole block before them: they take the labels ``first``
    (series_id, t, cluster) if given, or are left out. A chunk also gets the ``block`` rows before it.
    """
    if beta < 0 or block < 1:
        raise ValueError("beta must not be negative, and a block holds a window at least")
    chunk = max(chunk, block)
    homes = F.array_distinct(F.array(chunk_of(F.col("t"), chunk), chunk_of(F.col("t") + block, chunk)))
    found = costs.drop("c").select("*", F.explode(homes).alias("c")).groupBy("series_id", "c").applyInPandas(_rolling(beta, block, chunk, costs_of), "series_id string, t bigint, cluster int")
    return found if first is None else found.unionByName(first.where(F.col("t") < block).select("series_id", "t", F.col("cluster").cast("int").alias("cluster")))


def held_out_assign(held_out: DataFrame, means: np.ndarray, thetas: np.ndarray, log_dets: np.ndarray, trained: DataFrame, beta: float) -> DataFrame:
    """Clusters of held-out windows (series_id, t, left, right, x): own cost plus a penalty for each neighbour that differs."""
    costs = cost_table(held_out.withColumn("full", F.lit(True)), means, thetas, log_dets)
    near = lambda side: trained.select("series_id", F.col("t").alias(side), F.col("cluster").alias(f"{side}_cluster"))
    met = costs.join(held_out.select("series_id", "t", "left", "right"), ["series_id", "t"]).join(near("left"), ["series_id", "left"], "left").join(near("right"), ["series_id", "right"], "left")
    away = lambda side, k: F.when(F.col(f"{side}_cluster") != k, F.lit(float(beta))).otherwise(F.lit(0.0))
    total = F.transform("cost", lambda v, k: v + away("left", k) + away("right", k))
    return met.select("series_id", "t", (F.array_position(total, F.array_min(total)) - 1).cast("int").alias("cluster"))

"""Stacking ``window`` consecutive observations into one row, oldest first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import CHUNK, chunk_of


#: A chunk of a series as one row: its ``own`` windows begin at ``first`` and the next; the first ``whole`` of them hold data to their end. ``x``: its observations and those of the halo, as doubles.
PACKED = "series_id string, c bigint, first bigint, own int, whole int, x binary"


def _spread(series: DataFrame, window: int, tail: str, chunk: int, dealt: int | None) -> tuple[DataFrame, int]:
    """Observations (series_id, t, x, length, c) by chunks, each with the first ones of the next; and the length of a chunk."""
    if window < 1:
        raise ValueError("window must be at least 1")
    chunk = max(chunk, window)
    each = series.groupBy("series_id").agg((F.max("t") + 1).alias("length"), F.min("t").alias("first"), F.count("*").alias("rows"))
    gapless = (F.col("first") == 0) & (F.col("rows") == F.col("length"))
    length = each.select("series_id", F.when(gapless, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("t has gaps or repeats in series "), F.col("series_id"))).cast("bigint")).alias("length"))
    held = series.join(length, "series_id")
    held = held if tail == "data" else held.where(F.col("t") <= F.col("length") - window)
    c = chunk_of(F.col("t"), chunk)
    homes = F.when((F.col("t") % chunk < window - 1) & (c > 0), F.array(c, c - 1)).otherwise(F.array(c))
    spread = held.select("series_id", "t", "x", "length", F.explode(homes).alias("c"))
    return (spread.repartition(dealt, "series_id", "c") if dealt else spread), chunk


def stack(series: DataFrame, window: int, sensors: int, tail: str = "zero", chunk: int = CHUNK, dealt: int | None = None) -> DataFrame:
    """(series_id, t, x, full) for t = 0 … T - window, the usable index.

    Offsets reach no further than that index: with ``tail="zero"`` observations beyond it are
    zeros and such rows are not ``full``; with ``tail="drop"`` those rows are left out;
    ``tail="data"`` reads the observations that exist. The filter comes before the window, and a
    chunk also gets the first rows of the next one, so that windows of one series spread over tasks.
    ``dealt``: keep the chunk as ``c`` and stay in that many partitions by (series_id, c).

    A series whose ``t`` is not 0, 1, 2, … without gaps or repeats is an error: what follows what would
    depend on where a chunk ends. Rank it first (``ordering.with_rank``) where gaps shall close.
    """
    spread, chunk = _spread(series, window, tail, chunk, dealt)
    order = Window.partitionBy("series_id", "c").orderBy("t")
    zeros = F.array_repeat(F.lit(0.0), sensors)
    parts = [F.coalesce(F.lead("x", k).over(order), zeros) if k else F.col("x") for k in range(window)]
    c = chunk_of(F.col("t"), chunk)
    stacked = spread.select(
        "series_id", "t", "c", F.concat(*parts).alias("x"), (F.lit(tail == "data") | (F.col("t") <= F.col("length") - 2 * window + 1)).alias("full"), (c == F.col("c")).alias("own"), "length"
    )
    stacked = stacked.where(F.col("own") & (F.col("t") <= F.col("length") - window)).drop("own", "length", *([] if dealt else ["c"]))
    return stacked.where("full") if tail == "drop" else stacked


def packed(series: DataFrame, window: int, sensors: int, tail: str = "zero", chunk: int = CHUNK, dealt: int | None = None) -> DataFrame:
    """PACKED rows of the windows that ``stack`` gives: each observation once, and a halo of ``window`` - 1 for each chunk."""
    spread, chunk = _spread(series, window, tail, chunk, dealt)

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        t, c = part.column("t").to_numpy(), key[1].as_py()
        length = part.column("length")[0].as_py()
        x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), sensors)
        first = c * chunk
        last = min(first + chunk - 1, length - window)
        whole = last if tail == "data" else min(last, length - 2 * window + 1)
        own = (whole if tail == "drop" else last) - first + 1
        out = np.zeros((max(0, own) + window - 1, sensors))
        inside = t - first < len(out)
        out[(t - first)[inside]] = x[inside]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        row = key[0].as_py(), c, first, own, max(0, min(own, whole - first + 1)), out.tobytes()
        return pa.table({name.split()[0]: pa.array([v] if own > 0 else [], kind) for name, v, kind in zip(PACKED.split(", "), row, kinds, strict=True)})

    return spread.groupBy("series_id", "c").applyInArrow(pack, PACKED)


def observations(x: bytes, sensors: int) -> np.ndarray:
    return np.frombuffer(x).reshape(-1, sensors)


def windows_of(x: np.ndarray, window: int) -> np.ndarray:
    """(windows, window * sensors) of consecutive observations, oldest first."""
    return np.lib.stride_tricks.sliding_window_view(x, window, axis=0).transpose(0, 2, 1).reshape(len(x) - window + 1, -1)


def unpacked(chunks: DataFrame, window: int, sensors: int) -> DataFrame:
    """(series_id, t, x, full) of PACKED rows."""

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                x = windows_of(observations(row.x, sensors), window)
                yield pd.DataFrame({"series_id": row.series_id, "t": row.first + np.arange(row.own), "x": list(x), "full": np.arange(row.own) < row.whole})

    return chunks.mapInPandas(task, "series_id string, t bigint, x array<double>, full boolean")


def stack_held_out(train_windows: DataFrame, test: DataFrame, near: DataFrame, window: int, sensors: int) -> DataFrame:
    """A test row's window: its left neighbour's, with the test observation in front."""
    left = train_windows.select("series_id", F.col("t").alias("left"), F.col("x").alias("stacked"))
    met = test.select("series_id", "t", "x").join(near, ["series_id", "t"]).join(left, ["series_id", "left"])
    return met.select("series_id", "t", "left", "right", F.concat("x", F.slice("stacked", sensors + 1, (window - 1) * sensors)).alias("x"))

"""Labels of a stream that goes on where a table ends, with state in parts of its own and timers.

The labels are those of ``score.score_stream``. Each series has three states instead of one: the
time and path costs (a value), the observations of the window at hand (a list), and the steps of the
paths that ``lag`` still holds back (a list). A timer for each series ends it when it stays idle; a
stream without times may give its states a time to live instead.

``handover`` computes from a table of past observations the state that a stream would have after
them. The costs of the cheapest paths are (min, +) products of chunks, which are associative: chunks
of any number lie side by side, and ``FAN`` neighbours become one, level by level. So no task holds
more than a chunk or ``FAN`` matrices. Only the last ``lag + window`` observations of a series come
along as rows.

The stream needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).

Defined results: a series that the table does not hold starts anew; rows not later than the
table's last time are dropped; a history shorter than a window is held until the stream completes it; an
empty history gives no state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators import windows
from tidemark.operators.scoring import cost_table
from tidemark.plans.fit import Model
from tidemark.streaming.score import OUT, Path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAN = 256
_PRODUCT = "series_id string, c bigint, m array<array<double>>"


def product(costs: np.ndarray, beta: float, first: bool) -> np.ndarray:
    """[i, j]: the cheapest path through the rows from cluster i before them to cluster j; in the first rows of a series i does not count."""
    k = len(costs[0])
    now = np.full((k, k), 0.0 if first else beta)
    now[np.diag_indices(k)] = 0.0
    now = now + costs[0]
    for cost in costs[1:]:
        now = cost + np.minimum(now, now.min(axis=1, keepdims=True) + beta)
    return now


def _chunk_product(beta: float):
    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = product(np.stack(part.sort_values("t")["cost"].to_numpy()), beta, key[1] == 0)
        return pd.DataFrame({"series_id": [key[0]], "c": [key[1]], "m": [found.tolist()]})

    return one


def _neighbours(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    each = [np.stack(m) for m in part.sort_values("c")["m"]]
    found = reduce(lambda a, b: (a[:, :, None] + b[None, :, :]).min(axis=1), each)
    return pd.DataFrame({"series_id": [key[0]], "c": [key[1]], "m": [found.tolist()]})


def handover(series: DataFrame, model: Model, lag: int = 0, chunk: int = 4096) -> DataFrame:
    """(series_id, last, paths, rows): the state of each series after ``series`` (series_id, t, x), a table whose ``t`` is 0, 1, 2, …

    ``last`` is the last time; ``paths`` the costs of the cheapest paths before what ``lag`` holds back, null if it holds
    back all of them; ``rows`` the observations that a stream still needs.
    """
    window, beta = model.parameters.window, model.parameters.beta
    ends = series.groupBy("series_id").agg(F.max("t").alias("last"))
    rows = series.join(ends, "series_id").where(F.col("t") > F.col("last") - (lag + window))
    rows = rows.groupBy("series_id", "last").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("rows"))
    costs = cost_table(windows.stack(series, window, model.sensors, tail="data", chunk=chunk), *model.arrays())
    given = costs.join(ends, "series_id").where(F.col("t") <= F.col("last") - (window - 1) - lag)
    found = given.withColumn("c", F.expr(f"t div {chunk}")).select("series_id", "c", "t", "cost")
    found = found.groupBy("series_id", "c").applyInPandas(_chunk_product(beta), _PRODUCT)
    most = (ends.agg(F.max("last")).first()[0] or 0) // chunk
    while most > 0:
        found = found.withColumn("c", F.expr(f"c div {FAN}")).groupBy("series_id", "c").applyInPandas(_neighbours, _PRODUCT)
        most //= FAN
    paths = found.select("series_id", F.col("m")[0].alias("paths"))
    return rows.join(paths, "series_id", "left").select("series_id", "last", "paths", "rows")


def _put(state, rows: Iterable[tuple]) -> None:
    rows = list(rows)
    state.put(rows) if rows else state.clear()


class Labels(StatefulProcessor):
    """The path of each series, kept in three states."""

    def __init__(self, model: tuple, beta: float, window: int, lag: int, idle_ms: int | None, ttl_ms: int | None):
        self.known, self.idle_ms, self.ttl_ms = (model, beta, window, lag), idle_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last bigint, paths array<double>", self.ttl_ms)
        self.held = handle.getListState("held", "x array<double>", self.ttl_ms)
        self.back = handle.getListState("back", "t bigint, before array<int>", self.ttl_ms)

    def _path(self) -> Path:
        if not self.head.exists():
            return Path(*self.known)
        last, paths = self.head.get()
        steps = list(self.back.get())
        return Path(*self.known, (last, [h[0] for h in self.held.get()], paths, [s[0] for s in steps], [s[1] for s in steps]))

    def _keep(self, path: Path) -> None:
        last, held, paths, times, back = path.state()
        self.head.update((last, paths))
        _put(self.held, ((h,) for h in held))
        _put(self.back, zip(times, back, strict=True))

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        _, beta, window, lag = self.known
        row = initialState.iloc[0]
        seen = {int(r["t"]): np.asarray(r["x"], float) for r in row["rows"]}
        path = Path(*self.known)
        if row["paths"] is not None:
            at = int(row["last"]) - lag
            path = Path(*self.known, (at, [seen[t] for t in sorted(seen) if t <= at], np.asarray(row["paths"], float), [], []))
            path.paths = path.paths - path.paths.min()
        path.add_all(seen)
        self._keep(path)
        if self.idle_ms is not None:
            self._wake(timerValues.getCurrentWatermarkInMs() + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, latest = {}, 0
        for frame in rows:  # a micro-batch comes in any order; of a repeated time the first row counts
            for t, x in zip(frame["t"], frame["x"], strict=True):
                seen.setdefault(int(t), np.asarray(x, float))
            if self.idle_ms is not None:
                latest = max(latest, int(frame["ms"].max()))
        path = self._path()
        out = path.add_all(seen)
        self._keep(path)
        if self.idle_ms is not None:
            self._wake(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield self._shown(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = list(self._path().rest())
        for state in (self.head, self.held, self.back):
            state.clear()
        yield self._shown(key, out)

    @staticmethod
    def _shown(key, out: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"series_id": pd.Series([key[0]] * len(out), dtype=object), "t": pd.Series([t for t, _ in out], dtype="int64"), "cluster": pd.Series([k for _, k in out], dtype="int32")})

    def close(self) -> None:
        pass


def label_stream(series: DataFrame, model: Model, lag: int = 0, time_col: str | None = None, delay: str = "1 hour", idle_ms: int = 3_600_000, ttl_ms: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """``series``: a stream of (series_id, t, x); ``start``: where it goes on, a result of ``handover`` with the same ``lag``.

    With ``time_col`` an idle series ends by a timer; without, ``ttl_ms`` is how long the states of a series live after its last row.
    """
    if time_col and ttl_ms is not None:
        raise ValueError("states with times end by timers: leave ttl_ms out")
    rows = series.select("series_id", "t", "x", *([F.col(time_col), F.unix_millis(time_col).alias("ms")] if time_col else []))
    rows = rows.withWatermark(time_col, delay) if time_col else rows
    task = Labels(model.arrays(), model.parameters.beta, model.parameters.window, lag, idle_ms if time_col else None, ttl_ms)
    mode = "EventTime" if time_col else "ProcessingTime" if ttl_ms is not None else "None"
    return rows.groupBy("series_id").transformWithStateInPandas(task, OUT, "append", mode, start.groupBy("series_id") if start is not None else None)

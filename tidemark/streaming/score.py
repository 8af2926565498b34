"""Labels of a stream of observations, by a fitted model.

State for each series: its last window - 1 observations, the costs of the cheapest paths that end in
each cluster (K numbers), and the last ``lag`` steps of those paths. A window's label is given out
``lag`` windows later, as the cheapest path says then; with a lag of 0 as soon as its last observation
comes. Rows not later than the state's time are dropped. A jump in ``t`` ends the window at hand:
no window spans it, and the path goes on behind it.

With a time column the stream has a watermark: rows later than it allows are dropped before they come here,
and a series from which nothing came until the watermark is ``idle`` past its last row ends. What
its lag still held is then given out, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.scoring import window_costs
from tidemark.plans.fit import Model

OUT = "series_id string, t bigint, cluster int"
STATE = "last bigint, held array<array<double>>, paths array<double>, times array<bigint>, back array<array<int>>"


class Path:
    """The path of one series as far as it is known."""

    def __init__(self, model: tuple, beta: float, window: int, lag: int, state: tuple | None = None):
        self.model, self.beta, self.window, self.lag = model, beta, window, lag
        self.last, held, paths, times, back = state or (None, [], [], [], [])
        self.held, self.paths = [np.asarray(h, float) for h in held], np.asarray(paths, float)
        self.times, self.back = list(times), [np.asarray(b) for b in back]  #: windows without a label yet; for each cluster the one before

    def state(self) -> tuple:
        return self.last, [h.tolist() for h in self.held], self.paths.tolist(), self.times, [b.tolist() for b in self.back]

    def add_all(self, rows: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        """(time of a window, cluster) of what observations (in any order) tell; the costs of all their windows at once."""
        whole, xs = [], []
        for t in sorted(rows):
            if self.last is not None and t <= self.last:
                continue
            if self.last is not None and t != self.last + 1:
                self.held = []
            self.held, self.last = [*self.held, rows[t]][-self.window :], t
            if len(self.held) == self.window:
                whole.append(t)
                xs.append(np.concatenate(self.held))
        costs = window_costs(np.array(xs), *self.model) if xs else ()
        return [out for t, cost in zip(whole, costs, strict=True) for out in self._step(t, cost)]

    def add(self, t: int, x: np.ndarray) -> list[tuple[int, int]]:
        return self.add_all({t: x})

    def _step(self, t: int, cost: np.ndarray) -> Iterator[tuple[int, int]]:
        if len(self.paths):
            stay = self.paths <= self.paths.min() + self.beta
            self.back.append(np.where(stay, np.arange(len(cost)), self.paths.argmin()))
            self.paths = cost + np.minimum(self.paths, self.paths.min() + self.beta)
        else:
            self.back.append(np.arange(len(cost)))
            self.paths = cost
        self.paths = self.paths - self.paths.min()
        self.times.append(t - self.window + 1)
        if len(self.times) > self.lag:
            yield self.times.pop(0), self.labels()[0]
            self.back.pop(0)

    def labels(self) -> list[int]:
        """Of all windows that are held back, along the cheapest path."""
        now, out = int(self.paths.argmin()), []
        for before in self.back[:0:-1]:
            out.append(now)
            now = int(before[now])
        return [now, *out[::-1]]

    def rest(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.times, self.labels() if self.times else (), strict=True)


def score_stream(series: DataFrame, model: Model, lag: int = 0, time_col: str | None = None, delay: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """``series``: a stream of (series_id, t, x). ``t`` of a result is its window's first time."""
    known = model.arrays()
    window, beta = model.parameters.window, model.parameters.beta

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        path = Path(known, beta, window, lag, state.get if state.exists else None)
        if state.hasTimedOut:
            out = list(path.rest())
            state.remove()
        else:
            rows, latest = {}, 0
            for frame in frames:  # a micro-batch comes in any order; of a repeated time the first row counts
                for t, x in zip(frame["t"], frame["x"], strict=True):
                    rows.setdefault(int(t), np.asarray(x, float))
                if time_col:
                    latest = max(latest, int(frame["ms"].max()))
            out = path.add_all(rows)
            state.update(path.state())
            if time_col:
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["series_id", "t", "cluster"])

    rows = series.select("series_id", "t", "x", *([F.col(time_col), F.unix_millis(time_col).alias("ms")] if time_col else []))
    rows = rows.withWatermark(time_col, delay) if time_col else rows
    timeout = GroupStateTimeout.EventTimeTimeout if time_col else GroupStateTimeout.NoTimeout
    return rows.groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "append", timeout)

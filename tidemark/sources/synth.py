"""Series drawn from regimes with sparse block-Toeplitz inverse covariances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _signed(rng: np.random.Generator, size) -> np.ndarray:
    return rng.uniform(0.3, 0.6, size) * rng.choice([-1, 1], size)


def lag_zero_block(n: int, portion: float, rng: np.random.Generator) -> np.ndarray:
    """Symmetric, with int(n (n - 1) portion / 2) random edges."""
    pairs = np.array([(i, j) for i in range(n) for j in range(i)]).reshape(-1, 2)
    out = np.zeros((n, n))
    some = pairs[rng.permutation(len(pairs))[: int(n * (n - 1) * portion / 2)]]
    out[some[:, 0], some[:, 1]] = _signed(rng, len(some))
    return out + out.T


def lag_block(n: int, portion: float, rng: np.random.Generator) -> np.ndarray:
    return _signed(rng, (n, n)) * (rng.random((n, n)) < portion)


def precision(window: int, n: int, portion: float, seed: int) -> np.ndarray:
    """Block (i, j) is B of lag |i - j|, transposed above the diagonal, made positive definite by a shift."""
    rng = np.random.default_rng(seed)
    blocks = [lag_zero_block(n, portion, rng), *(lag_block(n, portion, rng) for _ in range(window - 1))]
    full = np.block([[blocks[i - j] if i >= j else blocks[j - i].T for j in range(window)] for i in range(window)])
    return full + (0.1 + abs(np.linalg.eigvalsh(full)[0])) * np.eye(window * n)


def segment_of(t: int, breaks: Sequence[int]) -> int:
    return int(np.searchsorted(breaks, t, side="right"))


class Steps:
    """The law of a row, given the up to window - 1 rows before it (across borders too): a matrix of those and a noise.

    So the last window - 1 rows, as one state, go through an affine map at every step, and maps compose: a
    chunk of any length is (matrix, vector), whatever state it is entered with.
    """

    def __init__(self, precisions: Sequence[np.ndarray], window: int, n: int, regimes: Sequence[int], breaks: Sequence[int]):
        self.back, self.n, self.regimes, self.breaks = window - 1, n, regimes, breaks
        self.laws = {(r, b): self._law(np.linalg.inv(p), b) for r, p in enumerate(precisions) for b in range(window)}

    def _law(self, sigma: np.ndarray, back: int) -> tuple[np.ndarray, np.ndarray]:
        """(gain over the whole state, factor of the noise) where ``back`` rows are known."""
        n, gain = self.n, np.zeros((self.n, self.back * self.n))
        old, new = slice(0, back * n), slice(back * n, (back + 1) * n)
        cov = sigma[new, new]
        if back:
            own = sigma[new, old] @ np.linalg.inv(sigma[old, old])
            gain[:, (self.back - back) * n :] = own
            cov = cov - own @ sigma[old, new]
        return gain, np.linalg.cholesky(cov)

    def law(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.laws[self.regimes[segment_of(t, self.breaks)], min(t, self.back)]

    def fill(self, state: np.ndarray, first: int, noise: np.ndarray) -> np.ndarray:
        """Rows from ``first`` on, with the state they are entered with in front."""
        held = np.concatenate([state, np.empty(noise.size)])
        for k, e in enumerate(noise):
            gain, factor = self.law(first + k)
            at = k * self.n
            held[at + len(state) : at + len(state) + self.n] = gain @ held[at : at + len(state)] + factor @ e
        return held

    def composed(self, first: int, length: int) -> np.ndarray:
        """The matrix of a chunk: equal steps are raised to their power."""
        size, t, out = self.back * self.n, first, np.eye(self.back * self.n)
        while t < first + length and size:
            end = t + 1 if t < self.back else min(first + length, self.breaks[segment_of(t, self.breaks)])
            one = np.eye(size, k=self.n)
            one[size - self.n :] = self.law(t)[0]
            out, t = np.linalg.matrix_power(one, end - t) @ out, end
        return out


def noises(seed: int, series: int, first: int, rows: int, n: int) -> np.ndarray:
    """Standard normal rows that a counter gives: each is a function of the seed, the series and its own time."""
    words = -(-2 * n // 4) * 4  # of a row; a counter gives four
    bits = np.random.Philox(key=[seed, series])
    bits.advance(first * (words // 4))
    u = ((bits.random_raw(rows * words) >> np.uint64(11)) + 0.5).reshape(rows, words) / 2**53
    return np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * np.pi * u[:, n : 2 * n])


def sample(precisions: Sequence[np.ndarray], window: int, n: int, regimes: Sequence[int], breaks: Sequence[int], seed: int) -> np.ndarray:
    """The rows of one series."""
    steps = Steps(precisions, window, n, regimes, breaks)
    return steps.fill(np.zeros(steps.back * n), 0, noises(seed, 0, 0, breaks[-1], n))[steps.back * n :].reshape(-1, n)


def synthetic_series(
    spark: SparkSession, series: int = 1, window: int = 5, n: int = 5, portion: float = 0.2, regimes: Sequence[int] = (0, 1, 0), breaks: Sequence[int] = (200, 400, 600), chunk: int = 100_000, seed: int = 1000
) -> DataFrame:
    """(series_id, t, x, truth): series from the same regimes, each drawn chunk by chunk side by side.

    A first pass reduces every chunk to an affine map, a chain of these over a series tells the state that each
    chunk is entered with, and a second pass fills the chunks. Rows do not depend on the chunks' length.
    """
    steps = Steps([precision(window, n, portion, k) for k in range(max(regimes) + 1)], window, n, regimes, breaks)
    length, size = breaks[-1], (window - 1) * n
    chunks = -(-length // chunk)

    def rows_of(c: int) -> int:
        return min(chunk, length - c * chunk)

    def maps(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, c in zip((frame["id"] // chunks).tolist(), (frame["id"] % chunks).tolist(), strict=True):
                end = steps.fill(np.zeros(size), c * chunk, noises(seed, k, c * chunk, rows_of(c), n))[rows_of(c) * n :]
                out.append((k, c, steps.composed(c * chunk, rows_of(c)).ravel(), end))
            yield pd.DataFrame(out, columns=["k", "c", "matrix", "shift"])

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        state, out = np.zeros(size), []
        for row in part.sort_values("c").itertuples(index=False):
            out.append((row.k, row.c, state))
            state = np.reshape(row.matrix, (size, size)) @ state + np.asarray(row.shift)
        return pd.DataFrame(out, columns=["k", "c", "state"])

    def fill(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                t = row.c * chunk + np.arange(rows_of(row.c))
                x = steps.fill(np.asarray(row.state, float), row.c * chunk, noises(seed, row.k, row.c * chunk, len(t), n))[size:].reshape(-1, n)
                yield pd.DataFrame({"series_id": str(row.k), "t": t, "x": list(x), "truth": np.array(regimes)[np.searchsorted(breaks, t, side="right")]})

    each = spark.range(0, series * chunks, 1, max(1, min(series * chunks, spark.sparkContext.defaultParallelism * 4)))
    known = each.mapInPandas(maps, "k bigint, c bigint, matrix array<double>, shift array<double>").groupBy("k").applyInPandas(chain, "k bigint, c bigint, state array<double>")
    return known.repartition(F.col("k"), F.col("c")).mapInPandas(fill, "series_id string, t bigint, x array<double>, truth int")

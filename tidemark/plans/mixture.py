"""Gaussian mixtures by expectation and maximisation over merged moments.

A round is one pass: tasks hold the mixtures, weigh each window by its components' responsibilities and
fold weighted counts, means and centred products, which are merged as ``operators.moments`` does; K small
matrices for each mixture come back. The log-likelihood travels as one more entry of the windows, since
the responsibilities of a window sum to one. Several starts go side by side in the same passes; the
likeliest end is taken, of those that leave no component without windows if there are any.

Each start takes windows as means, the first by a seeded draw and every other with a chance that grows
with the square of its distance from the nearest so far; covariances start as that of all windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import moments
from tidemark.operators.ordering import drawn
from tidemark.plans.storage import stored

ASSIGNED = "series_id string, t bigint, cluster int"
STARTS, ROUNDS, TOLERANCE, FLOOR = 3, 100, 1e-3, 1e-6


@dataclass
class Mixture:
    """K Gaussians with their shares."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float = -np.inf  #: of a window, on the average, before the last step
    rounds: int = 0

    def log_densities(self, x: np.ndarray, weighted: bool = True) -> np.ndarray:
        """(windows, K), each with the log of its component's share unless told not to."""
        out = np.empty((len(x), len(self.means)))
        for k, (mean, cov) in enumerate(zip(self.means, self.covs, strict=True)):
            lower = np.linalg.cholesky(cov)
            z = np.linalg.solve(lower, (x - mean).T)
            out[:, k] = -0.5 * ((z * z).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(lower)).sum()
        with np.errstate(divide="ignore"):
            return out + np.log(self.weights) if weighted else out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, K) chances of the components, and each window's log-likelihood."""
        d = self.log_densities(x)
        top = d.max(1)
        total = top + np.log(np.exp(d - top[:, None]).sum(1))
        return np.exp(d - total[:, None]), total


def _weighted(held: dict, at: int, x: np.ndarray, weights: np.ndarray) -> None:
    """Folds windows into the moments of components ``at``, ``at`` + 1, …"""
    for k, w in enumerate(weights.T, at):
        if total := float(w.sum()):
            mean = w @ x / total
            centred = x - mean
            held[k] = moments.merge(held.get(k), (total, mean, (centred * w[:, None]).T @ centred))


def _stepped(rows: list, of: int, k: int, floor: np.ndarray, before: Mixture | None) -> Mixture:
    """The mixture that maximises, of merged moments whose last entry is the log-likelihood."""
    d = len(floor)
    n = sum(r["n"] for r in rows)
    weights, means, covs = np.zeros(k), np.zeros((k, d)), np.tile(np.diag(floor), (k, 1, 1))
    if before is not None:
        means, covs = before.means.copy(), before.covs.copy()  # of components that no window weighs anything for
    for r in rows:
        at = r["cluster"] - of
        weights[at], means[at] = r["n"] / n, r["mean"][:d]
        covs[at] = np.reshape(r["m2"], (d + 1, d + 1))[:d, :d] / r["n"] + np.diag(floor)
    return Mixture(weights, means, covs, sum(r["n"] * r["mean"][d] for r in rows) / n, (before.rounds if before else 0) + 1)


def maximised(windows: DataFrame, k: int, floor: float = 0.0) -> Mixture:
    """One maximisation from given responsibilities: windows (x, share array<double>)."""

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                _weighted(held, 0, np.c_[x, np.zeros(len(x))], np.stack(frame["share"].to_numpy()))
        yield moments.as_rows(held)

    rows = moments.merged(windows.select("x", "share").mapInPandas(task, moments.WEIGHTED)).collect()
    if not rows:
        raise ValueError("no windows to fit a mixture to")
    return _stepped(rows, 0, k, np.full(len(rows[0]["mean"]) - 1, floor), None)


def _round(windows: DataFrame, each: dict[int, Mixture], k: int, floor: np.ndarray, tasks: int | None = None) -> dict[int, Mixture]:
    """Every mixture one step further, in one pass."""
    shared = windows.sparkSession.sparkContext.broadcast(each)

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                for nth, mixture in shared.value.items():
                    share, likelihood = mixture.responsibilities(x)
                    _weighted(held, nth * k, np.c_[x, likelihood], share)
        yield moments.as_rows(held)

    rows = moments.merged(windows.select("x").mapInPandas(task, moments.WEIGHTED), tasks).collect()
    return {nth: _stepped([r for r in rows if r["cluster"] // k == nth], nth * k, k, floor, each[nth]) for nth in each}


def _draws(seed: int, starts: int, centres: list[list[np.ndarray]]):
    """For each start a key, whose smallest row is drawn with a chance in proportion to its squared distance."""

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"series_id": frame["series_id"], "t": frame["t"]}
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                for s in range(starts):
                    chance = -np.log((frame[f"u{s}"].to_numpy() + 0.5) / 2**52)
                    if centres[s]:
                        square = np.min([((x - c) ** 2).sum(1) for c in centres[s]], axis=0)
                        with np.errstate(divide="ignore"):
                            chance = chance / square
                    out[f"key{s}"] = chance
                yield pd.DataFrame(out)

    return task


def seeds(windows: DataFrame, k: int, seed: int, starts: int = STARTS) -> list[np.ndarray]:
    """For each start K windows that lie apart, in K passes for all of them."""
    from tidemark.plans.fit import windows_at

    centres: list[list[np.ndarray]] = [[] for _ in range(starts)]
    keyed = "series_id string, t bigint, " + ", ".join(f"key{s} double" for s in range(starts))
    for nth in range(k):
        numbered = windows.select("series_id", "t", "x", *[drawn(seed * 1009 + s * 101 + nth).alias(f"u{s}") for s in range(starts)])
        least = numbered.mapInPandas(_draws(seed, starts, centres), keyed).agg(*[F.min_by(F.struct("series_id", "t"), F.struct(f"key{s}", "series_id", "t")).alias(f"at{s}") for s in range(starts)]).first()
        places = [(least[f"at{s}"]["series_id"], least[f"at{s}"]["t"]) for s in range(starts)]
        seen = {(r["series_id"], r["t"]): np.asarray(r["x"]) for r in windows_at(windows, set(places))}
        for s, place in enumerate(places):
            centres[s].append(seen[place])
    return [np.array(c) for c in centres]


def fitted(windows: DataFrame, k: int, seed: int = 0, starts: int = STARTS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, tasks: int | None = None) -> Mixture:
    """The likeliest of several mixtures of ``k`` components for windows (series_id, t, x), which are in ``tasks`` partitions, if known."""
    whole = moments.moments(windows.withColumn("cluster", F.lit(0)), biased=True, tasks=tasks).first()
    if whole is None:
        raise ValueError("no windows to fit a mixture to")
    d = len(whole["mean"])
    cov = np.reshape(whole["cov"], (d, d))
    floor = np.full(d, FLOOR * max(np.diag(cov).mean(), 1e-12))
    going = {s: Mixture(np.full(k, 1 / k), means, np.tile(cov + np.diag(floor), (k, 1, 1))) for s, means in enumerate(seeds(windows, k, seed, starts))}
    done: dict[int, Mixture] = {}
    for _ in range(rounds):
        after = _round(windows, going, k, floor, tasks)
        for s in list(going):
            if after[s].log_likelihood - going[s].log_likelihood < tolerance:
                done[s] = going.pop(s)  # the likelihood is that of the mixture before the step
                done[s].log_likelihood = after[s].log_likelihood
            else:
                going[s] = after[s]
        if not going:
            break
    done |= going
    n = whole["n"]
    populated = lambda m: int((m.weights * n > d + 1).sum())
    return max(done.values(), key=lambda m: (populated(m), m.log_likelihood))


def assigned(model: Mixture, windows: DataFrame, weighted: bool = True) -> DataFrame:
    """(series_id, t, cluster): each window's likeliest component, of equal ones the lower; without the components' shares if so told."""
    shared = windows.sparkSession.sparkContext.broadcast(model)

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                best = shared.value.log_densities(np.stack(frame["x"].to_numpy()), weighted).argmax(1)
                yield pd.DataFrame({"series_id": frame["series_id"], "t": frame["t"], "cluster": best.astype(np.int32)})

    return windows.select("series_id", "t", "x").mapInPandas(task, ASSIGNED)


def networks(model: Mixture, spark: SparkSession) -> DataFrame:
    """(cluster, theta): inverse covariances of the components, K rows."""
    rows = [(k, np.linalg.pinv(cov, hermitian=True).ravel().tolist()) for k, cov in enumerate(model.covs)]
    return spark.createDataFrame(rows, "cluster int, theta array<double>")


def start(windows: DataFrame, k: int, seed: int, tasks: int | None = None) -> DataFrame:
    """Labels of a fitted mixture, stored."""
    return stored(assigned(fitted(windows, k, seed, tasks=tasks), windows))

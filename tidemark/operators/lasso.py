"""The block-Toeplitz graphical lasso of one cluster, by the alternating direction method.

Minimises  -log det X + tr(S X) + sum of lam |X|  over symmetric X whose w x w blocks of n x n
entries depend on the lag only. Runs inside a task that holds one cluster's covariance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def toeplitz_groups(window: int, sensors: int) -> np.ndarray:
    """For each entry of the matrix the number of the group that must be equal: (lag, row sensor, column sensor)."""
    at = np.arange(window * sensors)
    block, sensor = at // sensors, at % sensors
    lag = block[None, :] - block[:, None]
    first, second = np.broadcast_arrays(sensor[:, None], sensor[None, :])
    j = np.where(lag > 0, first, np.where(lag < 0, second, np.minimum(first, second)))
    k = np.where(lag > 0, second, np.where(lag < 0, first, np.maximum(first, second)))
    return np.unique(np.abs(lag) * sensors**2 + j * sensors + k, return_inverse=True)[1].reshape(lag.shape)


def group_means(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    flat = groups.ravel()
    return (np.bincount(flat, values.ravel()) / np.bincount(flat))[groups]


def lag_scaled(lam: float, window: int, sensors: int) -> np.ndarray:
    """Penalties that grow with the lag: lam (1 + |lag|)."""
    block = np.arange(window * sensors) // sensors
    return lam * (1.0 + np.abs(block[:, None] - block[None, :]))


def separate(s: np.ndarray, window: int, lam: float | np.ndarray) -> list[np.ndarray]:
    """Groups of sensors that the solution does not link, each in order.

    Where the mean of a group of equal entries between two sets of sensors is within its penalty at every lag, zeros
    there meet the optimum's conditions (the inverse of a matrix in blocks is in the same blocks). So the
    connected components of what exceeds its penalty can be solved each by itself, exactly.
    """
    sensors = len(s) // window
    groups = toeplitz_groups(window, sensors)
    over = np.abs(group_means(s, groups)) > group_means(np.broadcast_to(np.asarray(lam, float), s.shape), groups)
    link = over.reshape(window, sensors, window, sensors).any((0, 2)) | np.eye(sensors, dtype=bool)
    link |= link.T
    of = np.arange(sensors)
    while True:
        least = np.where(link, of, sensors).min(1)
        if (least == of).all():
            return [np.flatnonzero(of == k) for k in np.unique(of)]
        of = least


@dataclass
class Solution:
    theta: np.ndarray  #: positive definite; only nearly sparse
    sparse: np.ndarray  #: exactly sparse and block-Toeplitz
    iterations: int
    converged: bool


def solve(s: np.ndarray, window: int, lam: float | np.ndarray, rho: float = 1.0, most: int = 1000, eps_abs: float = 1e-6, eps_rel: float = 1e-6, floor: float = 1e-4, rho_update=None) -> Solution:
    """``floor`` is added to both residual limits; ``rho_update(rho, primal, dual)`` may change rho."""
    d = len(s)
    groups = toeplitz_groups(window, d // window)
    penalty = group_means(np.broadcast_to(np.asarray(lam, float), s.shape), groups)
    upper = np.triu_indices(d)
    norm = lambda m: np.linalg.norm(m[upper])
    x = z = u = np.zeros_like(s)
    for step in range(most):
        value, vector = np.linalg.eigh(rho * (z - u) - s)
        x = (vector * ((value + np.sqrt(value**2 + 4 * rho)) / (2 * rho))) @ vector.T
        mean = group_means(x + u, groups)
        before, z = z, np.sign(mean) * np.maximum(np.abs(mean) - penalty / rho, 0)
        u = u + x - z
        if step:
            primal, dual = norm(x - z), norm(rho * (z - before))
            limit = np.sqrt(len(upper[0])) * eps_abs + floor
            if primal <= limit + eps_rel * max(norm(x), norm(z)) and dual <= limit + eps_rel * norm(rho * u):
                return Solution(x, z, step + 1, True)
            if rho_update is not None:
                new = rho_update(rho, primal, dual)
                u, rho = u * (rho / new), new
    return Solution(x, z, most, False)


def solve_separately(s: np.ndarray, window: int, lam: float | np.ndarray, wide: int = 256, **how) -> Solution:
    """As ``solve``, by sets of sensors that do not touch: the cost is that of the largest set, not of all sensors.

    A matrix of at most ``wide`` rows is solved whole, which costs less than many tiny solutions.
    """
    sensors = len(s) // window
    sets = separate(s, window, lam) if len(s) > wide else []
    if len(sets) < 2:
        return solve(s, window, lam, **how)
    penalty, theta, sparse = np.broadcast_to(np.asarray(lam, float), s.shape), np.zeros_like(s), np.zeros_like(s)
    found = []
    for some in sets:
        at = (np.arange(window)[:, None] * sensors + some).ravel()
        here = np.ix_(at, at)
        found.append(solve(s[here], window, penalty[here], **how))
        theta[here], sparse[here] = found[-1].theta, found[-1].sparse
    return Solution(theta, sparse, max(f.iterations for f in found), all(f.converged for f in found))

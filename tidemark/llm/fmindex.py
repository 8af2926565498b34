"""An FM-index over a sequence of small integers, for the text one task holds.

The Burrows-Wheeler transform is kept in a wavelet matrix; backward search counts and
delimits all occurrences of many patterns at once, and suffix positions sampled every few
entries locate them.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling, until every suffix has a rank of its own."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] if span < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        if rank[order[-1]] == n:
            return order
        span *= 2


class FMIndex:
    """``text``: symbols 1..top, with 0 where no pattern may cross."""

    def __init__(self, text: np.ndarray, top: int, every: int = 8):
        text = np.r_[text.astype(np.int64), -1] + 1  # a unique smallest symbol ends it
        self.n, self.top = len(text), top + 2
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=self.top))]
        sampled = sa % every == 0
        self.sampled, self.nth, self.places = sampled, np.cumsum(sampled) - 1, sa[sampled]
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for shift in range(max(1, int(self.top - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift) & 1
            ones = np.r_[0, np.cumsum(bit)].astype(np.int32)
            zeros = int(self.n - ones[-1])
            self.levels.append((shift, bit.astype(bool), ones, zeros))
            bwt = np.r_[bwt[bit == 0], bwt[bit == 1]]
        start = np.arange(self.top)
        self.start = self._down(start, np.zeros(self.top, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, _, ones, zeros in self.levels:
            one = ones[at]
            at = np.where((symbol >> shift) & 1, zeros + one, at - one)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before those that start with ``symbol`` and go on like the rows before ``at``."""
        return self.before[symbol] + self._down(symbol, at) - self.start[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the suffixes that begin with each row of ``patterns``."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k].astype(np.int64) + 1
            lo[live], hi[live] = self.step(symbol, lo[live]), self.step(symbol, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi[lo >= hi] = lo[lo >= hi]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of ``rows`` begin: walks back to a sampled suffix."""
        place, steps, live, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            known = self.sampled[at]
            place[live[known]] = self.places[self.nth[at[known]]] + steps
            live, at = live[~known], at[~known]
            symbol, down = np.zeros(len(at), np.int64), at.copy()
            for shift, bit, ones, zeros in self.levels:
                b, one = bit[down], ones[down]
                symbol |= b.astype(np.int64) << shift
                down = np.where(b, zeros + one, down - one)
            at = self.before[symbol] + down - self.start[symbol]
            steps += 1
        return place

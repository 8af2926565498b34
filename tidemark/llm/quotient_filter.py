"""A counting quotient filter: a compact multiset of fingerprints that merges without loss.

A fingerprint of q + r bits has its upper q bits (the quotient) as its home slot and leaves its lower r
bits (the remainder) there. Remainders of one quotient lie side by side in order, as a run; runs
lie in order of their quotients, each at its home or, where that is taken, right behind the run before.
Two bits a slot tell where they are: ``occupied`` (some fingerprint has this quotient) and ``run_end``.
A count is written into the run itself. For a remainder x: ``x``; ``x x``; from three on ``x [0] digits x``,
the digits being those of the count less 3 without the symbols 0 and x, led by 0 if the first of them exceeds
x, so that what follows x falls below it. For x = 0: ``0``; ``0 0``; ``0 0 0``; from four on ``0 digits 0 0``.

All fingerprints can be read off in order, so filters merge by their sorted remainders.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<BBI")
LOAD = 0.9  #: of the slots, at most, are filled


def _packed(values: np.ndarray, bits: int) -> bytes:
    each = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def _unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    each = np.zeros((n, 64), np.uint8)
    each[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(each, axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def _digits(value: int, base: int) -> list[int]:
    out = [value % base]
    while value := value // base:
        out.append(value % base)
    return out[::-1]


def coded(x: int, count: int, bits: int) -> list[int]:
    """The slots of a remainder that occurs ``count`` times."""
    if count < 3 or (x == 0 and count == 3):
        return [x] * count
    if x == 0:
        return [0, *(d + 1 for d in _digits(count - 4, (1 << bits) - 1)), 0, 0]
    symbols = [d + 1 + (d + 1 >= x) for d in _digits(count - 3, (1 << bits) - 2)]
    return [x, *([0] if symbols[0] > x else []), *symbols, x]


def decoded(run: list[int], bits: int) -> list[tuple[int, int]]:
    """(remainder, count) of a run's slots."""
    out, i, n = [], 0, len(run)
    if run[0] == 0:
        ends = next((j for j in range(2, n - 1) if run[j] == run[j + 1] == 0), 0) if n > 1 and run[1] else 0
        if ends:
            value = 0
            for s in run[1:ends]:
                value = value * ((1 << bits) - 1) + s - 1
            out, i = [(0, value + 4)], ends + 2
        else:
            i = next((j for j, s in enumerate(run) if s), n)
            out = [(0, i)]
    while i < n:
        x = run[i]
        if i + 1 == n or run[i + 1] > x:
            out.append((x, 1))
            i += 1
        elif run[i + 1] == x:
            out.append((x, 2))
            i += 2
        else:
            i += 1 + (run[i + 1] == 0)
            value = 0
            while run[i] != x:
                value = value * ((1 << bits) - 2) + run[i] - 1 - (run[i] > x)
                i += 1
            out.append((x, value + 3))
            i += 1
    return out


class CountingQuotientFilter:
    """Fingerprints of ``q + r`` bits with their counts."""

    def __init__(self, q: int, r: int, slots: np.ndarray, occupied: np.ndarray, run_end: np.ndarray):
        self.q, self.r, self.slots, self.occupied, self.run_end = q, r, slots, occupied, run_end

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """Of sorted distinct fingerprints of ``bits`` bits (uint64) and their counts."""
        n = len(prints)
        need = int((np.minimum(counts, 2)).sum() + 4 * (counts > 2).sum())
        q = min(bits - 2, max(1, int(np.ceil(np.log2(max(need, 1) / LOAD)))))
        r = bits - q
        quotient, x = (prints >> np.uint64(r)).astype(np.int64), prints & np.uint64((1 << r) - 1)
        more = np.flatnonzero(counts > 2)
        codes = [coded(int(x[k]), int(counts[k]), r) for k in more.tolist()]
        width = np.minimum(counts, 2).astype(np.int64)
        width[more] = list(map(len, codes))
        begin = np.cumsum(width) - width  # in the codes laid end to end
        flat = np.repeat(x, width)
        for k, code in zip(begin[more].tolist(), codes, strict=True):
            flat[k : k + len(code)] = code
        homes, first = np.unique(quotient, return_index=True)
        before = begin[first] if n else np.empty(0, np.int64)
        starts = before + np.maximum.accumulate(homes - before) if n else before
        length = np.diff(np.r_[before, len(flat)])
        total = max(1 << q, int(starts[-1] + length[-1]) if n else 0)
        slots, occupied, run_end = np.zeros(total, np.uint64), np.zeros(total, bool), np.zeros(total, bool)
        slots[np.repeat(starts - before, length) + np.arange(len(flat))] = flat
        occupied[homes] = True
        run_end[starts + length - 1] = True
        return cls(q, r, slots, occupied, run_end)

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quotient, first slot, slot behind the last) of every run: the i-th occupied quotient has the i-th end."""
        homes, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end) + 1
        return homes, np.maximum(homes, np.r_[0, ends[:-1]]) if len(homes) else homes, ends

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in order, and their counts."""
        homes, starts, ends = self._runs()
        if not len(homes):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        length = ends - starts
        of = np.repeat(np.arange(len(homes)), length)
        at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(len(of))
        x = self.slots[at]
        falls = np.r_[False, (x[1:] <= x[:-1]) & (of[1:] == of[:-1])]
        counted = np.zeros(len(homes), bool)
        counted[of[falls]] = True  # runs with a count in them; elsewhere a slot is a fingerprint
        plain = ~counted[of]
        prints = [(homes[of[plain]].astype(np.uint64) << np.uint64(self.r)) | x[plain]]
        counts = [np.ones(int(plain.sum()), np.int64)]
        for k in np.flatnonzero(counted).tolist():
            found = decoded(self.slots[starts[k] : ends[k]].tolist(), self.r)
            prints.append((np.uint64(homes[k]) << np.uint64(self.r)) | np.array([f for f, _ in found], np.uint64))
            counts.append(np.array([c for _, c in found], np.int64))
        p, c = np.concatenate(prints), np.concatenate(counts)
        order = np.argsort(p, kind="stable")
        return p[order], c[order]

    def count(self, fingerprint: int) -> int:
        """How often it was put in: rank of its quotient, select of that run, its remainder in the run."""
        home, x = fingerprint >> self.r, fingerprint & ((1 << self.r) - 1)
        if not self.occupied[home]:
            return 0
        rank = int(self.occupied[: home + 1].sum())
        ends = np.flatnonzero(self.run_end) + 1
        start = max(home, int(ends[rank - 2]) if rank > 1 else 0)
        return dict(decoded(self.slots[start : ends[rank - 1]].tolist(), self.r)).get(x, 0)

    def to_bytes(self) -> bytes:
        n = len(self.slots)
        return _HEAD.pack(self.q, self.r, n) + np.packbits(self.occupied).tobytes() + np.packbits(self.run_end).tobytes() + _packed(self.slots, self.r)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, r, n = _HEAD.unpack_from(data)
        flags, at = -(-n // 8), _HEAD.size
        bit = lambda k: np.unpackbits(np.frombuffer(data, np.uint8, flags, at + k * flags), count=n).astype(bool)
        return cls(q, r, _unpacked(data[at + 2 * flags :], n, r), bit(0), bit(1))

    @staticmethod
    def merged(filters: Iterable[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """The multiset union: sorted fingerprints are merged and the counts of equal ones added."""
        return CountingQuotientFilter.build(*summed([f.items() for f in filters]), bits)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of sorted parts, with the sums of their counts."""
    p, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(p, kind="stable")  # merges runs that are sorted already
    p, c = p[order], c[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, np.int64)
    return p[first], np.add.reduceat(c, first) if len(p) else c

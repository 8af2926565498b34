"""Column functions over arrays of doubles: vectors, packed symmetric matrices, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def argmin(a: Column) -> Column:
    """Place of the smallest entry from 0; the first of equal ones."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def frobenius(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)))


def threshold_mask(a: Column, above: float) -> Column:
    """1 where an entry's size exceeds ``above``, else 0."""
    return F.transform(a, lambda v: (F.abs(v) > above).cast("int"))


def block(a: Column, k: int, n: int) -> Column:
    """Observation ``k`` of a stacked window of ``n`` sensors."""
    return F.slice(a, k * n + 1, n)


def packed_place(i: Column, j: Column, n: int) -> Column:
    """Where (i, j), i <= j, lies in the row-major upper triangle of an n x n matrix."""
    return i * n - F.floor(i * (i - 1) / 2) + (j - i)


def unpack_symmetric(packed: Column, n: int, eps: float = 0.0) -> Column:
    """The whole matrix, row by row, from its packed upper triangle; entries under ``eps`` become 0."""

    def entry(at: Column) -> Column:
        i, j = F.floor(at / n), at % n
        v = F.element_at(packed, (packed_place(F.least(i, j), F.greatest(i, j), n) + 1).cast("int"))
        return F.when(F.abs(v) < eps, F.lit(0.0)).otherwise(v)

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), entry)


def pack_symmetric(full: Column, n: int) -> Column:
    places = F.array(*[F.lit(i * n + j + 1) for i in range(n) for j in range(i, n)])
    return F.transform(places, lambda p: F.element_at(full, p))


def hex_channels(colour: Column) -> Column:
    """Three channels of '#rrggbb', each divided by 256."""
    bare = F.ltrim(colour, F.lit("#"))
    return F.array(*[F.conv(F.substring(bare, 2 * k + 1, 2), 16, 10).cast("double") / 256.0 for k in range(3)])

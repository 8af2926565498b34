"""Columns by their exact names, whatever characters those hold."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of this very name: a dot in it is no path."""
    return F.col(quoted(name))


def others(names: Iterable[str], added: Sequence[str]) -> list[str]:
    """``names`` without those that Spark would take for one of ``added``; it compares without case."""
    taken = {a.lower() for a in added}
    return [n for n in names if n.lower() not in taken]


def packed(names: Iterable[str]) -> Column:
    """Columns as one struct ``d``, to travel beside others under no names of their own: ``select("d.*")`` gives them back."""
    return F.struct(*[col(n) for n in names])

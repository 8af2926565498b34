"""Word and character expressions over a text column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks; null gives an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def count_of(text: Column, pattern: str) -> Column:
    """How often a one-character pattern occurs."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def without_blanks(text: Column) -> Column:
    """Code points that are not blanks."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.char_length(text)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())

"""Documents with every awkward trait, and helpers."""

from __future__ import annotations

import random
import re

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: Names that the operators use inside; as extra columns they must change nothing.
CLASHING = ("meta.url", "N_Lines", "Score", "Lang_Pred", "__row", "__text", "__gone", "whole", "read", "predicted", "row", "h", "n", "k", "key", "at", "batch", "count", "fp", "node", "u", "v", "group", "shard", "slot", "size", "starts", "hit", "items", "gone", "chunk", "d", "best", "stratum", "w", "s", "n_words", "n_removed", "kept", "length", "piece", "id", "host", "path", "rule", "share")


def words(text: str | None) -> list[str]:
    return [w for w in BLANKS.split(text or "") if w]


def prose(seed: int, n: int, letters: str = "abcde") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 5))) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text, lang): nulls, blanks, long texts, copies, ties, repeated rows, odd characters."""
    base = prose(1, 120)
    lines = "\n".join(prose(k, 8) for k in range(100, 116))
    texts = [None, "", "   \n\t ", "one", "two words", base, base, base + " tail", prose(2, 30) + " " + base, prose(3, 5000), lines, "head line\n" + lines, lines + "\n", "A B A B A B A B " * 20]
    texts += ["Zażółć gęślą jaźń Σίσυφος ΟΔΟΣ İstanbul", "nbsp\u00a0joined\u2003wide e\u0301 ﬁ \x00 \x1c \x85", "<|endoftext|> inside <|startoftext|>", "x" * 3000, "١٢٣ ½ ² 12 can't WE'LL", "\n\n\n", prose(4, 40)]
    out = [(k, t, ("en", "de", None)[k % 3]) for k, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, base, "en"), (None, None, None), (900, prose(4, 40), "de")]


def frame(spark: SparkSession, rows: list[tuple], clashing: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return df.withColumns({c: F.lit("extra") for c in CLASHING}) if clashing else df


def as_rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def oracle(sql: str, **tables: pd.DataFrame) -> list[tuple]:
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return sorted(map(tuple, con.execute(sql).fetchall()), key=repr)


def table(rows: list[tuple]) -> pd.DataFrame:
    t = pd.DataFrame(rows, columns=["doc_id", "text", "lang"])
    return t.astype({"doc_id": "Int64", "text": "string", "lang": "string"})

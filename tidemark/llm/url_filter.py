"""URL filtering by hashed host-suffix and path-prefix expressions.

A rule names a host and the start of a path, and holds for the host and every subdomain.
Each URL is expanded into all (host suffix, path prefix) expressions that some rule could
equal; the expressions meet the rules in an equi-join on the first 32 bits of their SHA-256,
full digests (and the strings) confirm, and the longest confirmed rule decides.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict. Repeated pages give repeated rows. Of rules of equal length the one with the
longer host wins, then ``block`` before ``allow``; a rule without a host, a path or an action is
none. Columns beside the id and the URL are unused, whatever they are called.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import col
from tidemark.llm.textsql import ascii_lower

PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, "^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (action, host, path) with digest, its short prefix and precedence."""
    return rules.where(F.col("action").isNotNull() & F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.col("action"),
        ascii_lower(F.col("host")).alias("rule_host"),
        F.col("path").alias("rule_path"),
    ).select(
        "*",
        _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"),
        F.substring(_digest(F.col("rule_host"), F.col("rule_path")), 1, PREFIX_HEX).alias("short"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, the deciding rule (or null) and the verdict.

    Only expressions of the shapes that rules have (so many labels with so long a path prefix) are
    made, which loses none: no other expression can equal a rule. There are at most as many shapes
    as rules, and a URL has no more of them than it has labels times characters.
    """
    hashed = hashed_rules(rules)
    shapes = hashed.groupBy(F.size(F.split("rule_host", "\\.")).alias("labels")).agg(F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"))
    known = F.from_json(F.lit(json.dumps([r.asDict() for r in shapes.collect()])), "array<struct<labels:int,lengths:array<int>>>")
    url = col(url_col)
    parts = pages.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    split = F.split("host", "\\.")
    expressions = F.flatten(
        F.transform(
            F.filter(known, lambda s: s["labels"] <= F.size(split)),
            lambda s: F.transform(
                F.filter(s["lengths"], lambda n: n <= F.length("path")),
                lambda n: F.struct(F.concat_ws(".", F.slice(split, F.size(split) - s["labels"] + 1, s["labels"])).alias("h"), F.substring(F.col("path"), F.lit(1), n).alias("p")),
            ),
        )
    )
    expanded = (
        parts.select("row", "id", "host", "path", F.explode_outer(expressions).alias("e"))
        .select("row", "id", "host", "path", "e", _digest(F.col("e.h"), F.col("e.p")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    confirmed = (F.col("digest") == F.col("rule_digest")) & (F.col("e.h") == F.col("rule_host")) & (F.col("e.p") == F.col("rule_path"))
    # A page keeps a row even if nothing matches; partial aggregation folds a page's
    # expressions together before the only shuffle, whose key is unique to the page.
    best = F.max(
        F.when(
            confirmed,
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("n"),
                F.length("rule_host").alias("h"),
                (F.col("action") == "block").alias("b"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("action").alias("action"),
            ),
        )
    )
    return (
        expanded.join(hashed, "short", "left")
        .groupBy("row", "id", "host", "path")
        .agg(best.alias("best"))
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"),
        )
    )

"""Reading series, matrices and graphs. A series is (series_id, t, x): an ordinal and its sensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_ordinal


def read_matrix_csv(spark: SparkSession, path: str, series_id: str = "0") -> DataFrame:
    """A headerless comma-separated file: a row is a time, a column a sensor; '#' starts a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    return with_ordinal(lines).select(F.lit(series_id).alias("series_id"), "t", F.transform(F.split("line", ","), lambda v: v.cast("double")).alias("x"))


def read_table(spark: SparkSession, path: str, columns: Sequence[int], sep: str = "\t") -> DataFrame:
    """Columns of a headered text table by their ordinals, as doubles with a time ordinal."""
    table = spark.read.csv(path, sep=sep, header=True)
    return with_ordinal(table.select(*[F.col(f"`{table.columns[i]}`").cast("double").alias(f"s{k}") for k, i in enumerate(columns)]))


def as_series(table: DataFrame, columns: Sequence[str], series_id: str = "0") -> DataFrame:
    """(series_id, t, x) of a table with ``t`` and a column for each sensor, nulls kept."""
    return table.select(F.lit(series_id).alias("series_id"), F.col("t").cast("bigint").alias("t"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def read_matrix(spark: SparkSession, path: str, k: int = 0, sep: str = ",") -> DataFrame:
    """A matrix file in long form (k, i, j, v)."""
    rows = with_ordinal(spark.read.text(path).where("trim(value) <> ''"), "i")
    return rows.select(F.lit(k).alias("k"), F.col("i").cast("int").alias("i"), F.posexplode(F.split("value", sep)).alias("j", "v")).select("k", "i", "j", F.col("v").cast("double").alias("v"))


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, undirected edges) of a 'src dst' file; lines that start with '#' are skipped."""
    parts = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(F.split(F.trim("value"), r"\s+").alias("p"))
    ends = parts.select(F.col("p")[0].cast("bigint").alias("a"), F.col("p")[1].cast("bigint").alias("b"))
    edges = ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def random_series(spark: SparkSession, length: int, sensors: int, seed: int = 0, scale: float = 1000.0) -> DataFrame:
    values = F.array(*[F.rand(seed + k) * scale for k in range(sensors)])
    return spark.range(length).select(F.lit("0").alias("series_id"), F.col("id").alias("t"), values.alias("x"))


def span(df: DataFrame, t: Column) -> tuple[int, int]:
    """(first t, length) of the axis that covers every row of ``df`` that has a time; (0, 0) if none has."""
    first, last = df.agg(F.min(t), F.max(t)).first()
    return (0, 0) if first is None else (first, last - first + 1)


def pivoted(df: DataFrame, t: Column, key: Column, value: Column, keys: Sequence[str], length: int, digits: int | None = 4) -> DataFrame:
    """A series of sums: one row for each t from 0 to ``length`` - 1, one sensor for each key, 0 where none.

    A row with one of the keys and a ``t`` that the axis does not hold is an error, never left out.
    """
    own = df.select(t.cast("bigint").alias("t"), key.alias("k"), value.alias("v")).where(F.col("k").isin(*keys))
    inside = F.col("t").between(0, F.lit(length) - 1) | F.col("t").isNull()
    own = own.withColumn("t", F.when(inside, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("the axis does not hold t = "), F.col("t").cast("string"))).cast("bigint")))
    sums = own.groupBy("t").agg(*[F.sum(F.when(F.col("k") == k, F.col("v"))).alias(f"s{i}") for i, k in enumerate(keys)])
    spine = df.sparkSession.range(max(0, length)).withColumnRenamed("id", "t")
    tidy = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits) if digits is not None else F.coalesce(c, F.lit(0.0))
    return spine.join(sums, "t", "left").select(F.lit("0").alias("series_id"), "t", F.array(*[tidy(F.col(f"s{i}")) for i in range(len(keys))]).alias("x"))


def long_form(series: DataFrame) -> DataFrame:
    return series.select("series_id", "t", F.posexplode("x").alias("sensor", "v"))

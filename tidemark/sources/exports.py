"""Tables and files of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _some(assigned: DataFrame, every: int, most: int | None) -> DataFrame:
    some = assigned.where(F.col("t") % every == 0)
    return some if most is None else some.where(F.col("t") < most)


def colours(assigned: DataFrame, palette: Sequence[str], every: int = 10, most: int | None = None) -> DataFrame:
    """The colour of each ``every``-th window's cluster, quoted; of all windows, or of those before ``most``."""
    names = F.array(*[F.lit(c) for c in palette])
    return _some(assigned, every, most).select("series_id", "t", F.format_string('"%s"', F.element_at(names, F.col("cluster") + 1)).alias("colour"))


def locations(assigned: DataFrame, places: DataFrame, every: int = 10, most: int | None = None) -> DataFrame:
    """Coordinates (series_id, t, lat, lon) of the same windows, as text for a map."""
    some = _some(assigned, every, most).select("series_id", "t")
    return some.join(places, ["series_id", "t"]).select("series_id", "t", F.format_string("new GLatLng(%s, %s)", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("point"))


def raw_means(assigned: DataFrame, series: DataFrame, sensors: int) -> DataFrame:
    """(cluster, sensor, mean) of the observations at the windows' times."""
    met = assigned.join(series, ["series_id", "t"]).select("cluster", F.posexplode(F.slice("x", 1, sensors)).alias("sensor", "v"))
    return met.groupBy("cluster", "sensor").agg(F.avg("v").alias("mean"))


def write_labels(assigned: DataFrame, path: str) -> None:
    """One label a line, in order of time."""
    assigned.orderBy("series_id", "t").select(F.col("cluster").cast("string")).write.mode("overwrite").text(path)


def write_matrix(matrices: DataFrame, path: str, digits: int = 6) -> None:
    """Matrices in long form as comma-separated rows, a folder for each cluster."""
    shown = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: F.format_string(f"%.{digits}f", s["v"]))
    lines = matrices.groupBy("cluster", "i").agg(F.concat_ws(",", shown).alias("value"))
    lines.orderBy("cluster", "i").select("cluster", "value").write.mode("overwrite").partitionBy("cluster").text(path)


def write_series(series: DataFrame, path: str, digits: int = 4) -> None:
    shown = F.concat_ws(",", F.transform("x", lambda v: F.format_string(f"%.{digits}f", v)))
    series.orderBy("series_id", "t").select(shown.alias("value")).write.mode("overwrite").text(path)

"""Confusion, matching, accuracy, F1, information criterion and network tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prepare import segments


def periodic_truth(t: Column, length: int, pattern: Sequence[int]) -> Column:
    """Segments of ``length`` rows whose clusters follow ``pattern`` again and again."""
    places = F.array(*[F.lit(int(p)) for p in pattern])
    return F.element_at(places, (F.floor(t / length) % len(pattern) + 1).cast("int"))


def stepped_truth(t: Column, bounds: Sequence[int], clusters: Sequence[int]) -> Column:
    """``clusters[k]`` below ``bounds[k]``, the last one beyond all bounds."""
    out = F.lit(int(clusters[-1]))
    for upto, k in reversed(list(zip(bounds, clusters, strict=False))):
        out = F.when(t < upto, F.lit(int(k))).otherwise(out)
    return out


def confusion(assigned: DataFrame, truth: Column, clusters: int) -> DataFrame:
    """(truth, cluster, cnt) for all pairs, zeros too."""
    every = assigned.sparkSession.range(clusters * clusters).select((F.col("id") / clusters).cast("int").alias("truth"), (F.col("id") % clusters).cast("int").alias("cluster"))
    found = assigned.groupBy(truth.cast("int").alias("truth"), "cluster").agg(F.count("*").alias("cnt"))
    return every.join(found, ["truth", "cluster"], "left").select("truth", "cluster", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def greedy_matching(confused: DataFrame, clusters: int) -> DataFrame:
    """(truth, cluster): in order of truth, the unused cluster it shares most with; the lower of equals.

    Works on one row that holds the K x K counts: an aggregate that carries the clusters taken so far.
    """
    rows = confused.groupBy("truth").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "cnt"))), lambda s: s["cnt"]).alias("counts"))
    table = rows.agg(F.array_sort(F.collect_list(F.struct("truth", "counts"))).alias("rows"))
    left = lambda row, used: F.transform(row["counts"], lambda v, k: F.when(F.array_contains(used, k), F.lit(-1).cast("bigint")).otherwise(v))
    best = lambda row, used: (F.array_position(left(row, used), F.array_max(left(row, used))) - 1).cast("int")
    path = F.aggregate("rows", F.array().cast("array<int>"), lambda used, row: F.concat(used, F.array(best(row, used))))
    return table.select(F.posexplode(path).alias("truth", "cluster"))


def accuracy(confused: DataFrame, matching: DataFrame) -> DataFrame:
    """One row: the share of rows whose cluster is the one matched to their truth."""
    hits = confused.join(matching.withColumnRenamed("cluster", "match"), "truth")
    return hits.agg((F.sum(F.when(F.col("cluster") == F.col("match"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("accuracy"))


def two_class_accuracy(confused: DataFrame) -> DataFrame:
    """Of two clusters without a matching: the share on the diagonal, or off it if that is more."""
    share = F.sum(F.when(F.col("truth") == F.col("cluster"), F.col("cnt")).otherwise(0)) / F.sum("cnt")
    return confused.agg(F.greatest(share, 1 - share).alias("accuracy"))


def _f1(tp: Column, predicted: Column, actual: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where there is no true positive."""
    return F.when(tp > 0, 2 * tp / (predicted + actual)).otherwise(F.lit(0.0))


def class_f1(confused: DataFrame, matching: DataFrame) -> DataFrame:
    hit = confused.join(matching, ["truth", "cluster"]).select("truth", "cluster", F.col("cnt").alias("tp"))
    actual = confused.groupBy("truth").agg(F.sum("cnt").alias("actual"))
    predicted = confused.groupBy("cluster").agg(F.sum("cnt").alias("predicted"))
    return hit.join(actual, "truth").join(predicted, "cluster").select("truth", "cluster", _f1(F.col("tp"), F.col("predicted"), F.col("actual")).alias("f1"))


def macro_f1(confused: DataFrame, matching: DataFrame) -> DataFrame:
    return class_f1(confused, matching).agg(F.avg("f1").alias("macro_f1"))


def network_confusion(true: DataFrame, found: DataFrame, above: float = 1e-2) -> DataFrame:
    """Of matrices in long form (cluster, i, j, v): counts of entries by (true edge, found edge), diagonal included."""
    edge = lambda c: (F.abs(c) > above).cast("int")
    met = true.select("cluster", "i", "j", (F.col("v") != 0).cast("int").alias("true_edge")).join(found.select("cluster", "i", "j", edge(F.col("v")).alias("found_edge")), ["cluster", "i", "j"])
    return met.groupBy("cluster", "true_edge", "found_edge").agg(F.count("*").alias("cnt"))


def network_f1(confused: DataFrame) -> DataFrame:
    """(cluster, f1): the mean F1 of the two classes, edge and no edge."""
    n = lambda a, b: F.coalesce(F.sum(F.when((F.col("true_edge") == a) & (F.col("found_edge") == b), F.col("cnt"))), F.lit(0))
    each = confused.groupBy("cluster").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    edge = _f1(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    none = _f1(F.col("tn"), F.col("tn") + F.col("fn"), F.col("tn") + F.col("fp"))
    return each.select("cluster", ((edge + none) / 2).alias("f1"), _f1(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")).alias("edge_f1"))


def network_accuracy(scored: DataFrame) -> DataFrame:
    """One row: the mean over clusters of ``network_f1``."""
    return scored.agg(F.avg("f1").alias("network_accuracy"))


def bic(assigned: DataFrame, model: DataFrame, rows: int, above: float = 2e-5, per_segment: bool = True) -> DataFrame:
    """One row. ``model``: (cluster, log_det_theta, trace, nnz). Entries count once for each segment, or each cluster.

    By segment the fits of the clusters are added up, otherwise averaged; the fits of all clusters of the
    model, whether a label uses them or not, while by cluster only the entries of those that are used count.
    """
    used = model.join(assigned.select("cluster").distinct(), "cluster")
    n = segments(assigned).join(model, "cluster").agg(F.sum("nnz")) if per_segment else used.agg(F.sum("nnz"))
    fit = (model if per_segment else used).agg((F.sum if per_segment else F.avg)(F.col("log_det_theta") - F.col("trace")).alias("fit"))
    return fit.crossJoin(n.toDF("nnz")).select((F.col("nnz") * F.log(F.lit(float(rows))) - 2 * F.col("fit")).alias("bic"))


def matrix_long(model: DataFrame, column: str, d: int) -> DataFrame:
    """(cluster, i, j, v) of matrices held row by row."""
    at = model.select("cluster", F.posexplode(column).alias("at", "v"))
    return at.select("cluster", F.floor(F.col("at") / d).cast("int").alias("i"), (F.col("at") % d).alias("j"), "v")


def edges(matrices: DataFrame, window: int, sensors: int, above: float = 2e-5, sensor: int | None = None) -> DataFrame:
    """(cluster, lag, src, dst, weight): what the newest observation depends on, ``lag`` steps back."""
    last = (window - 1) * sensors
    found = matrices.where((F.col("i") >= last) & (F.abs("v") > above) & ((F.col("j") < last) | (F.col("j") - last < F.col("i") - last)))
    out = found.select("cluster", (window - 1 - F.floor(F.col("j") / sensors)).cast("int").alias("lag"), (F.col("j") % sensors).cast("int").alias("src"), (F.col("i") - last).cast("int").alias("dst"), F.col("v").alias("weight"))
    return out if sensor is None else out.where(F.col("dst") == sensor)


def norm_rank(model: DataFrame, column: str = "sigma") -> DataFrame:
    """(cluster, norm, place): clusters by falling Frobenius norm, the higher number first among equals; K rows."""
    from tidemark.functions.arrays import frobenius

    ranked = model.select("cluster", frobenius(F.col(column)).alias("norm"))
    return ranked.withColumn("place", (F.row_number().over(Window.orderBy(F.desc("norm"), F.desc("cluster"))) - 1).cast("int"))

"""Fitting regimes: alternate cluster estimation and assignment until the labels stand still."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce
from operator import or_

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lasso, metrics, moments, scoring, windows
from tidemark.operators.ordering import chunk_of, drawn
from tidemark.plans import mixture as mixtures
from tidemark.plans.storage import Tables, stored

LOG = logging.getLogger(__name__)
ROW = "cluster int, n bigint, mean array<double>, cov array<double>, theta array<double>, sparse array<double>, sigma array<double>, log_det double, iterations int, converged boolean"


CELLS = 1 << 23  #: numbers of windows that a task holds at once: 64 MB


@dataclass(frozen=True)
class Parameters:
    window: int = 10
    clusters: int = 5
    lam: float = 0.11
    beta: float = 400.0
    most_rounds: int = 1000
    threshold: float = 2e-5
    reassign: int = 20
    empty: str = "repair"  #: of a cluster without windows: repair, or drop; then it has no networks in the next round, so no window can take it
    biased: bool = False
    init: str = "gmm"  #: gmm, kmeans, random or given
    lam_mode: str = "flat"  #: flat, lag_scaled, or matrix: then ``penalty`` is the whole matrix, row by row
    penalty: tuple[tuple[float, ...], ...] | None = None
    tail: str = "zero"
    rho: float = 1.0
    rho_update: Callable[[float, float, float], float] | None = None  #: (rho, primal, dual) -> rho; not saved with a model
    floor: float = 1e-4
    eps: float = 1e-6
    seed: int = 102
    chunk: int = 100_000

    def __post_init__(self):
        if self.most_rounds < 1 or self.window < 1 or self.clusters < 1:
            raise ValueError("most_rounds, window and clusters must be at least 1")
        if self.beta < 0 or self.lam < 0:
            raise ValueError("beta and lam must not be negative")
        if self.lam_mode not in ("flat", "lag_scaled", "matrix") or (self.lam_mode == "matrix") != (self.penalty is not None):
            raise ValueError("lam_mode is flat, lag_scaled or matrix, and only matrix takes a penalty")
        if self.empty not in ("repair", "drop"):
            raise ValueError("empty is repair or drop")

    def rows(self, sensors: int) -> int:
        """Rows of a chunk of time: at most ``chunk``, and fewer where windows are wide."""
        return max(self.window, min(self.chunk, CELLS // (self.window * sensors)))

    def penalties(self, sensors: int) -> float | np.ndarray:
        if self.lam_mode == "matrix":
            penalty = np.asarray(self.penalty, float)
            if penalty.shape != (self.window * sensors,) * 2 or (penalty < 0).any() or not np.allclose(penalty, penalty.T):
                raise ValueError(f"a penalty matrix must be symmetric, not negative, and {self.window * sensors} wide")
            return penalty
        return lasso.lag_scaled(self.lam, self.window, sensors) if self.lam_mode == "lag_scaled" else self.lam


@dataclass
class Model:
    """A few matrices for each cluster; a table of K rows when stored."""

    parameters: Parameters
    sensors: int
    rows: dict[int, dict] = field(default_factory=dict)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means, inverse covariances and log det Sigma; a dropped cluster's is endless, and so is what any window costs there."""
        missing = [k for k in range(self.parameters.clusters) if k not in self.rows]
        if missing and (self.parameters.empty != "drop" or not self.rows):
            raise ValueError(f"clusters {missing} have no windows to be estimated from")
        d = self.sensors * self.parameters.window
        dropped = {"mean": np.zeros(d), "theta": np.zeros(d * d), "log_det": np.inf}
        each = [self.rows.get(k, dropped) for k in range(self.parameters.clusters)]
        return np.array([r["mean"] for r in each]), np.array([r["theta"] for r in each]).reshape(-1, d, d), np.array([r["log_det"] for r in each])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[c.split()[0]] for c in ROW.split(", ")) for _, r in sorted(self.rows.items())], ROW)

    def networks(self, spark: SparkSession, column: str = "sparse") -> DataFrame:
        return metrics.matrix_long(self.table(spark), column, self.sensors * self.parameters.window)

    def edges(self, spark: SparkSession, sensor: int | None = None) -> DataFrame:
        return metrics.edges(self.networks(spark), self.parameters.window, self.sensors, self.parameters.threshold, sensor)

    def save(self, spark: SparkSession, path: str) -> None:
        """K rows, each with the parameters and the number of sensors, so that the table alone is the model."""
        known = json.dumps({f.name: getattr(self.parameters, f.name) for f in fields(Parameters) if f.name != "rho_update"})
        self.table(spark).select("*", F.lit(self.sensors).alias("sensors"), F.lit(known).alias("parameters")).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = [r.asDict() for r in spark.read.parquet(path).collect()]
        known = json.loads(rows[0]["parameters"])
        known["penalty"] = known["penalty"] and tuple(map(tuple, known["penalty"]))
        return cls(Parameters(**known), rows[0]["sensors"], {r["cluster"]: r for r in rows})

    def costs(self, stacked: DataFrame) -> DataFrame:
        return scoring.cost_table(stacked, *self.arrays())

    def predict(self, stacked: DataFrame, chunks: int | None = None) -> DataFrame:
        """(series_id, t, cluster) of stacked windows (series_id, t, x, full)."""
        kinds = dict(stacked.dtypes)
        if kinds.get("x") != "array<double>" or "t" not in kinds:
            raise TypeError("windows need t and x array<double>")
        shared, p = stacked.sparkSession.sparkContext.broadcast(self.arrays()), self.parameters
        return scoring.assign(stacked, p.beta, p.rows(self.sensors), scoring.model_costs(shared), chunks)


    def predict_packed(self, chunks: DataFrame, many: int | None = None) -> DataFrame:
        """As ``predict`` for the windows of PACKED chunks; ``many``: how many the longest series has, if known."""
        shared, p = chunks.sparkSession.sparkContext.broadcast(self.arrays()), self.parameters
        return scoring.assign_packed(chunks, p.beta, shared, p.window, self.sensors, many)

    def predict_rolling(self, stacked: DataFrame, block: int, first: DataFrame | None = None) -> DataFrame:
        """(series_id, t, cluster): what the ``block`` windows before each ``t`` alone say; ``first``: labels of the rows before those."""
        shared, p = stacked.sparkSession.sparkContext.broadcast(self.arrays()), self.parameters
        return scoring.rolling(stacked, p.beta, block, p.rows(self.sensors), scoring.model_costs(shared), first)


@dataclass
class Fit:
    assignments: DataFrame
    model: Model
    rounds: int
    converged: bool
    bic: float | None = None


def _solver(p: Parameters, sensors: int):
    penalty = p.penalties(sensors)

    def one(cluster: int, n: int, mean: np.ndarray, m2: np.ndarray) -> tuple | None:
        if p.empty == "drop" and n < 2 and not p.biased:
            return None  # a single window has no covariance
        cov = moments.covariance(n, m2, p.biased, cluster)
        found = lasso.solve_separately(cov, p.window, penalty, rho=p.rho, eps_abs=p.eps, eps_rel=p.eps, floor=p.floor, rho_update=p.rho_update)
        log_det = -np.linalg.slogdet(found.theta)[1]
        return cluster, n, mean, cov.ravel(), found.theta.ravel(), found.sparse.ravel(), np.linalg.inv(found.theta).ravel(), log_det, found.iterations, found.converged

    return one


def estimate(stacked: DataFrame, assigned: DataFrame, p: Parameters, sensors: int, tasks: int | None = None) -> dict[int, dict]:
    """Mean and sparse inverse covariance of each cluster that has windows, stacked or packed: a task for each cluster, K rows back.

    ``tasks``: how many partitions the windows are in, if known.
    """
    if "own" in stacked.columns:
        partial = moments.partial_moments_packed(stacked, assigned.withColumn("c", chunk_of(F.col("t"), max(p.window, p.rows(sensors)))), p.window, sensors)
    else:
        partial = moments.partial_moments(stacked.join(assigned, ["series_id", "t"]).select("cluster", "x"))
    return {r["cluster"]: r.asDict() for r in moments.finished(partial, _solver(p, sensors), ROW, tasks).collect()}


def initial(stacked: DataFrame, p: Parameters, tasks: int | None = None) -> DataFrame:
    keys = stacked.select("series_id", "t", "x")
    if p.init == "random":
        number = F.conv(F.substring(F.md5(F.concat_ws(":", "series_id", F.col("t").cast("string"), F.lit(str(p.seed)))), 1, 8), 16, 10).cast("bigint")
        return keys.select("series_id", "t", (number % p.clusters).cast("int").alias("cluster"))
    if p.init not in ("gmm", "kmeans"):
        raise ValueError(f"unknown init {p.init!r}: give labels for 'given'")
    if p.init == "gmm":
        found = mixtures.start(keys, p.clusters, p.seed, tasks)
        if found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").count() == p.clusters:
            return found
        LOG.warning("no start of the Gaussian mixture has windows in all components; K-means starts instead")
    vectors = keys.withColumn("features", array_to_vector("x"))
    return stored(KMeans(k=p.clusters, seed=p.seed).fit(vectors).transform(vectors).select("series_id", "t", F.col("prediction").cast("int").alias("cluster")))


def members(assigned: DataFrame, sizes: dict[int, int], most: int, seed: int) -> dict[int, list[tuple[str, int]]]:
    """For each cluster of ``sizes`` (its number of rows) the ``most`` rows of the smallest draws, in order of them.

    Only rows under a bound on the draw come back, about twice as many as are wanted; a bound that let
    too few through is doubled.
    """
    out, share = {}, {k: min(1.0, 2 * most / n) for k, n in sizes.items() if n}
    while share:
        bound = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * 2**52)))])
        some = assigned.where(F.col("cluster").isin(*share)).withColumn("draw", drawn(seed)).where(F.col("draw") < bound[F.col("cluster")])
        met: dict[int, list[tuple]] = {k: [] for k in share}
        for r in some.select("cluster", "draw", "series_id", "t").collect():
            met[r["cluster"]].append((r["draw"], r["series_id"], r["t"]))
        for k, rows in met.items():
            if len(rows) >= most or share[k] >= 1.0:
                out[k] = [r[1:] for r in sorted(rows)[:most]]
                del share[k]
            else:
                share[k] = min(1.0, 2 * share[k])
    return out


def starts(empty: list[int], donors: list[int], at: dict[int, list[tuple[str, int]]], run: int) -> dict[int, tuple[str, int]]:
    """For each empty cluster a row of its donor from which ``run`` rows are to go, none of which goes to another too.

    Where a donor is too small for that, runs may overlap, but each still begins at a row that no other has.
    """
    out: dict[int, tuple[str, int]] = {}
    for k, donor in zip(empty, donors, strict=True):
        apart = lambda r, least: all(r[0] != s or abs(r[1] - t) >= least for s, t in out.values())  # noqa: B023, E731
        found = next((r for least in (run, 1) for r in at.get(donor, []) if apart(r, least)), None)
        if found is not None:
            out[k] = found
    return out


def repair(assigned: DataFrame, model: Model, empty: list[int], p: Parameters, turn: int, sizes: dict[int, int] | None = None, stacked: DataFrame | None = None) -> DataFrame:
    """Gives each empty cluster ``reassign`` rows in a row, from the clusters of largest covariance in turn.

    Each run begins at a member of its donor chosen by a seeded draw, a member of its own for each empty cluster,
    and its rows go whatever their own label is; a row that two runs reach belongs to the later run's start.
    An empty cluster takes over its donor's matrices, around the last window that it got (of ``stacked``, if given; PACKED chunks do too).
    ``sizes``: rows of each cluster, if known.
    """
    sizes = sizes or {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    norms = sorted(((float(np.linalg.norm(model.rows[k]["sigma"])), k) for k in model.rows if k not in empty and sizes.get(k)), reverse=True)
    if not norms:
        return assigned
    donors = [norms[nth % len(norms)][1] for nth in range(len(empty))]
    most = (len(empty) - 1) * (2 * p.reassign - 1) + 1  # each run rules out so many starts, so one is left among as many
    found = starts(empty, donors, members(assigned, {k: sizes[k] for k in set(donors)}, most, p.seed + turn), p.reassign)
    ends = {r["series_id"]: r["last"] for r in assigned.where(F.col("series_id").isin(*{s for s, _ in found.values()})).groupBy("series_id").agg(F.max("t").alias("last")).collect()} if stacked is not None else {}
    last = {k: (s, min(t + p.reassign - 1, ends.get(s, t))) for k, (s, t) in found.items()}
    seen = {(r["series_id"], r["t"]): r["x"] for r in windows_at(stacked, set(last.values()), p, model.sensors)} if stacked is not None else {}
    cluster = F.col("cluster")
    for k, (series_id, t) in sorted(found.items(), key=lambda kv: kv[1][1]):
        donor = donors[empty.index(k)]
        LOG.info("cluster %d is empty: %d rows from %d go to it", k, p.reassign, t)
        model.rows[k] = model.rows[donor] | {"cluster": k}
        if last[k] in seen:
            model.rows[k]["mean"] = list(seen[last[k]])
        cluster = F.when((F.col("series_id") == series_id) & F.col("t").between(t, t + p.reassign - 1), F.lit(k)).otherwise(cluster)
    return assigned.withColumn("cluster", cluster)


def windows_at(held: DataFrame, places: set[tuple[str, int]], p: Parameters | None = None, sensors: int = 0) -> list:
    """A few windows by their places, of stacked windows or of PACKED chunks."""
    if not places:
        return []
    if "own" in held.columns:
        inside = [(F.col("series_id") == s) & F.lit(t).between(F.col("first"), F.col("first") + F.col("own") - 1) for s, t in sorted(places)]
        held = windows.unpacked(held.where(reduce(or_, inside)), p.window, sensors)
    named = F.array(*[F.struct(F.lit(s).alias("series_id"), F.lit(t).cast("bigint").alias("t")) for s, t in sorted(places)])
    return held.where(F.array_contains(named, F.struct("series_id", "t"))).select("series_id", "t", "x").collect()


def checked(series: DataFrame, sensors: int, chunk: int) -> tuple[int, int]:
    """How many rows the longest series has, and about how many chunks all have; an error that names the sensor if a value is missing."""
    missing = F.array_position(F.transform("x", lambda v: v.isNull() | F.isnan(v)), True)
    wrong = F.when(F.coalesce(F.size("x"), F.lit(-1)) != sensors, F.lit(0)).when(missing > 0, missing)
    chunks = F.approx_count_distinct(F.struct("series_id", chunk_of(F.col("t"), chunk)))
    found = series.agg(F.min(wrong).alias("first"), F.count(wrong).alias("n"), F.max("t").alias("last"), chunks.alias("chunks")).first()
    if found["first"] == 0:
        raise ValueError(f"rows do not have {sensors} sensors")
    if found["n"]:
        raise ValueError(f"{found['n']} rows have no number, the first of them in sensor {found['first'] - 1}; fill or drop them first")
    return 0 if found["last"] is None else found["last"] + 1, found["chunks"]


def census(assigned: DataFrame) -> dict[int, tuple]:
    """For each cluster its number of windows and two digests of which they are: equal for equal labels, in one pass without a join."""
    key = F.xxhash64("series_id", "t")
    found = assigned.groupBy("cluster").agg(F.count("*"), F.bit_xor(key), F.sum(F.hash("t", "series_id").cast("bigint")))
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def fit(series: DataFrame, sensors: int, parameters: Parameters, labels: DataFrame | None = None, with_bic: bool = False) -> Fit:
    """Fits ``series`` (series_id, t from 0 without gaps, x). ``labels``: (series_id, t, cluster) to start from.

    Labels are compared with those of the round before, before its repair. As long as a cluster
    stays empty the rounds go on, to ``most_rounds`` at most. The observations are dealt by chunk of time
    once, into no more partitions than twice the chunks there are, and held as they are: windows are stacked inside tasks only. A round moves labels, moments, the
    windows' K costs, and a K x K matrix for each chunk. Labels older than the round before are deleted.
    With ``empty="drop"`` nothing is repaired: a round has the clusters alone that the labels before it leave with windows.
    """
    p, spark = parameters, series.sparkSession
    LOG.info("fit of %d sensors: %s", sensors, p)
    series, tables = stored(series), Tables(spark, "fit")
    rows, every = checked(series, sensors, p.rows(sensors))
    chunks = -(-rows // p.rows(sensors))
    dealt = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * every))  # passes cost tasks, so a short series is not spread thin
    held = windows.packed(series, p.window, sensors, p.tail, p.rows(sensors), dealt).persist()
    start = labels.select("series_id", "t", F.col("cluster").cast("int").alias("cluster")) if labels is not None else initial(windows.unpacked(held, p.window, sensors), p, dealt)
    assigned, model, before, converged, turn = tables.write(start, "start"), Model(p, sensors), None, False, 0
    for turn in range(p.most_rounds):
        model.rows = (model.rows if p.empty == "repair" else {}) | estimate(held, assigned, p, sensors, dealt)
        found = tables.write(model.predict_packed(held, chunks), f"found_{turn}")
        now = after = census(found)
        empty = [k for k in range(p.clusters) if k not in now] if p.empty == "repair" else []
        assigned = found
        if empty and turn:
            assigned = tables.write(repair(found, model, empty, p, turn, {k: v[0] for k, v in now.items()}, held), f"repaired_{turn}")
            after = census(assigned)
        LOG.info("round %d: %s", turn, {k: now.get(k, (0,))[0] for k in range(p.clusters)})
        converged, before = before == after, now
        for old in (f"found_{turn - 2}", f"repaired_{turn - 2}", "start"):
            if turn > 1 or old == "start":
                tables.drop(old)
        if converged:
            break
    score = None
    if with_bic:
        score = metrics.bic(assigned, information(model, spark), series.count(), p.threshold).first()["bic"]
    held.unpersist()
    return Fit(assigned, model, turn + 1, converged, score)


def information(model: Model, spark: SparkSession) -> DataFrame:
    """(cluster, log_det_theta, trace, nnz): what the information criterion needs of each cluster."""
    size = F.size(F.filter("theta", lambda v: F.abs(v) > model.parameters.threshold))
    trace = F.aggregate(F.zip_with("cov", "theta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return model.table(spark).select("cluster", (-F.col("log_det")).alias("log_det_theta"), trace.alias("trace"), size.cast("bigint").alias("nnz"))


def sample_networks(labelled: DataFrame, biased: bool = False) -> DataFrame:
    """(cluster, theta): the plain inverse covariance of the windows (cluster, x) of any clustering, as a baseline."""
    one = lambda cluster, n, mean, m2: (cluster, np.linalg.pinv(moments.covariance(n, m2, biased, cluster), hermitian=True).ravel())
    return moments.finished(moments.partial_moments(labelled), one, "cluster int, theta array<double>")

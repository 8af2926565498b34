"""The segmentation engine against closed forms, brute force and plain numpy."""

import itertools
from functools import partial, reduce

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from tidemark.functions import arrays
from tidemark.operators import lasso, metrics, moments, ordering, prepare, scoring, windows
from tidemark.plans import fit as fitting
from tidemark.plans import mixture as mixtures
from tidemark.sources import exports, readers, synth
from tidemark.streaming import resumable
from tidemark.streaming.score import Path, score_stream


def series(spark, x, series_id="0"):
    x = np.asarray(x, float)
    return spark.createDataFrame([(series_id, t, v.tolist()) for t, v in enumerate(x)], "series_id string, t bigint, x array<double>")


def sequential(costs, beta):
    t, k = costs.shape
    f = np.zeros((t, k))
    for i in range(t - 2, -1, -1):
        for c in range(k):
            f[i, c] = min(f[i + 1, j] + costs[i + 1, j] + beta * (j != c) for j in range(k))
    path = [int((f[0] + costs[0]).argmin())]
    for i in range(1, t):
        path.append(int(np.argmin([f[i, j] + costs[i, j] + beta * (j != path[-1]) for j in range(k)])))
    return path


def price(costs, path, beta):
    return sum(costs[i, c] for i, c in enumerate(path)) + beta * sum(a != b for a, b in zip(path, path[1:], strict=False))


@given(st.integers(1, 6), st.integers(1, 3), st.floats(0, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_one_chunk_path_is_the_cheapest(t, k, beta, seed):
    costs = np.random.default_rng(seed).normal(size=(t, k))
    path = scoring.trace(costs, None, beta, None).tolist()
    assert path == sequential(costs, beta)
    assert price(costs, path, beta) == pytest.approx(min(price(costs, p, beta) for p in itertools.product(range(k), repeat=t)))


@given(st.integers(1, 40), st.integers(1, 4), st.floats(0, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_blocks_of_a_chunk_are_the_plain_recursion(t, k, beta, seed):
    r = np.random.default_rng(seed)
    costs, after = r.normal(size=(t, k)), r.normal(size=k)
    g, want = after, []
    for c in costs[::-1]:
        g = np.minimum(g, g.min() + beta) + c
        want.append(g)
    want = np.array(want[::-1])
    assert np.allclose(scoring.totals(costs, after, beta), want)
    unit = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    first = scoring.chained(scoring.products(costs, beta), unit)[0]
    assert np.allclose(scoring.through(first, after), want[0])
    ways = scoring.ways(want, beta)
    for entry in range(k):
        now, path = entry, []
        for i in range(t):
            now = int(np.argmin([want[i, j] + beta * (j != now) for j in range(k)]))
            path.append(now)
        assert scoring.trace(costs, after, beta, entry).tolist() == path and scoring.last_of(ways)[entry] == path[-1]


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("beta", [0.0, 0.7, 50.0])
def test_chunked_assignment_is_the_sequential_one(spark, beta, levels, monkeypatch):
    monkeypatch.setattr(scoring, "ONE_LEVEL", 1024 if levels == 1 else 4)
    r = np.random.default_rng(1)
    made = {s: r.normal(size=(n, 4)) for s, n in (("a", 150), ("b", 37), ("c", 1))}
    made["a"][40:60] = 0.0  # ties
    table = spark.createDataFrame([(s, t, c.tolist()) for s, costs in made.items() for t, c in enumerate(costs)], "series_id string, t bigint, cost array<double>")
    for chunk in (1, 10, 1000):
        found = scoring.assign(table.repartition(3), beta, chunk).toPandas().sort_values("t")
        for s, costs in made.items():
            assert found[found.series_id == s].cluster.tolist() == sequential(costs, beta)
    with pytest.raises(ValueError):
        scoring.assign(table, -1.0)
    assert scoring.assign(table.limit(0), beta, 10).count() == 0


@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 20), st.floats(0, 5), st.integers(0, 10**6))
@settings(max_examples=80, deadline=None)
def test_rolling_blocks_end_as_their_own_path(t, k, block, beta, seed):
    costs = np.random.default_rng(seed).normal(size=(t, k))
    got = scoring.last_labels(costs, beta, block)
    assert got.tolist() == [sequential(costs[i : i + block], beta)[-1] for i in range(t - block + 1)]


@pytest.mark.parametrize("chunk", [1, 7, 1000])
@pytest.mark.parametrize("block", [1, 5, 30])
def test_rolling_over_chunks(spark, block, chunk):
    made = {s: np.random.default_rng(3).normal(size=(n, 3)) for s, n in (("a", 80), ("b", 31), ("c", 4))}
    table = spark.createDataFrame([(s, t, c.tolist()) for s, costs in made.items() for t, c in enumerate(costs)], "series_id string, t bigint, cost array<double>")
    first = table.select("series_id", "t", F.lit(9).alias("cluster"))
    got = scoring.rolling(table.repartition(3), 0.7, block, chunk, first=first).toPandas().sort_values("t")
    for s, costs in made.items():
        want = [9] * min(block, len(costs)) + [sequential(costs[i - block : i], 0.7)[-1] for i in range(block, len(costs))]
        assert got[got.series_id == s].cluster.tolist() == want
    with pytest.raises(ValueError):
        scoring.rolling(table, 1.0, 0)


def test_stack_over_chunks(spark):
    x = np.arange(60.0).reshape(30, 2)
    n = 30 - 3 + 1
    want = np.array([np.concatenate([x[i + k] if i + k < n else np.zeros(2) for k in range(3)]) for i in range(n)])
    for chunk in (4, 9, 1000):
        got = windows.stack(series(spark, x), 3, 2, chunk=chunk).orderBy("t").toPandas()
        assert np.array_equal(np.stack(got.x), want)
        assert got.full.tolist() == [i + 2 < n for i in range(n)]
        data = windows.stack(series(spark, x), 3, 2, "data", chunk).orderBy("t").toPandas()
        assert np.array_equal(np.stack(data.x), np.array([x[i : i + 3].ravel() for i in range(n)]))
        assert windows.stack(series(spark, x), 3, 2, "drop", chunk).count() == n - 2
    assert windows.stack(series(spark, x[:2]), 3, 2).count() == 0
    for bad in ("t * 2", "t + 1", "t div 2"):  # a gap, a late start, repeats: an error whatever the chunk
        for chunk in (4, 1000):
            with pytest.raises(Exception, match="gaps or repeats"):
                windows.stack(series(spark, x).withColumn("t", F.expr(bad)), 3, 2, chunk=chunk).collect()
    closed = ordering.with_rank(series(spark, x).withColumn("t", F.col("t") * 2)).select("series_id", F.col("rank").cast("bigint").alias("t"), "x")
    assert windows.stack(closed, 3, 2, chunk=4).where("full").count() == 30 - 4
    with pytest.raises(ValueError):
        windows.stack(series(spark, x), 0, 2)


@pytest.mark.parametrize("window", [1, 2, 5])
@pytest.mark.parametrize("runs", ["long", "short", "one"])
def test_lag_moments_are_those_of_stacked_windows(window, runs):
    r = np.random.default_rng(window)
    x = r.normal(3, 2, (90 + window - 1, 3))
    labels = {"long": np.arange(90) // 20 % 3, "short": r.integers(0, 3, 90), "one": np.where(np.arange(90) == 44, 1, 0)}[runs]
    labels[50:53] = -1  # without a label
    stacked = windows.windows_of(x, window)
    got = moments.lag_moments(x, labels, window)
    assert set(got) == set(labels[labels >= 0].tolist())
    for k, (n, mean, m2) in got.items():
        own = stacked[labels == k]
        assert n == len(own) and np.allclose(mean, own.mean(0)) and np.allclose(m2, (own - own.mean(0)).T @ (own - own.mean(0)))


@pytest.mark.parametrize("tail", ["zero", "drop", "data"])
def test_packed_chunks_hold_the_stacked_windows(spark, tail):
    x = np.random.default_rng(9).normal(size=(61, 2))
    two = series(spark, x).union(series(spark, x[:17] + 5, "b"))
    for window, chunk in ((1, 7), (4, 5), (4, 1000)):
        want = windows.stack(two, window, 2, tail, chunk).toPandas()
        held = windows.packed(two, window, 2, tail, chunk, 3)
        assert rows(windows.unpacked(held, window, 2).toPandas()) == rows(want)
        labels = windows.stack(two, window, 2, tail).select("series_id", "t", (F.floor(F.col("t") / 9) % 2).cast("int").alias("cluster"))
        dealt = moments.partial_moments_packed(held, labels.withColumn("c", ordering.chunk_of(F.col("t"), max(window, chunk))), window, 2)
        for row in moments.merged(dealt).collect():
            own = np.stack(want[(want.t // 9 % 2) == row["cluster"]].x)
            assert row["n"] == len(own) and np.allclose(row["mean"], own.mean(0)) and np.allclose(np.reshape(row["m2"], (2 * window, -1)), (own - own.mean(0)).T @ (own - own.mean(0)))


def test_order_helpers(spark):
    long = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("t"), F.lit("0").alias("series_id"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    ranked = ordering.with_rank(long, chunk=100).select("t", "rank").collect()
    assert all(r["rank"] * 3 == r["t"] for r in ranked)
    got = ordering.carried(long, {"last": F.col("v")}, chunk=100).collect()
    assert all(r["last"] == r["t"] // 15 * 5 for r in got)
    after = {r["t"]: r["next"] for r in ordering.carried(long, {"next": F.col("v")}, strict=True, forward=False, chunk=100).collect()}
    assert all(n == (t // 15 + 1) * 5 or (n is None and t >= 2985) for t, n in after.items())
    numbered = ordering.with_ordinal(spark.range(50, 90, 1, 5).toDF("v")).collect()
    assert all(r["v"] - 50 == r["t"] for r in numbered)


@pytest.mark.parametrize("bits", [2, 12])
def test_exact_numbers_of_rows_are_drawn(spark, bits, monkeypatch):
    keys = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("series_id"), F.floor(F.col("id") / 3).alias("t")).repartition(5)
    order = [tuple(r) for r in keys.withColumn("draw", ordering.drawn(4)).orderBy("draw", "series_id", "t").select("series_id", "t").collect()]
    for most in (0, 1, 7, 500, 999, 1000, 2000):
        got = {tuple(r) for r in keys.where(ordering.smallest_draws(keys, most, 4, bits)).collect()}
        assert got == set(order[:most])
    monkeypatch.setattr(ordering, "drawn", lambda seed: F.col("t") % 4)  # ties
    got = {tuple(r) for r in keys.where(ordering.smallest_draws(keys, 100, 4, bits)).collect()}
    assert got == {tuple(r) for r in keys.orderBy(F.col("t") % 4, "series_id", "t").limit(100).collect()}
    train, test = prepare.split_exact(series(spark, np.zeros((50, 1))), 2, 50, 0.5, ends=False, seed=3, whole=True)
    a, b = ({r["t"] for r in d.collect()} for d in (train, test))
    assert len(a) == 25 and a | b == set(range(50)) and not a & b


def test_preparation(spark):
    gaps = spark.createDataFrame([("0", t, [v, 1.0]) for t, v in enumerate([None, 1.0, None, None, 4.0, None])], "series_id string, t bigint, x array<double>")
    assert [r["x"][0] for r in prepare.forward_fill(gaps, 2).orderBy("t").collect()] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    scaled = prepare.range_normalize(gaps, 2).orderBy("t").collect()
    assert [r["x"][0] for r in scaled] == [None, -0.5, None, None, 0.5, None]
    assert all(r["x"][1] is None for r in scaled)  # a constant sensor has no range
    assert [r["t"] for r in prepare.skip_rows(gaps, 4).collect()] == [0, 1]
    train, test = prepare.split(series(spark, np.zeros((50, 1))), 2, 50)
    a, b = ({r["t"] for r in d.collect()} for d in (train, test))
    assert not a & b and a | b == set(range(49)) and {0, 48} <= a
    few, rest = ({r["t"] for r in d.collect()} for d in prepare.split(series(spark, np.zeros((500, 1))), 3, 500, 0.5, seed=1, whole=True))
    other = {r["t"] for r in prepare.split(series(spark, np.zeros((500, 1))), 3, 500, 0.5, seed=2)[0].collect()}
    assert not few & rest and few | rest == set(range(500)) and {498, 499} <= rest and 200 < len(few) < 300 and few != other
    for r in prepare.neighbours(train, test).collect():
        assert r["left"] == max(t for t in a if t < r["t"]) and r["right"] == min(t for t in a if t > r["t"])


def test_moments(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3)) + 1e6
    table = spark.createDataFrame([(k % 2, v.tolist()) for k, v in enumerate(x)], "cluster int, x array<double>").repartition(5)
    for row in moments.moments(table).collect():
        own = x[row["cluster"] :: 2]
        assert row["n"] == 200 and np.allclose(row["mean"], own.mean(0))
        assert np.allclose(np.reshape(row["cov"], (3, 3)), np.cov(own.T), atol=1e-6)
    alone = spark.createDataFrame([(0, [1.0])], "cluster int, x array<double>")
    with pytest.raises(Exception, match="needs two"):
        moments.moments(alone).collect()
    assert moments.moments(alone, biased=True).first()["cov"] == [0.0]
    partial = moments.partial_moments(table.repartition(12))
    assert moments.by_cluster(partial, 3).rdd.getNumPartitions() and moments.by_cluster(partial, 4).count() <= 8 < partial.count()
    for row in moments.finished(moments.by_cluster(partial, 4), lambda c, n, mean, m2: (int(c), int(n), mean, (m2 / (n - 1)).ravel()), "cluster int, n bigint, mean array<double>, cov array<double>").collect():
        assert row["n"] == 200 and np.allclose(np.reshape(row["cov"], (3, 3)), np.cov(x[row["cluster"] :: 2].T), atol=1e-6)
    assert [(c["cluster"], c["n"]) for c in moments.counts(alone, 2).orderBy("cluster").collect()] == [(0, 1), (1, 0)]


def test_lasso_closed_forms():
    r = np.random.default_rng(3)
    s = np.cov(r.normal(size=(12, 300)))
    lam = 1.0
    found = lasso.solve(s, 3, lam, floor=0.0, eps_abs=1e-10, eps_rel=1e-10)
    mean = [np.mean([s[b * 4 + j, b * 4 + j] for b in range(3)]) for j in range(4)]
    assert np.allclose(found.sparse, np.diag(np.tile(1 / (np.array(mean) + lam), 3)), atol=1e-6)
    two = np.array([[1.0, 0.5], [0.5, 2.0]])
    assert np.allclose(lasso.solve(two, 1, 0.1, floor=0.0, eps_abs=1e-10).sparse, np.linalg.inv([[1.1, 0.4], [0.4, 2.1]]), atol=1e-5)
    theta = synth.precision(3, 2, 0.5, 4)
    assert np.allclose(lasso.solve(np.linalg.inv(theta), 3, 0.0, floor=1e-9).theta, theta, atol=1e-2)


@pytest.mark.parametrize(("window", "n", "portion"), [(1, 10, 0.15), (5, 10, 0.0), (5, 10, 0.05), (5, 4, 0.4)])
def test_lasso_finds_block_toeplitz_networks(window, n, portion):
    """Sparse networks of ten sensors and five lags: positive definite, Toeplitz by blocks, nothing but true edges of weight."""
    true = synth.precision(window, n, portion, 9)
    found = lasso.solve(np.linalg.inv(true), window, 1e-4, rho=0.1, floor=0.0)
    z = found.sparse
    assert found.converged and np.linalg.eigvalsh(found.theta)[0] > 0 and np.allclose(z, z.T)
    for lag in range(window):
        blocks = [z[i * n : (i + 1) * n, (i + lag) * n : (i + lag + 1) * n] for i in range(window - lag)]
        assert all(np.allclose(b, blocks[0]) for b in blocks)
    assert np.allclose(z, true, atol=0.02) and not ((np.abs(z) > 0.05) & (true == 0)).any()
    assert ((np.abs(z) > 2e-5) | (true == 0)).all()


@pytest.mark.parametrize("mode", ["flat", "lag"])
def test_lasso_is_optimal(mode):
    """Optimality on groups: the mean gradient equals minus the signed penalty where an entry is not 0, else is within it."""
    r = np.random.default_rng(4)
    s = np.cov(r.normal(size=(9, 60)))
    lam = 0.08 if mode == "flat" else lasso.lag_scaled(0.05, 3, 3)
    found = lasso.solve(s, 3, lam, floor=0.0, eps_abs=1e-9, eps_rel=1e-9, most=5000)
    z = found.sparse
    assert found.converged and np.linalg.eigvalsh(found.theta)[0] > 0
    groups = lasso.toeplitz_groups(3, 3)
    assert np.allclose(z, z.T) and np.allclose(lasso.group_means(z, groups), z)
    slope = lasso.group_means(s - np.linalg.inv(found.theta), groups)
    limit = np.broadcast_to(lam, s.shape)
    on = z != 0
    assert np.allclose(slope[on], -(np.sign(z) * limit)[on], atol=1e-5)
    assert (np.abs(slope[~on]) <= limit[~on] + 1e-5).all()
    steps = lasso.solve(s, 3, lam, floor=0.0, eps_abs=1e-9, eps_rel=1e-9, most=5000, rho_update=lambda rho, p, d: rho * (2 if p > 10 * d else 0.5 if d > 10 * p else 1))
    assert np.allclose(steps.sparse, z, atol=1e-4)


@pytest.mark.parametrize("window", [1, 3])
def test_separate_sensors_are_solved_separately(window):
    """Planted networks that do not touch: the same solution as of all sensors at once."""
    r = np.random.default_rng(window)
    parts = [r.permutation(9)[:4], None]
    parts[1] = np.setdiff1d(np.arange(9), parts[0])
    x = np.zeros((4000, 9))
    for some in parts:
        x[:, some] = r.normal(size=(4000, len(some))) @ (np.eye(len(some)) + 0.5 * r.normal(size=(len(some), len(some))))
    stacked = windows.windows_of(x, window)
    s = np.cov(stacked.T)
    lam = 0.2
    sets = lasso.separate(s, window, lam)
    assert len(sets) > 1 and all(any(set(a) <= set(p) for p in parts) for a in sets) and sorted(np.concatenate(sets)) == list(range(9))
    whole, apart = (f(s, window, lam, eps_abs=1e-10, eps_rel=1e-10, floor=0.0, most=5000) for f in (lasso.solve, partial(lasso.solve_separately, wide=1)))
    assert np.allclose(whole.theta, apart.theta, atol=1e-6) and np.allclose(whole.sparse, apart.sparse, atol=1e-6) and ((whole.sparse != 0) == (apart.sparse != 0)).all()
    assert len(lasso.separate(s, window, 0.0)) == 1


def test_many_separate_sensors_at_once():
    """5,000 entries in pieces of four sensors."""
    r = np.random.default_rng(1)
    s = np.eye(5000) * 2
    for at in range(0, 5000, 4):
        some = r.normal(size=(4, 4)) * 0.3
        s[at : at + 4, at : at + 4] += some @ some.T
    got = lasso.solve_separately(s, 1, 1e-3, eps_abs=1e-5, eps_rel=1e-5)
    own = lasso.solve(s[:4, :4], 1, 1e-3, eps_abs=1e-5, eps_rel=1e-5)
    assert got.converged and np.allclose(got.theta[:4, :4], own.theta) and not got.theta[:4, 4:].any()


def test_packed_matrices(spark):
    m = np.arange(16.0).reshape(4, 4)
    m = m + m.T
    df = spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>")
    packed = df.select(arrays.pack_symmetric(F.col("m"), 4).alias("p"), arrays.frobenius(F.col("m")).alias("f"), arrays.threshold_mask(F.col("m"), 9.0).alias("mask"))
    row = packed.select("*", arrays.unpack_symmetric(F.col("p"), 4, 6.0).alias("u"), arrays.argmin(F.col("p")).alias("lo"), arrays.argmax(F.col("p")).alias("hi")).first()
    assert row["p"] == m[np.triu_indices(4)].tolist() and row["f"] == pytest.approx(np.linalg.norm(m))
    assert row["u"] == np.where(np.abs(m) < 6, 0, m).ravel().tolist() and row["mask"] == (np.abs(m) > 9).astype(int).ravel().tolist()
    assert (row["lo"], row["hi"]) == (0, 9)


def test_fit_finds_planted_regimes(spark):
    made = synth.synthetic_series(spark).persist()
    p = fitting.Parameters(window=5, clusters=2, lam=0.02, beta=40, most_rounds=12, init="given", chunk=100)
    start = made.where("t <= 595").select("series_id", "t", F.when((F.col("t") >= 150) & (F.col("t") < 330), 1).otherwise(0).alias("cluster"))
    found = fitting.fit(made.select("series_id", "t", "x"), 5, p, start, with_bic=True)
    c = metrics.confusion(found.assignments, metrics.stepped_truth(F.col("t"), (200, 400), (0, 1, 0)), 2)
    assert metrics.macro_f1(c, metrics.greedy_matching(c, 2)).first()[0] > 0.95
    assert found.converged and found.bic is not None
    assert found.model.edges(spark, sensor=1).where("dst <> 1").isEmpty()


def test_a_short_series_is_not_spread_thin(spark, monkeypatch):
    """Passes over what a fit holds cost as many tasks as its partitions: no more than its chunks ask for, whatever a shuffle is told."""
    seen, packed = [], windows.packed
    monkeypatch.setattr(windows, "packed", lambda *a: seen.append(packed(*a)) or seen[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        x = np.random.default_rng(5).normal(size=(60, 2))
        fitting.fit(series(spark, x), 2, fitting.Parameters(window=2, clusters=2, lam=0.1, beta=1.0, init="random", most_rounds=1))
        assert seen[0].rdd.getNumPartitions() <= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_model_round_trip_and_guards(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(60, 2))
    penalty = tuple(map(tuple, lasso.lag_scaled(0.1, 2, 2).tolist()))
    p = fitting.Parameters(window=2, clusters=2, lam_mode="matrix", penalty=penalty, beta=1.0, init="random", most_rounds=2)
    found = fitting.fit(series(spark, x), 2, p)
    found.model.save(spark, str(tmp_path / "model"))
    again = fitting.Model.load(spark, str(tmp_path / "model"))
    assert again.parameters == p and again.sensors == 2
    by_lag = fitting.fit(series(spark, x), 2, fitting.Parameters(window=2, clusters=2, lam=0.1, lam_mode="lag_scaled", beta=1.0, init="random", most_rounds=2))
    assert rows(by_lag.assignments.toPandas()) == rows(found.assignments.toPandas())
    stepped = fitting.Parameters(window=2, clusters=2, lam_mode="matrix", penalty=penalty, beta=1.0, init="random", most_rounds=2, rho_update=lambda rho, p, d: rho * (2 if p > 10 * d else 0.5 if d > 10 * p else 1))
    assert rows(fitting.fit(series(spark, x), 2, stepped).assignments.toPandas()) == rows(found.assignments.toPandas())
    s = windows.stack(series(spark, x), 2, 2)
    assert rows(again.predict(s).toPandas()) == rows(found.model.predict(s).toPandas())
    with pytest.raises(TypeError):
        found.model.predict(s.select("t"))
    for bad in ({"most_rounds": 0}, {"beta": -1.0}, {"window": 0}, {"lam_mode": "matrix"}, {"lam_mode": "other"}):
        with pytest.raises(ValueError):
            fitting.Parameters(**bad)
    with pytest.raises(ValueError, match="in sensor 1"):
        fitting.fit(series(spark, x).withColumn("x", F.when(F.col("t") == 7, F.array(F.lit(1.0), F.lit(None).cast("double"))).otherwise(F.col("x"))), 2, p)
    with pytest.raises(ValueError, match="3 sensors"):
        fitting.fit(series(spark, x), 3, p)
    with pytest.raises(Exception, match="gaps or repeats"):
        fitting.fit(series(spark, x).where("t <> 5"), 2, p)
    assert fitting.Parameters(window=10).rows(50) == 16_777 and fitting.Parameters(window=2).rows(5) == 100_000
    empty = fitting.Parameters(window=1, clusters=3, init="given", most_rounds=1)
    with pytest.raises(ValueError, match="no windows"):
        fitting.fit(series(spark, x), 2, empty, series(spark, x).select("series_id", "t", F.lit(0).alias("cluster")))


@pytest.mark.parametrize("empty", [[2], [2, 3], [2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]])
def test_repair_gives_each_empty_cluster_a_run_of_its_own(spark, empty):
    """One donor, several, and more empty clusters than donors: every one gets rows, in disjoint runs that start at its donor's rows."""
    donors, run = [k for k in (0, 1) if k not in empty], 7
    assigned = spark.range(400).select(F.lit("0").alias("series_id"), F.col("id").alias("t"), (F.col("id") % 2 if 1 in donors else F.lit(0)).cast("int").alias("cluster"))
    before = {r["t"]: r["cluster"] for r in assigned.collect()}
    for turn in (1, 2, 3):
        p = fitting.Parameters(clusters=7, reassign=run)
        model = fitting.Model(p, 1, {k: {"cluster": k, "sigma": [float(k + 1)], "mean": [0.0]} for k in range(7)})
        stacked = assigned.select("series_id", "t", F.array(F.col("t").cast("double")).alias("x"))
        got = fitting.repair(assigned, model, empty, p, turn, stacked=stacked).toPandas()
        assert len(got) == 400
        order = sorted(donors, reverse=True)  # the larger norm first
        for nth, k in enumerate(empty):
            t = sorted(got[got.cluster == k].t)
            assert t == list(range(t[0], min(t[0] + run, 400))) and before[t[0]] == order[nth % len(order)]
            assert model.rows[k]["sigma"] == [float(order[nth % len(order)] + 1)] and model.rows[k]["mean"] == [float(t[-1])]
        moved = set(got[got.cluster.isin(empty)].t)
        assert all(before[t] == c for t, c in zip(got.t, got.cluster, strict=True) if t not in moved)


def test_repair_of_tiny_donors():
    """Too few rows for disjoint runs: each empty cluster still starts at a row of its own, as long as there are any."""
    at = {0: [("0", t) for t in (3, 1, 2)]}
    got = fitting.starts([1, 2, 3, 4], [0] * 4, at, 20)
    assert got == {1: ("0", 3), 2: ("0", 1), 3: ("0", 2)}


def test_members_are_the_smallest_draws(spark):
    assigned = spark.range(3000).select(F.lit("0").alias("series_id"), F.col("id").alias("t"), (F.col("id") % 3).cast("int").alias("cluster")).withColumn("draw", ordering.drawn(5))
    want = {k: [("0", r["t"]) for r in assigned.where(f"cluster = {k}").orderBy("draw").limit(50).collect()] for k in (0, 2)}
    assert fitting.members(assigned.drop("draw"), {0: 1000, 2: 1000}, 50, 5) == want
    assert len(fitting.members(assigned.drop("draw"), {1: 1000}, 5000, 5)[1]) == 1000


@pytest.mark.parametrize("init", ["kmeans", "gmm", "random"])
def test_starts(spark, init):
    x = np.concatenate([np.random.default_rng(6).normal(m, 0.1, (40, 2)) for m in (0, 5)])
    got = fitting.initial(windows.stack(series(spark, x), 1, 2), fitting.Parameters(window=1, clusters=2, init=init)).toPandas()
    assert len(got) == 80 and set(got.cluster) == {0, 1}


def test_stream_is_the_forward_recursion(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(40, 2))
    p = fitting.Parameters(window=2, clusters=2, lam=0.1, beta=0.5, init="random", most_rounds=1)
    model = fitting.fit(series(spark, x), 2, p).model
    source = series(spark, x)
    for k, part in enumerate((source.where("t < 15"), source.where("t >= 15"), source.where("t = 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = score_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), model).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        assert k < 2 or spark.read.parquet(str(tmp_path / "out")).count() == 39  # the late row changes nothing
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").toPandas()
    costs = scoring.window_costs(np.array([x[i : i + 2].ravel() for i in range(39)]), *model.arrays())
    g, want = np.zeros(2), []
    for c in costs:
        g = c + np.minimum(g, g.min() + 0.5)
        want.append(int(g.argmin()))
    assert got.t.tolist() == list(range(39)) and got.cluster.tolist() == want


def plain_lagged(costs, beta, lag):
    """Labels ``lag`` windows later, each from the cheapest path up to there; the last ones from that of the end."""
    out = []
    for seen in range(len(costs)):
        path = sequential(costs[: seen + 1][::-1], beta)[::-1]
        out += [path[seen - lag]] if seen >= lag else []
    return out + sequential(costs[::-1], beta)[::-1][max(0, len(costs) - lag) :]


@pytest.mark.parametrize("lag", [0, 4, 100])
def test_lagged_labels_and_gaps(lag):
    r = np.random.default_rng(lag)
    x = r.normal(size=(60, 2))
    model = np.zeros((3, 4)), np.array([np.diag(r.uniform(0.5, 2, 4)) for _ in range(3)]), r.normal(size=3)
    times = [*range(25), *range(40, 75)]  # a jump: no window spans it
    path, out, costs, starts = Path(model, 0.6, 2, lag), [], [], []
    for k, t in enumerate(times):
        path = Path(model, 0.6, 2, lag, path.state())
        out += path.add(t, x[k])
        if k and times[k - 1] == t - 1:
            costs.append(scoring.window_costs(np.concatenate([x[k - 1], x[k]])[None, :], *model)[0])
            starts.append(t - 1)
    assert len(out) == max(0, len(costs) - lag)
    out += path.rest()
    assert out == list(zip(starts, plain_lagged(np.array(costs), 0.6, lag), strict=True))
    assert list(path.add(74, x[0])) == []


def test_an_idle_series_ends(spark, tmp_path):
    """The watermark moves with another series; then what the lag held back comes out and the state goes."""
    x = np.random.default_rng(8).normal(size=(40, 2))
    p = fitting.Parameters(window=2, clusters=2, lam=0.1, beta=0.5, init="random", most_rounds=1)
    model = fitting.fit(series(spark, x), 2, p).model
    timed = lambda s, first: s.withColumn("ts", F.timestamp_seconds(F.lit(first) + F.col("t")))
    parts = [timed(series(spark, x, "a"), 1_000), timed(series(spark, x[:5], "b"), 100_000), timed(series(spark, x[5:7], "b").withColumn("t", F.col("t") + 5), 200_000)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = score_stream(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), model, lag=6, time_col="ts", delay="10 seconds", idle_ms=60_000)
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("series_id = 'a'").orderBy("t").toPandas()
    costs = scoring.window_costs(np.array([x[i : i + 2].ravel() for i in range(39)]), *model.arrays())
    assert got.t.tolist() == list(range(39)) and got.cluster.tolist() == plain_lagged(costs, 0.5, 6)


def read_stream(spark, place, out):
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out")
    run.awaitTermination()
    return spark.read.parquet(f"{place}/out")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, resumable.ROCKS)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("lag", [0, 4])
def test_a_stream_goes_on_where_a_table_ends(spark, rocks, tmp_path, lag):
    """As if it had read the table too: a long history, one that the lag holds back whole, one shorter than a window, and none."""
    r = np.random.default_rng(11)
    p = fitting.Parameters(window=3, clusters=2, lam=0.1, beta=0.5, init="random", most_rounds=1)
    x = r.normal(size=(60, 2))
    model = fitting.fit(series(spark, x), 2, p).model
    known = {"long": 41, "held": 5, "short": 2, "new": 0}
    every = reduce(DataFrame.union, [series(spark, x + i / 9, name) for i, name in enumerate(known)])
    past = every.where(" OR ".join(f"(series_id = '{name}' AND t < {n})" for name, n in known.items()))
    start = resumable.handover(past, model, lag, chunk=7)
    for k, part in enumerate((every.subtract(past).where("t < 50"), every.where("t >= 50"), every.where("t = 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
        out = read_stream(spark, tmp_path, resumable.label_stream(source, model, lag, start=start))
        assert k < 2 or out.groupBy("series_id", "t").count().where("count > 1").isEmpty()
    for i, (name, n) in enumerate(known.items()):
        path = Path(model.arrays(), 0.5, 3, lag)
        before = path.add_all({t: (x + i / 9)[t] for t in range(n)})
        want = path.add_all({t: (x + i / 9)[t] for t in range(n, 60)})
        got = out.where(F.col("series_id") == name).orderBy("t").toPandas()
        assert list(zip(got.t, got.cluster, strict=True)) == want and len(before) + len(want) == 58 - lag, name


def test_a_timer_ends_an_idle_series(spark, rocks, tmp_path):
    x = np.random.default_rng(8).normal(size=(40, 2))
    p = fitting.Parameters(window=2, clusters=2, lam=0.1, beta=0.5, init="random", most_rounds=1)
    model = fitting.fit(series(spark, x), 2, p).model
    timed = lambda s, first: s.withColumn("ts", F.timestamp_seconds(F.lit(first) + F.col("t")))
    for part in (timed(series(spark, x, "a"), 1_000), timed(series(spark, x[:5], "b"), 100_000), timed(series(spark, x[5:7], "b").withColumn("t", F.col("t") + 5), 200_000)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        out = read_stream(spark, tmp_path, resumable.label_stream(source, model, 6, "ts", "10 seconds", 60_000))
    got = out.where("series_id = 'a'").orderBy("t").toPandas()
    costs = scoring.window_costs(np.array([x[i : i + 2].ravel() for i in range(39)]), *model.arrays())
    assert got.t.tolist() == list(range(39)) and got.cluster.tolist() == plain_lagged(costs, 0.5, 6)
    with pytest.raises(ValueError, match="timers"):
        resumable.label_stream(source, model, 6, "ts", ttl_ms=1)


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# head\n1.5,2\n3,4\n\n5,6e1\n")
    got = readers.read_matrix_csv(spark, str(tmp_path / "m.csv")).orderBy("t").collect()
    assert [(r["t"], r["x"]) for r in got] == [(0, [1.5, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 60.0])]
    (tmp_path / "t.tsv").write_text("a\tb\tc\n1\t\t3\n4\t5\t6\n")
    table = readers.read_table(spark, str(tmp_path / "t.tsv"), [2, 1])
    assert [tuple(r) for r in table.select("t", "s0", "s1").orderBy("t").collect()] == [(0, 3.0, None), (1, 6.0, 5.0)]
    assert [tuple(r) for r in readers.as_series(table, ["s0", "s1"]).orderBy("t").collect()] == [("0", 0, [3.0, None]), ("0", 1, [6.0, 5.0])]
    with pytest.raises(Exception, match="does not hold"):
        readers.pivoted(spark.range(5), F.col("id"), F.lit("a"), F.lit(1.0), ("a",), 4).collect()
    (tmp_path / "e.txt").write_text("# graph\n1 2\n2 1\n3  2\n")
    nodes, edges = readers.read_edge_list(spark, str(tmp_path / "e.txt"))
    assert sorted(r["id"] for r in nodes.collect()) == [1, 2, 3] and sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3)]
    long = spark.createDataFrame([(0, i, j, float(i * 2 + j)) for i in range(2) for j in range(2)], "cluster int, i int, j int, v double")
    exports.write_matrix(long, str(tmp_path / "out"))
    assert [r["v"] for r in readers.read_matrix(spark, str(tmp_path / "out" / "cluster=0")).orderBy("i", "j").collect()] == [0.0, 1.0, 2.0, 3.0]
    labels = spark.createDataFrame([("0", t, t % 2) for t in range(4)], "series_id string, t bigint, cluster int")
    exports.write_labels(labels, str(tmp_path / "labels"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "labels")).collect()] == ["0", "1", "0", "1"]
    exports.write_series(series(spark, [[1, 2.5]]), str(tmp_path / "series"))
    assert spark.read.text(str(tmp_path / "series")).first()["value"] == "1.0000,2.5000"
    assert readers.random_series(spark, 10, 3).where("size(x) = 3 AND x[0] < 1000").count() == 10


def test_series_cover_their_tables(spark, tmp_path):
    from tidemark import queries

    def sums(x):
        return x.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas().v.tolist()

    days = queries.daily(spark, DATA)
    items = spark.read.parquet(f"{DATA}/lineitem.parquet")
    first, last, quantity = items.agg(F.min("l_shipdate"), F.max("l_shipdate"), F.sum("l_quantity")).first()
    assert sum(sums(days)) == pytest.approx(float(quantity)) and days.count() == (last - first).days + 1
    assert days.where("t = 0 AND aggregate(x, 0D, (a, v) -> a + v) > 0").count() == 1

    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert queries.hourly(spark, DATA).count() == queries.HOURS
    for hours in (24 * 60, -24 * 60):  # some later, and some earlier, than January
        moved = events.withColumn("ts", F.when(F.col("event_type") == "view", F.expr(f"ts + make_interval(0, 0, 0, 0, {hours})")).otherwise(F.col("ts")))
        place = str(tmp_path / f"at{hours}")
        moved.write.parquet(f"{place}/events.parquet")
        assert sum(sums(queries.hourly(spark, place))) == pytest.approx(events.agg(F.sum("value")).first()[0], abs=1.0)
        assert queries.hourly(spark, place).count() > queries.HOURS


def test_generator():
    p = synth.precision(3, 4, 0.3, 1)
    assert np.allclose(p, p.T) and np.linalg.eigvalsh(p)[0] > 0.09
    assert np.allclose(p[:4, :4], p[4:8, 4:8]) and np.allclose(p[4:8, :4], p[8:, 4:8])
    x = np.array([synth.sample([p], 3, 4, [0], [3], k).ravel() for k in range(3000)])
    assert np.allclose(np.cov(x.T), np.linalg.inv(p), atol=0.4)


def test_generated_rows_do_not_depend_on_chunks(spark):
    made = lambda chunk: {(r["series_id"], r["t"]): (r["x"], r["truth"]) for r in synth.synthetic_series(spark, 2, 4, 3, 0.3, (0, 1, 0), (50, 90, 130), chunk).collect()}
    one = made(1000)
    assert len(one) == 260 and [one["1", t][1] for t in (0, 49, 50, 89, 90, 129)] == [0, 0, 1, 1, 0, 0]
    for chunk in (1, 7, 50):
        other = made(chunk)
        assert other.keys() == one.keys() and all(np.allclose(other[k][0], one[k][0], atol=1e-9) and other[k][1] == one[k][1] for k in one)
    assert not np.allclose(one["0", 5][0], one["1", 5][0])


def test_noises_are_normal_wherever_they_begin():
    x = synth.noises(5, 1, 0, 40_000, 3)
    assert np.array_equal(x[1234:1300], synth.noises(5, 1, 1234, 66, 3))
    assert np.allclose(np.cov(x.T), np.eye(3), atol=0.03) and np.allclose(x.mean(0), 0, atol=0.02) and abs((x**4).mean() - 3) < 0.15
    assert abs(np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1]) < 0.02


def test_queries_agree_with_their_sql(spark, duck):
    from tidemark.oracles import ORACLES
    from tidemark.queries import QUERIES

    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(sql).df()
        assert rows(got) == rows(want), name
        kinds = lambda d: {c: d[c].dtype.kind for c in d}  # noqa: B023, E731
        assert kinds(got) == kinds(want) or len(got) == 0, name


@pytest.mark.parametrize(("step", "least"), [(7921, 0), (7925, 1)])
def test_rounds_agree_with_sql_where_a_cluster_runs_out_of_windows(spark, tmp_path, step, least):
    """Events at other times: after the first round a cluster has no window, or one, which has no covariance."""
    import duckdb

    from tidemark import queries
    from tidemark.oracles import ORACLES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT event_id, event_type, value, to_timestamp(1704067200 + (event_id * {step} * 1013) % 2592000)::TIMESTAMP AS ts FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    first = con.execute(ORACLES["fit_dense_round"]).df().cluster.value_counts()
    assert min(first.get(k, 0) for k in range(queries.K)) == least
    assert rows(queries.fit_three_rounds(spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLES["fit_three_rounds"]).df())


def test_dropped_clusters_take_no_window(spark):
    """Not even at the end of the series, where windows cost nothing."""
    x = np.random.default_rng(6).normal(size=(30, 2))
    p = fitting.Parameters(window=3, clusters=4, init="given", lam=0.1, beta=0.0, empty="drop", most_rounds=2)
    found = fitting.fit(series(spark, x), 2, p, series(spark, x).where("t < 28").select("series_id", "t", (F.col("t") % 2 * 2 + 1).alias("cluster")))
    assert set(found.assignments.toPandas().cluster) == {1, 3} == set(found.model.rows)
    with pytest.raises(ValueError, match="repair or drop"):
        fitting.Parameters(empty="keep")


def test_other_queries_run(spark):
    from tidemark import queries
    from tidemark.oracles import ORACLES
    from tidemark.queries import QUERIES

    for name in QUERIES.keys() - ORACLES.keys():
        got = QUERIES[name](spark, DATA).toPandas()
        assert len(got) > 0, name
        if name.startswith("fit_"):
            assert got.converged.nunique() == 1 and got.rounds.max() <= queries.FIT_ROUNDS and got.groupby("t").size().max() == 1 and set(got.cluster) == set(range(got.cluster.max() + 1)), name


def test_a_fit_ends_where_its_own_labels_give_them_again(spark):
    """At the end the labels are the cheapest path of the networks that they themselves give."""
    data = synth.synthetic_series(spark).select("series_id", "t", "x").persist()
    p = fitting.Parameters(window=3, clusters=2, lam=0.02, beta=40, most_rounds=15, init="given", chunk=100)
    start = data.where("t <= 597").select("series_id", "t", F.when((F.col("t") >= 150) & (F.col("t") < 330), 1).otherwise(0).alias("cluster"))
    found = fitting.fit(data, 5, p, start)
    s = windows.stack(data, p.window, 5).toPandas().sort_values("t")
    label = found.assignments.toPandas().sort_values("t").cluster.to_numpy()
    x, k = np.stack(s.x), range(p.clusters)
    solved = [lasso.solve(np.cov(x[label == c].T), p.window, p.lam) for c in k]
    costs = scoring.window_costs(x, np.array([x[label == c].mean(0) for c in k]), np.array([f.theta for f in solved]), np.array([-np.linalg.slogdet(f.theta)[1] for f in solved]))
    costs[~s.full.to_numpy(bool)] = 0.0
    assert found.converged and sequential(costs, p.beta) == label.tolist()


def test_a_mixture_finds_its_components(spark):
    r = np.random.default_rng(6)
    parts = [(r.normal(m, s, (n, 2))) for m, s, n in ((0, 1.0, 300), (9, 0.5, 200), (-9, 2.0, 100))]
    table = series(spark, np.concatenate(parts)).repartition(3)
    model = mixtures.fitted(table, 3, seed=5)
    got = mixtures.assigned(model, table).toPandas().sort_values("t").cluster.to_numpy()
    names = [set(got[a:b]) for a, b in ((0, 300), (300, 500), (500, 600))]
    assert all(len(n) == 1 for n in names) and len(set.union(*names)) == 3
    for row in mixtures.networks(model, spark).collect():
        own = np.concatenate(parts)[got == row["cluster"]]
        assert np.allclose(np.reshape(row["theta"], (2, 2)), np.linalg.inv(np.cov(own.T, ddof=0)), rtol=0.05, atol=0.02)
    assert sorted(np.round(model.weights * 600)) == [100, 200, 300]


def test_rounds_of_a_mixture_are_the_plain_ones(spark):
    """Responsibilities, moments and likelihood against plain formulas; the likelihood never falls."""
    x = np.random.default_rng(8).normal(size=(90, 3)) * [1, 2, 3]
    table, floor = series(spark, x).repartition(4), np.full(3, 1e-9)
    now = mixtures.Mixture(np.array([0.3, 0.7]), x[:2], np.array([np.eye(3), 2 * np.eye(3)]))
    last = -np.inf
    for _ in range(4):
        dens = np.stack([w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(now.weights, now.means, now.covs, strict=True)], 1)
        share = dens / dens.sum(1, keepdims=True)
        after = mixtures._round(table, {0: now}, 2, floor)[0]
        assert np.allclose(after.weights, share.mean(0)) and np.isclose(after.log_likelihood, np.log(dens.sum(1)).mean()) and after.log_likelihood >= last
        for k in range(2):
            mean = share[:, k] @ x / share[:, k].sum()
            assert np.allclose(after.means[k], mean) and np.allclose(after.covs[k], (share[:, k, None] * (x - mean)).T @ (x - mean) / share[:, k].sum() + 1e-9 * np.eye(3))
        now, last = after, after.log_likelihood
    with pytest.raises(ValueError, match="no windows"):
        mixtures.fitted(table.limit(0), 2)


def test_uncapped_exports(spark):
    labels = spark.range(39_000, 41_000).select(F.lit("0").alias("series_id"), F.col("id").alias("t"), F.lit(1).alias("cluster"))
    assert exports.colours(labels, ("red", "blue")).count() == 200 and exports.colours(labels, ("red", "blue"), most=40_000).count() == 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert isinstance(entry.entry(spark).toPandas(), pd.DataFrame)

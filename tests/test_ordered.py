"""Chunked scans against plain loops, with chunks far smaller than the series."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators import ordered, scaling, scores
from tidegauge.operators.quantiles import _refined_quantiles, exact_quantiles

N = 230


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    return {k: np.round(rng.normal(0, 1, n), 3) for k, n in (("a", N), ("b", 37), ("c", 1))}


@pytest.fixture(scope="module")
def rows(spark, series):
    data = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rng = np.random.default_rng(5)
    return spark.createDataFrame([data[i] for i in rng.permutation(len(data))], "k string, t long, x double")


def by_key(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], {})[r["t"]] = r[column]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("size", [7, 1000])
def test_prefix_sum_and_fill(rows, series, size):
    got = by_key(ordered.prefix_sum(rows, ["k"], {"s": F.col("x")}, size=size), "s")
    holes = rows.withColumn("h", F.when(F.col("t") % 11 == 5, F.col("x")))
    ahead = by_key(ordered.fill(holes, ["k"], {"f": "h"}, size=size), "f")
    back = by_key(ordered.fill(holes, ["k"], {"f": "h"}, backward=True, size=size), "f")
    for k, x in series.items():
        assert np.allclose(got[k], np.cumsum(x))
        marked = [v if i % 11 == 5 else None for i, v in enumerate(x)]
        last, want = None, []
        for v in marked:
            last = v if v is not None else last
            want.append(last)
        assert ahead[k] == want
        last, want = None, []
        for v in reversed(marked):
            last = v if v is not None else last
            want.append(last)
        assert back[k] == want[::-1]


@pytest.mark.parametrize("size", [7, 1000])
def test_reflected_sum(rows, series, size):
    got = by_key(ordered.reflected_sum(rows, ["k"], {"s": F.col("x") - 0.1}, size=size), "s")
    for k, x in series.items():
        s, want = 0.0, []
        for v in x:
            s = max(0.0, s + v - 0.1)
            want.append(s)
        assert np.allclose(got[k], want)


@pytest.mark.parametrize("rho", [0.0, 0.05, 0.8, 0.999, 1.0])
def test_geometric_scan(rows, series, rho, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 16)
    got = by_key(ordered.geometric_scan(rows, ["k"], {"s": F.col("x")}, rho), "s")
    for k, x in series.items():
        s, want = 0.0, []
        for v in x:
            s = rho * s + v
            want.append(s)
        assert np.allclose(got[k], want)


@pytest.mark.parametrize("size", [5, 1000])
def test_reset_scan_equals_the_sequential_one(rows, series, size):
    marked = rows.withColumns({"m": F.lit(0.0), "w": F.lit(-0.05), "h": F.lit(1.5)})
    out = scores.cusum_reset(marked, ["k"], "x", "m", "w", "h", size=size)
    got = by_key(out, "stat_before")
    for k, x in series.items():
        s, want = 0.0, []
        for v in x:
            s = max(0.0, s + v + 0.05)
            want.append(s)
            s = 0.0 if s > 1.5 else s
        assert np.allclose(got[k], want)


def test_slow_states_still_converge(spark):
    """Adaptive levels hardly forget; every chunk must be redone until the chain is exact."""
    x = np.round(np.random.default_rng(1).normal(0, 1, 60), 3)
    rows = spark.createDataFrame([("a", i, float(v), 0.0, 1.0, 9.0, 0.01) for i, v in enumerate(x)], "k string, t long, x double, m double, s double, g double, a double")
    got = by_key(scores.adaptive_cusum(rows, ["k"], "x", "m", "s", "g", "a", size=6), "mu")["a"]
    mu, want = 0.0, []
    for v in x:
        mu += 0.01 * (v - mu)
        want.append(mu)
    assert np.allclose(got, want, atol=0, rtol=1e-13)


def test_lag_windows_and_runs_cross_chunks(rows, series, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 8)
    lag = by_key(ordered.with_lag(rows, ["k"], {"p": ("x", 3)}), "p")
    lists = by_key(ordered.trailing_lists(rows, ["k"], 5, {"l": "x"}), "l")
    runs = by_key(ordered.with_runs(rows, ["k"], F.col("x") > -1.0), "run_start")
    for k, x in series.items():
        assert lag[k] == [None] * min(3, len(x)) + list(x[:-3])
        assert lists[k] == [list(x[max(0, i - 4) : i + 1]) for i in range(len(x))]
        start, want = None, []
        for i, v in enumerate(x):
            start = None if v <= -1.0 else (i if start is None else start)
            want.append(start)
        assert runs[k] == want


def test_index_and_rank(spark):
    rows = spark.createDataFrame(
        [("a", f"2024-01-0{d} 00:0{m}:00.{i:06d}", d * 100 + m * 10 + i) for d in (3, 1, 2) for m in (2, 1) for i in (5, 3, 4)],
        "k string, s string, at long",
    ).withColumn("ts", F.col("s").cast("timestamp"))
    for out in (ordered.with_index(rows, ["k"], "ts"), ordered.with_rank(rows, ["k"], ["at"])):
        assert [r["t"] for r in sorted(out.collect(), key=lambda r: r["at"])] == list(range(18))


def test_index_of_one_hot_key(spark):
    """One key with nearly all rows is split over partitions and still numbered densely."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("v")
    )
    out = ordered.with_rank(rows, ["k"], ["v"]).filter("k = -1")
    assert out.agg(F.max("t")).first()[0] == out.count() - 1
    assert out.select("t").distinct().count() == out.count()


def test_refined_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {
        "mixed": np.concatenate([rng.normal(0, 5, 900), np.zeros(600), [1e-300, -1e300, 7.0]]),
        "ties": np.repeat([1.0, 2.0, 2.0000001], 200),
        "one": np.array([4.5]),
    }
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    for found in (_refined_quantiles(rows, ["g"], "v", qs, "p"), exact_quantiles(rows, ["g"], "v", qs, "p")):
        got = {(r["g"], r["q"]): r["p"] for r in found.collect()}
        for g, x in groups.items():
            for q in qs:
                assert got[g, q] == pytest.approx(float(np.quantile(x, q)), rel=1e-12, abs=1e-300)


def test_result_does_not_depend_on_partitions(spark, rows):
    want = sorted(map(tuple, scores.ewma_score(rows, ["k"], ["x"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = sorted(map(tuple, scores.ewma_score(rows.repartition(5), ["k"], ["x"]).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want


def test_interpolation(spark):
    values = [None, 1.0, None, None, 4.0, None]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t long, x double")
    assert by_key(scaling.interpolate_linear(rows, ["k"], ["x"]), "x")["a"] == [1, 1, 2, 3, 4, 4]
    assert by_key(scaling.fill_both_ways(rows, ["k"], ["x"]), "x")["a"] == [1, 1, 1, 1, 4, 4]


def test_a_state_that_is_never_forgotten_takes_three_passes(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(2, 500)).cumsum(axis=1)
    data = [(k, t, float(x[k, t])) for k in range(2) for t in range(500 if k == 0 else 90)]
    df = spark.createDataFrame(data, "k int, t long, x double").repartition(3)

    def step(columns, state):
        level, out = (state or [0.0])[0], []
        for v in columns["x"].tolist():
            level += 0.01 * (v - level)
            out.append(level)
        return {"level": np.array(out)}, [level]

    calls = []
    inner = ordered._run_sorted
    monkeypatch.setattr(ordered, "_run_sorted", lambda *a: calls.append(1) or inner(*a))
    out = ordered.feedback_scan(df, ["k"], step, [T.StructField("level", T.DoubleType())], size=10)
    got = {(r["k"], r["t"]): r["level"] for r in out.collect()}
    assert len(calls) == 3 and len(got) == out.count() == 590
    for k, n in ((0, 500), (1, 90)):
        want, _ = step({"x": x[k, :n]}, None)
        assert np.allclose([got[k, t] for t in range(n)], want["level"], atol=1e-12)

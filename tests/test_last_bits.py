"""Comparisons that rounding decides: short decimals often equal a threshold."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import injection, scaling, scores
from tidegauge.operators.quantiles import _refined_quantiles, exact_quantiles


def groups(spark, seed=5, count=400):
    rng = np.random.default_rng(seed)
    data = [(g, t, float(v)) for g in range(count) for t, v in enumerate(np.round(rng.exponential(50, rng.integers(1, 40)), 2))]
    return data, spark.createDataFrame(data, "g long, t long, v double").repartition(4)


def twin(data, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE rows (g BIGINT, t BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO rows VALUES (?, ?, ?)", data)
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("find", [exact_quantiles, _refined_quantiles])
def test_quantiles_equal_the_twin_to_the_last_bit(spark, find):
    data, rows = groups(spark)
    found = {(r["g"], r["q"]): r["p"] for r in find(rows, ["g"], "v", [1 / 3, 0.9], "p").collect()}
    want = twin(data, "SELECT g, quantile_cont(v, 1.0 / 3), quantile_cont(v, 0.9) FROM rows GROUP BY g")
    assert {(g, q): p for g, *ps in want for q, p in zip((1 / 3, 0.9), ps)} == found


def test_quantiles_of_infinite_and_equal_values(spark):
    inf = math.inf
    rows = spark.createDataFrame([(0, inf), (0, inf), (1, -inf), (1, 3.0), (2, 0.1), (2, 0.1), (3, None), (4, 1e300), (4, 1e300)], "g int, v double")
    found = exact_quantiles(rows.filter("g <> 1 OR v > 0"), ["g"], "v", [0.5, 0.75], "p").filter("q = 0.75")
    got = {r["g"]: r["p"] for r in found.collect()}
    assert got[0] == inf and got[1] == 3.0 and got[2] == pytest.approx(0.1, rel=1e-15) and got[4] == pytest.approx(1e300, rel=1e-15)


def test_regimes_on_a_cutoff(spark):
    """A step that equals its cutoff but for the last bit falls where the twin puts it."""
    data, rows = groups(spark, 11, 3000)
    cut = injection.regime_cutoffs(rows, ["g"], "v")
    got = {r["g"]: (r["q1"], r["q2"]) for r in cut.filter("q1 IS NOT NULL").collect()}
    want = twin(data, """SELECT g, quantile_cont(d, 1.0 / 3), quantile_cont(d, 2.0 / 3) FROM (
        SELECT g, abs(v - lag(v) OVER (PARTITION BY g ORDER BY t)) AS d FROM rows) GROUP BY g HAVING count(d) > 0""")
    assert got == {g: (a, b) for g, a, b in want}


def test_reset_scan_adds_row_by_row():
    """Alarms of a statistic that equals its limit."""
    rng = np.random.default_rng(3)
    for columns in (1, 3):
        drift = np.round(rng.exponential(50, (60_000, columns)), 2) - 50.0 - 10.0
        before, largest, end = scores.reset_scan(drift, np.full(len(drift), 80.0), np.zeros(columns))
        s, want = [0.0] * columns, []
        for row in drift.tolist():
            s = [max(0.0, a + x) for a, x in zip(s, row)]
            want.append(s)
            if max(s) > 80.0:
                s = [0.0] * columns
        assert before.tolist() == want and largest.tolist() == [max(w) for w in want] and end.tolist() == s


def test_moments_in_order_equal_the_twin_to_the_last_bit(spark):
    data, rows = groups(spark)
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, None)], "g long, t long, v double"))
    got = {r["g"]: (r["mean_v"], r["std_v"]) for r in scaling.fit_in_order(rows, ["g"], "v", 40).collect()}
    want = {g: (m, s) for g, m, s in twin(data, "SELECT g, avg(v), stddev_pop(v) FROM (FROM rows ORDER BY g, t) GROUP BY g")}
    assert got.pop(-1) == (None, None)
    assert got == want
    far = scaling.fit_in_order(rows, ["g"], "v", 10**6).filter(F.col("g") >= 0)
    for r in far.collect():
        assert (r["mean_v"], r["std_v"]) == pytest.approx(want[r["g"]])

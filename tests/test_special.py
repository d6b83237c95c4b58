"""Distribution functions against closed forms and fine sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import special
from tidegauge.operators import modelling, scores

POINTS = [-1e4, -30.0, -7.5, -2.0, -1.0, -0.3, -1e-6, 0.0, 0.02, 0.7, 1.3, 3.0, 9.0, 25.0, 1e3]


def values(spark, fn, shape):
    rows = spark.createDataFrame([(p, shape) for p in POINTS], "x double, shape double")
    return {r[0]: r[1] for r in rows.select("x", fn(F.col("x"), F.col("shape"))).collect()}


@pytest.mark.parametrize(
    "degrees,closed",
    [
        (1.0, lambda t: 0.5 + math.atan(t) / math.pi),
        (2.0, lambda t: 0.5 + t / (2 * math.sqrt(2 + t * t))),
        (4.0, lambda t: 0.5 + 0.375 * t / math.sqrt(1 + t * t / 4) * (1 - t * t / (1 + t * t / 4) / 12)),
    ],
)
def test_student_t(spark, degrees, closed):
    for t, value in values(spark, special.student_t_cdf, degrees).items():
        assert value == pytest.approx(closed(t), abs=2e-9)


@pytest.mark.parametrize("degrees", [0.3, 37.0, 250.0, 299.0, 301.0, 5_000.0])
def test_student_t_against_a_fine_sum(spark, degrees):
    got = values(spark, special.student_t_cdf, degrees)
    level = math.exp(math.lgamma((degrees + 1) / 2) - math.lgamma(degrees / 2)) / math.sqrt(degrees * math.pi)
    for t in (0.02, 0.7, 1.3, 3.0, 9.0):
        grid = (np.arange(200_000) + 0.5) * t / 200_000
        mass = (level * (1 + grid * grid / degrees) ** (-(degrees + 1) / 2)).sum() * t / 200_000
        assert got[t] == pytest.approx(0.5 + mass, abs=2e-7)


@pytest.mark.parametrize(
    "shape,upper",
    [
        (1.0, lambda z: math.exp(-z)),
        (2.0, lambda z: math.erfc(z)),
        (0.5, lambda z: (1 + math.sqrt(z)) * math.exp(-math.sqrt(z))),
        (0.25, lambda z: sum(z ** (k / 4) / math.factorial(k) for k in range(4)) * math.exp(-(z**0.25))),
    ],
)
def test_generalised_error(spark, shape, upper):
    for z, value in values(spark, special.generalised_error_cdf, shape).items():
        side = 0.5 * upper(abs(z))
        assert value == pytest.approx(side if z < 0 else 1 - side, abs=2e-9)


def test_the_fitting_family_has_the_least_distance(spark):
    rng = np.random.default_rng(5)
    rows = [("t", float(x)) for x in rng.standard_t(3, 3_000)] + [("n", float(x)) for x in rng.normal(2, 3, 3_000)]
    df = spark.createDataFrame(rows, "g string, x double")
    fits = modelling.fit_gaussian(df, ["g"], "x").withColumns({"family": F.lit("gaussian"), "shape": F.lit(None).cast("double")})
    shaped = fits.withColumns({"family": F.lit("student_t"), "loc": F.lit(0.0), "scale": F.lit(1.0), "shape": F.lit(3.0)})
    got = {(r["g"], r["family"]): r for r in modelling.ks_fitted(df, fits.unionByName(shaped), ["g"], "x").collect()}
    assert got["t", "student_t"]["ks_stat"] < got["t", "gaussian"]["ks_stat"] and got["t", "student_t"]["ks_pvalue"] > 0.01
    assert got["n", "gaussian"]["ks_pvalue"] > 0.01 > got["n", "student_t"]["ks_pvalue"]


@pytest.mark.parametrize("held", [0, 256])
def test_axes_of_many_keys(spark, monkeypatch, held):
    monkeypatch.setattr(scores, "HELD_GRAMS", held)
    rng = np.random.default_rng(6)
    x = {k: rng.normal(size=(50, 3)) * [1, 2 + k, 4] for k in range(5)}
    df = spark.createDataFrame([(k, *map(float, row)) for k in x for row in x[k]], "k int, a double, b double, c double").repartition(4)
    for r in scores.keyed_axes(df, ["k"], ["a", "b", "c"], 2).collect():
        vectors = np.linalg.eigh(x[r["k"]].T @ x[r["k"]])[1][:, ::-1][:, :2].T
        assert np.allclose(np.abs(r["axes"]), np.abs(vectors), atol=1e-9)

"""Special functions as column expressions."""

from __future__ import annotations

import math

import numpy as np
from numpy.polynomial import chebyshev
from pyspark.sql import Column
from pyspark.sql import functions as F

REACH = 6.0  # beyond, the complement is below one rounding step


def _complement_polynomial(degree: int = 26) -> list[float]:
    """``exp(z * z) * erfc(z)`` on ``[0, REACH]`` as a polynomial in the mapped ``2 / (2 + z)``.

    Interpolated in Chebyshev points, where its coefficients fall off geometrically.
    """
    low = 2.0 / (2.0 + REACH)
    nodes = np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    z = 2.0 / ((nodes + 1.0) / 2.0 * (1.0 - low) + low) - 2.0
    values = [math.exp(x * x) * math.erfc(x) for x in z]
    return chebyshev.cheb2poly(chebyshev.chebfit(nodes, values, degree)).tolist()


COMPLEMENT = _complement_polynomial()


def erf(x: Column) -> Column:
    """Error function, to about 1e-14."""
    z = F.least(F.abs(x), F.lit(REACH))
    low = 2.0 / (2.0 + REACH)
    y = (2.0 / (2.0 + z) - low) / (1.0 - low) * 2.0 - 1.0
    poly = F.lit(0.0)
    for c in reversed(COMPLEMENT):
        poly = poly * y + c
    return F.signum(x) * (1.0 - poly * F.exp(-z * z))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def sql_normal_cdf(z: str, terms: int = 160) -> str:
    """Another form for comparison: the series of positive terms around zero."""
    square = f"least(({z}) * ({z}), 64.0)"
    series = f"list_reduce(list_transform(range({terms}, 0, -1), lambda k_: k_::DOUBLE), lambda sum_, k_: 1.0 + sum_ * {square} / (2.0 * k_ + 1.0), 1.0::DOUBLE)"
    half = f"sqrt({square}) * exp(-{square} / 2.0) / sqrt(2.0 * pi()) * {series}"
    return f"(0.5 + sign({z}) * least(0.5, {half}))"


def lgamma(x: Column) -> Column:
    """Log gamma for positive arguments: Stirling's series after a shift by eight."""
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    y = x + 8.0
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2.0 * math.pi) + series - F.ln(product)


def _series(ratio, terms: int) -> Column:
    """``1 + r(1) + r(1) r(2) + ...``, summed over a fixed number of terms."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * ratio(k.cast("double"))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda s: s["sum"])


GAMMA_REACH, GAMMA_TERMS = 60.0, 220
MOST_DEGREES, BETA_TERMS = 300.0, 420


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function for ``0 < a <= 20``, by its power series.

    Beyond ``GAMMA_REACH`` the function is one to the last digits.
    """
    near = F.least(x, F.lit(GAMMA_REACH))
    total = _series(lambda k: near / (a + k), GAMMA_TERMS)
    value = F.exp(a * F.ln(near) - near - lgamma(a + 1.0)) * total
    return F.when(x <= 0, 0.0).otherwise(F.least(F.lit(1.0), value))


def student_t_cdf(t: Column, degrees: Column) -> Column:
    """Distribution function of Student's t.

    Half the regularised incomplete beta function of ``y = t^2 / (v + t^2)``, by its power series
    in ``y`` or in ``1 - y``, whichever is smaller; above ``MOST_DEGREES`` by a normal
    deviate that agrees to eight digits.
    """
    few = F.least(degrees, F.lit(MOST_DEGREES))
    y = t * t / (few + t * t)
    rest = few / (few + t * t)
    a = few / 2.0
    level = lgamma(a + 0.5) - lgamma(a) - 0.5 * math.log(math.pi)
    both = F.exp(a * F.ln(rest) + 0.5 * F.ln(y) + level)
    inner = both / 0.5 * _series(lambda k: y * (a - 0.5 + k) / (0.5 + k), BETA_TERMS)
    outer = 1.0 - both / a * _series(lambda k: rest * (a - 0.5 + k) / (a + k), BETA_TERMS // 4)
    within = F.when(t == 0, 0.0).when(y <= 0.5, inner).otherwise(outer)
    far = (8.0 * degrees + 1.0) / (8.0 * degrees + 3.0) * F.sqrt(degrees * F.log1p(t * t / degrees))
    return F.when(degrees > MOST_DEGREES, normal_cdf(F.signum(t) * far)).otherwise(0.5 + 0.5 * F.signum(t) * within)


def generalised_error_cdf(z: Column, shape: Column) -> Column:
    """Distribution function of the density proportional to ``exp(-|z|^shape)``."""
    return 0.5 + 0.5 * F.signum(z) * gamma_p(1.0 / shape, F.pow(F.abs(z), shape))

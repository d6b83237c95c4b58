"""Disturbance waveforms as column expressions over the local index ``i``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family names and their aliases.
FAMILIES = [
    "step", "ramp", "drift", "pulse", "periodic", "trapezoid", "sigmoidal", "chirp", "brownian", "ou",
]
ALIASES = {
    "sinusoid": "periodic",
    "sigmoid": "sigmoidal",
    "random_walk": "brownian",
    "ornstein_uhlenbeck": "ou",
}
RANDOM_FAMILIES = ["brownian", "ou"]


def canonical_family(family: Column) -> Column:
    """Canonical name of a family or alias, null when unknown."""
    clean = F.lower(F.trim(family))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    name = F.coalesce(F.try_element_at(alias, clean), clean)
    return F.when(name.isin(FAMILIES), name)


def parameter(params: Column, name: str, default: Column | float | None) -> Column:
    value = F.try_element_at(params, F.lit(name))
    if default is None:
        return value
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(float(default)))


def _logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(100.0)), F.lit(-100.0))))


def waveform(family: Column, i: Column, duration: Column, amplitude: Column, params: Column) -> Column:
    """Value of a deterministic waveform at local index ``i`` of ``duration`` rows."""
    i, d = i.cast("double"), duration.cast("double")
    share = F.when(d == 1, F.lit(1.0)).otherwise(i / (d - 1))
    rate = parameter(params, "rate", None)
    width = F.floor(parameter(params, "pulse_width", d))
    period, phase = parameter(params, "period", 24.0), parameter(params, "phase", 0.0)
    u1, u2 = parameter(params, "u1", 0.2), parameter(params, "u2", 0.8)
    plateau = (
        F.when(d == 1, 1.0)
        .when(share < u1, F.when(u1 > 0, share / u1).otherwise(1.0))
        .when(share < u2, 1.0)
        .otherwise(F.when(u2 < 1.0, (1.0 - share) / (1.0 - u2)).otherwise(1.0))
    )
    k = parameter(params, "k", 10.0 / F.greatest(F.lit(1.0), d - 1))
    middle = parameter(params, "t0", (d - 1) / 2.0)
    here, low, high = _logistic(k * (i - middle)), _logistic(-k * middle), _logistic(k * (d - 1 - middle))
    curve = F.when(d == 1, 1.0).when(high > low, (here - low) / (high - low)).otherwise(here)
    f0, f1 = parameter(params, "f0", 0.01), parameter(params, "f1", 0.1)
    sweep = 2.0 * math.pi * (f0 + (f1 - f0) / (2.0 * F.greatest(F.lit(1.0), d)) * i) * i
    return (
        F.when(family == "step", amplitude)
        .when(family == "ramp", amplitude * share)
        .when(family == "drift", F.coalesce(rate * i, amplitude * share))
        .when(family == "pulse", F.when(i < F.least(d, F.greatest(width, F.lit(0))), amplitude).otherwise(0.0))
        .when(family == "periodic", amplitude * F.sin(2.0 * math.pi * i / period + phase))
        .when(family == "trapezoid", amplitude * plateau)
        .when(family == "sigmoidal", amplitude * curve)
        .when(family == "chirp", amplitude * F.sin(sweep))
    )

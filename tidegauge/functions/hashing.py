"""Reproducible random numbers from hashes, independent of partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = 13  # hex digits per uniform, 52 bits


def _digest(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def _unit(digest: Column, start: int) -> Column:
    number = F.conv(F.substring(digest, start, _HEX), 16, 10).cast("long").cast("double")
    return (number + 0.5) / F.lit(float(1 << 4 * _HEX))


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in (0, 1) determined by ``parts``."""
    return _unit(_digest(*parts), 1)


def gaussian(*parts: Column | str | int) -> Column:
    """Standard normal determined by ``parts`` (Box-Muller on two halves of one hash)."""
    digest = _digest(*parts)
    u, v = _unit(digest, 1), _unit(digest, 1 + _HEX)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def uniform_int(low: Column | int, high: Column | int, *parts: Column | str | int) -> Column:
    """Uniform integer in ``[low, high)``."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(*parts) * (high - low))).cast("long")


def seeded_digest(seed: int, context: Column, candidate: Column) -> Column:
    """``sha256("seed:context:candidate")`` as hex, the key of seeded rankings."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), context, candidate.cast("string")), 256)


def sql_uniform(text: str, start: int = 1) -> str:
    return f"((('0x' || substr(md5({text}), {start}, {_HEX}))::BIGINT + 0.5) / {float(1 << 4 * _HEX)!r})"


def sql_gaussian(text: str) -> str:
    return (
        f"(sqrt(-2.0 * ln({sql_uniform(text)})) * cos(2.0 * pi() * {sql_uniform(text, 1 + _HEX)}))"
    )

"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equal statement over the same tables."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Results are put on a decimal grid whose borders no short decimal or binary
# fraction hits, so that a last-digit difference of two engines cannot decide.
SHIFT = 0.1863


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Value on the grid of ``digits`` decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.rint(c * scale - SHIFT) / scale + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


def sql_round(expr: str, digits: int = 6) -> str:
    scale = f"{float(10**digits)!r}::DOUBLE"
    return f"(round(({expr})::DOUBLE * {scale} - {SHIFT}) / {scale} + 0.0)"

"""Estimators for ``recovery.run_suite``, over declared intervals or whole blocks.

Attacked rows hold the whole block of every scenario and a clean ``prediction``. A declared
estimator knows the interval and returns its rows alone; an undeclared one returns all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import recovery
from tidegauge.operators.recovery import SCENARIO, Estimator


def inside(reach: int = 0) -> Column:
    """Rows of the declared interval and ``reach`` rows on both sides."""
    return (F.col("t") >= F.col("onset") - reach) & (F.col("t") < F.col("offset") + reach)


def lag_estimator(clean: DataFrame, lag: int, declared: bool = True) -> Estimator:
    """Persistence (lag 1) or seasonal repetition; ``clean`` has history at negative ``t``.

    The uncertainty is the deviation of the lag differences in the history.
    """
    history = clean.filter("t < 0")
    first = history.groupBy("series_id").agg(F.min("t").alias("_first"))
    indexed = history.join(first, "series_id").withColumn("t", F.col("t") - F.col("_first"))
    noise = recovery.lag_variance(indexed, ["series_id"], "value", lag).select("series_id", F.sqrt("variance").alias("unc"))

    def estimate(df: DataFrame) -> DataFrame:
        if declared:
            found = recovery.persistence_declared(df.filter(inside()), clean.select("series_id", "t", "value"), lag)
            return found.join(noise, "series_id")
        near = clean.filter((F.col("t") < 0) & (F.col("t") >= -lag)).select("series_id", "t", F.col("value").alias("y"))
        past = df.select(*SCENARIO).distinct().join(near, "series_id").select(*SCENARIO, "t", "y")
        found = recovery.persistence_undeclared(df.select(*SCENARIO, "t", "y").unionByName(past), SCENARIO, lag)
        return df.join(found.drop("y"), [*SCENARIO, "t"]).join(noise, "series_id")

    return estimate


def prediction_estimator(unc: float, declared: bool = True) -> Estimator:
    """Residual against ``prediction``, for companion ridge or any other forecast."""

    def estimate(df: DataFrame) -> DataFrame:
        rows = df.filter(inside()) if declared else df
        return recovery.recover_from_prediction(rows).withColumn("unc", F.lit(unc))

    return estimate


def sparse_estimator(
    terms: Sequence[tuple], x_min: Column, x_max: Column, unc: float, declared: bool = True, scale: Column | None = None,
    facts: Sequence[str] | None = None, **options,
) -> Estimator:
    """Step or multi-order recovery of the residual against ``prediction``.

    Off the interval a declared disturbance is zero, so only the rows that a difference
    over its border reaches take part. ``scale`` divides the series while it is solved. ``facts``
    are the columns that all rows of a scenario share; with them named, the other columns go through
    the solver and rows are not joined with its solutions. That is for declared intervals,
    whole blocks would make large arrays.
    """
    reach = max(order for order, *_ in terms)
    unit = F.lit(1.0) if scale is None else scale

    def estimate(df: DataFrame) -> DataFrame:
        near = df.filter(inside(reach)) if declared else df
        rows = recovery.solver_rows(near, "prediction", x_min, x_max, inside() if declared else None)
        rows = rows.withColumns({c: F.col(c) / unit for c in ("r", "low", "high")})
        if facts is None:
            found = recovery.recover_whole(rows, SCENARIO, terms, **options)
            # Spark takes the cells of solutions for as few as the solutions and would broadcast them
            out = near.join(found.select(*SCENARIO, "t", "delta_hat", "gap").hint("merge"), [*SCENARIO, "t"])
        else:
            carry = [c for c in near.columns if c not in (*SCENARIO, *facts, "t")]
            found = recovery.recover_whole(rows, [*SCENARIO, *facts], terms, carry=carry, **options)
            out = found.select(*near.columns, "delta_hat", "gap")
        out = out.withColumn("delta_hat", F.col("delta_hat") * unit)
        out = out.withColumn("x_hat", F.col("y") - F.col("delta_hat")).withColumn("unc", F.lit(unc))
        return out.filter(inside()) if declared else out

    return estimate

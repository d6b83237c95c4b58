"""Suite estimators against direct computation on small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries

from tidegauge.operators import metrics, recovery, solver, suites
from tidegauge.plans.registry import QUERIES
from tidegauge.session import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def attacked(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, (onset, offset, amplitude) in enumerate([(0, 12, 2.0), (20, 32, -1.5), (50, 60, 3.0), (59, 60, 1.0)]):
        x = rng.normal(5, 0.3, 60)
        for t in range(60):
            delta = amplitude if onset <= t < offset else 0.0
            rows.append(("s", f"c{k}", t, x[t], x[t] + delta, delta, 5.0, onset, offset, amplitude, 0.3, 60))
    names = "series_id scenario_id t x y delta prediction onset offset amplitude train_std n".split()
    return spark.createDataFrame(pd.DataFrame(rows, columns=names))


@pytest.mark.parametrize("terms", [solver.step_terms(1.0, 0.05), solver.trend_terms(0.05, 0.5, 1.0)])
def test_declared_rows_alone_give_the_solution_of_the_whole_block(attacked, terms):
    options = {"tol": 1e-11, "max_iter": 50_000}
    box = (F.lit(3.0), F.lit(9.0))
    sparse = suites.sparse_estimator(terms, *box, 0.1, True, **options)(attacked)
    whole = recovery.solver_rows(attacked, "prediction", *box, suites.inside())
    want = solver.recover_whole(whole, suites.SCENARIO, terms, **options).withColumnRenamed("delta_hat", "want")
    both = sparse.join(want.select(*suites.SCENARIO, "t", "want"), [*suites.SCENARIO, "t"]).toPandas()
    assert len(both) == 12 + 12 + 10 + 1 and np.abs(both["delta_hat"] - both["want"]).max() < 1e-6


def test_undeclared_estimators_return_every_row(attacked):
    clean = attacked.filter("scenario_id = 'c0'").select("series_id", (F.col("t") - 30).alias("t"), F.col("x").alias("value"))
    for estimate in (suites.lag_estimator(clean, 5, False), suites.prediction_estimator(0.2, False)):
        found = estimate(attacked)
        assert found.count() == 240 and found.filter("abs(x_hat + delta_hat - y) > 1e-12 OR x_hat IS NULL").count() == 0
    lagged = {(r["scenario_id"], r["t"]): r for r in suites.lag_estimator(clean, 5, False)(attacked).collect()}
    for (k, t), r in lagged.items():
        if t >= 5:
            assert r["x_hat"] == lagged[k, t - 5]["y"]


def test_the_suite_has_four_estimators(spark):
    rows = QUERIES["estimator_suite"](spark, SF).filter("grouping = 'overall'").collect()
    median = {r["estimator"]: r["median_delta_nrmse"] for r in rows}
    assert set(median) == {"persistence", "seasonal", "companion_ridge", "step_recovery"}
    assert median["step_recovery"] < median["companion_ridge"]
    both = {r["estimator"]: r for r in QUERIES["declared_undeclared_steps"](spark, SF).collect()}
    assert all(r["median_support_f1_declared"] >= r["median_support_f1_undeclared"] for r in both.values())


def test_trend_against_tv_by_family(spark):
    rows = QUERIES["trend_vs_tv"](spark, SF).collect()
    assert {r["family"] for r in rows} == {"step", "ramp", "periodic", "trapezoid"}
    assert all(r["base_nrmse"] > 0 and r["better_nrmse"] > 0 for r in rows)


@pytest.mark.parametrize("terms", [solver.step_terms(1.0, 0.05), solver.trend_terms(0.05, 0.5, 1.0)])
def test_rows_that_go_through_the_solver_are_those_of_a_join(attacked, terms):
    box = (F.lit(3.0), F.lit(9.0))
    facts = ["onset", "offset", "amplitude", "train_std", "n"]
    joined = suites.sparse_estimator(terms, *box, 0.1, True, F.col("train_std"))(attacked)
    through = suites.sparse_estimator(terms, *box, 0.1, True, F.col("train_std"), facts)(attacked)
    assert joined.columns == through.columns
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, through.collect()))
    assert "Join" not in through._jdf.queryExecution().executedPlan().toString()


def test_trend_against_tv_writes_rows_near_the_intervals_and_joins_no_solutions(spark, monkeypatch):
    """Whole series of every scenario were written and sorted, and the solutions broadcast or sorted."""
    from tidegauge.plans import suites as plans

    written = {}
    kept = lambda df, name: written.setdefault(name, df) if name == "results" else written.setdefault(name, staged(df, name))
    monkeypatch.setattr(plans, "staged", kept)
    QUERIES["trend_vs_tv"](spark, SF)
    near = next(df for name, df in written.items() if name != "results")
    spans = near.groupBy(*suites.SCENARIO).agg(F.count(F.lit(1)).alias("k"), F.max("onset").alias("onset"), F.min("t").alias("first"))
    assert spans.filter("k > 14 OR first <> greatest(0, onset - 2)").count() == 0
    plan = written["results"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") >= 2


def test_a_peak_known_beforehand_scores_as_the_one_of_the_rows(spark, attacked):
    found = attacked.withColumns({"delta_hat": F.col("delta") * 0.9 + 0.01, "x_hat": F.col("x") + 0.1, "unc": F.lit(0.2)})
    found = found.withColumn("delta", F.when(F.col("delta") != 0, F.col("delta") * (1 + (F.col("t") - F.col("onset")) / 5)).otherwise(0.0))
    largest = found.groupBy(*suites.SCENARIO).agg(F.max(F.abs("delta")).alias("top"))
    known = found.join(largest, suites.SCENARIO).withColumn("peak", F.greatest(F.abs("amplitude"), F.col("top"), F.lit(1e-6)))
    want = metrics.scenario_metrics(found, suites.SCENARIO, F.col("train_std"), peak=True)
    got = metrics.scenario_metrics(known, suites.SCENARIO, F.col("train_std"), F.col("peak"))
    for a, b in zip(sorted(want.collect()), sorted(got.collect()), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])

"""The benchmark suite with companions: four estimators, declared and undeclared support, families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import injection, linear, metrics, recovery, solver, suites
from tidegauge.plans.injecting import cells, series_scenarios
from tidegauge.plans.recovering import PAIR, RIDGE_SQL, SCORE_COLUMNS, SCORE_SQL, SUMMARY_COLUMNS, panel_ridge
from tidegauge.plans.registry import query, rounded, sql_round
from tidegauge.plans.scoring import PANEL_Z_SQL, fitted
from tidegauge.session import staged

TRAIN = 360  # hours of the panel before the block
AMPLITUDES, DURATIONS, EVERY = (0.5, 1.0, 2.0), (12, 24, 48), 24
EXTRA = ["amplitude_std", "duration", "regime"]
FACTS = [*EXTRA, "sign", "onset", "offset", "amplitude", "n", "train_std", "lo", "hi"]  # of a scenario
TARGET = "click"

GRID_SQL = f"""blk AS (SELECT t - {TRAIN} AS t, {TARGET} AS value, w0 + w1 * view + w2 * error AS prediction, sqrt(greatest(rv, 0)) AS ridge_unc FROM filled, ridge),
len AS (SELECT max(t) + 1 AS m, stddev_samp(value) FILTER (WHERE t < 0) AS sd FROM blk),
grid AS (SELECT 'panel' AS series_id, concat_ws('-', onset, duration, amplitude_std, sgn) AS scenario_id, onset, onset + duration AS offset_, duration,
    amplitude_std, sgn * amplitude_std * sd AS amplitude, m, sd, CASE WHEN onset * 2 < m THEN 'early' ELSE 'late' END AS regime
  FROM len, (SELECT unnest({list(AMPLITUDES)})::DOUBLE AS amplitude_std), (SELECT unnest({list(DURATIONS)}) AS duration), (SELECT unnest([1, -1]) AS sgn),
    (SELECT unnest(range(0, (SELECT max(t) + 1 FROM blk), {EVERY})) AS onset) WHERE onset + duration < m),
att AS (SELECT g.*, b.t, b.value AS x, b.prediction, b.ridge_unc, b.t >= onset AND b.t < offset_ AS inside,
    CASE WHEN b.t >= onset AND b.t < offset_ THEN amplitude ELSE 0 END AS delta FROM grid g JOIN blk b ON b.t >= 0),
noise AS (SELECT sqrt(var_pop(d1)) AS u1, sqrt(var_pop(d5)) AS u5 FROM (
  SELECT value - lag(value) OVER (ORDER BY t) AS d1, value - lag(value, 5) OVER (ORDER BY t) AS d5 FROM blk WHERE t < 0))"""

_DECLARED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS estimator, a.*, b.value AS x_hat, a.x + a.delta - b.value AS delta_hat, u{lag} AS unc FROM att a "
    f"JOIN blk b ON b.t = a.onset - {lag} + (a.t - a.onset) % {lag}, noise WHERE a.inside"
    for name, lag in (("persistence", 1), ("seasonal", 5))
) + " UNION ALL SELECT 'companion_ridge', a.*, prediction, x + delta - prediction, ridge_unc FROM att a WHERE inside"
_UNDECLARED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS estimator, a.*, a.x + a.delta - b.value - CASE WHEN b.t >= a.onset AND b.t < a.offset_ THEN a.amplitude ELSE 0 END AS delta_hat "
    f"FROM att a JOIN blk b ON b.t = a.t - {lag}"
    for name, lag in (("persistence", 1), ("seasonal", 5))
) + " UNION ALL SELECT 'companion_ridge', a.*, x + delta - prediction FROM att a"


def panel_attacks(spark, sf_dir):
    """Step scenarios on one sensor of the panel, whole blocks, with the ridge's prediction."""
    filled, model = panel_ridge(spark, sf_dir)
    rows = linear.ridge_predict(filled, model).select(
        "series_id", (F.col("t") - TRAIN).alias("t"), F.col(TARGET).alias("value"), "prediction"
    )
    rows = staged(rows, "panel-block")
    facts = rows.groupBy("series_id").agg(
        (F.max("t") + 1).alias("n"), F.stddev_samp(F.when(F.col("t") < 0, F.col("value"))).alias("train_std"),
        F.min(F.when(F.col("t") < 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("t") < 0, F.col("value"))).alias("hi"),
    )
    options = {"amplitude_std": AMPLITUDES, "duration": DURATIONS, "sign": (1, -1)}
    grid = facts
    for name, values in options.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    grid = grid.withColumn("onset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EVERY).cast("long"))))
    grid = grid.filter("onset + duration < n").withColumns(
        {
            "scenario_id": F.concat_ws("-", "onset", "duration", "amplitude_std", "sign"),
            "offset": F.col("onset") + F.col("duration"),
            "amplitude": F.col("sign") * F.col("amplitude_std") * F.col("train_std"),
            "regime": F.when(F.col("onset") * 2 < F.col("n"), "early").otherwise("late"),
        }
    )
    block = rows.filter("t >= 0").withColumnRenamed("value", "x")
    attacked = grid.join(block, "series_id").withColumn("delta", F.when(suites.inside(), F.col("amplitude")).otherwise(0.0))
    return staged(attacked.withColumn("y", F.col("x") + F.col("delta")), "panel-attacks"), rows, model


def estimators(rows, model, declared=True, with_step=True):
    """The four estimators of the suite by name."""
    unc = max(model["residual_variance"], 0.0) ** 0.5
    found = {
        "persistence": suites.lag_estimator(rows, 1, declared),
        "seasonal": suites.lag_estimator(rows, 5, declared),
        "companion_ridge": suites.prediction_estimator(unc, declared),
    }
    if with_step:
        box = (F.col("lo") - 3 * F.col("train_std"), F.col("hi") + 3 * F.col("train_std"))
        found["step_recovery"] = suites.sparse_estimator(
            solver.step_terms(1.0, 0.05), *box, unc, declared, F.col("train_std"), FACTS if declared else None, watch_box=True, least_iter=7
        )
    return found


@query(
    "companion_suite",
    f"WITH {PANEL_Z_SQL}, {RIDGE_SQL}, {GRID_SQL}, est AS ({_DECLARED_SQL}), {SCORE_SQL} SELECT estimator, series_id, scenario_id, "
    + ", ".join(f"{sql_round(c)} AS {c}" for c in SCORE_COLUMNS)
    + " FROM sm",
)
def companion_suite(spark, sf_dir):
    """Persistence, seasonal repetition and companion ridge on every scenario."""
    attacked, rows, model = panel_attacks(spark, sf_dir)
    out = recovery.run_suite(attacked, estimators(rows, model, with_step=False), extra=EXTRA)
    return rounded(out.select("estimator", *PAIR, *SCORE_COLUMNS), *SCORE_COLUMNS)


@query("estimator_suite")
def estimator_suite(spark, sf_dir):
    """All four estimators, summarised overall and by amplitude, duration and regime."""
    attacked, rows, model = panel_attacks(spark, sf_dir)
    results = recovery.run_suite(attacked, estimators(rows, model), extra=EXTRA)
    return rounded(metrics.benchmark_summary(staged(results, "suite")), *SUMMARY_COLUMNS)


@query(
    "declared_undeclared",
    f"""WITH {PANEL_Z_SQL}, {RIDGE_SQL}, {GRID_SQL}, est AS ({_DECLARED_SQL}), {SCORE_SQL},
    d AS (SELECT estimator, quantile_cont(delta_nrmse, 0.5) AS nrmse, quantile_cont(support_f1, 0.5) AS f1 FROM sm GROUP BY estimator),
    open_ AS ({_UNDECLARED_SQL}),
    cnt AS (SELECT estimator, scenario_id, sqrt(avg((delta_hat - delta) * (delta_hat - delta)) FILTER (WHERE inside)) / abs(any_value(amplitude)) AS nrmse,
      count(*) FILTER (WHERE abs(delta_hat) > 0.1 * abs(amplitude) AND inside) AS tp, count(*) FILTER (WHERE abs(delta_hat) > 0.1 * abs(amplitude)) AS found,
      count(*) FILTER (WHERE inside) AS cells FROM open_ GROUP BY estimator, scenario_id),
    u AS (SELECT estimator, quantile_cont(nrmse, 0.5) AS nrmse, quantile_cont(2.0 * tp / (found + cells), 0.5) AS f1 FROM cnt GROUP BY estimator)
    SELECT estimator, {sql_round('d.nrmse')} AS median_delta_nrmse_declared, {sql_round('u.nrmse')} AS median_delta_nrmse_undeclared,
      {sql_round('d.f1')} AS median_support_f1_declared, {sql_round('u.f1')} AS median_support_f1_undeclared FROM u LEFT JOIN d USING (estimator)""",
)
def declared_undeclared(spark, sf_dir):
    """What knowing the interval is worth, by estimator."""
    out = _both_supports(spark, sf_dir, with_step=False)
    return rounded(out, *(c for c in out.columns if c != "estimator"))


@query("declared_undeclared_steps")
def declared_undeclared_steps(spark, sf_dir):
    """The same with step recovery among the estimators."""
    out = _both_supports(spark, sf_dir, with_step=True)
    return rounded(out, *(c for c in out.columns if c != "estimator"), digits=4)


def _both_supports(spark, sf_dir, with_step):
    attacked, rows, model = panel_attacks(spark, sf_dir)
    summaries = []
    for declared in (True, False):
        results = recovery.run_suite(attacked, estimators(rows, model, declared, with_step), extra=EXTRA)
        summaries.append(metrics.benchmark_summary(staged(results, "suite")).filter("grouping = 'overall'"))
    return metrics.compare_runs(*summaries, ["median_delta_nrmse", "median_support_f1"])


@query("trend_vs_tv")
def trend_vs_tv(spark, sf_dir):
    """Error of multi-order against total-variation recovery, by family of the disturbance."""
    rows = cells(spark, sf_dir)
    scen = series_scenarios(rows, ["step", "ramp", "periodic", "trapezoid"], 10)
    fit = fitted(spark, sf_dir).groupBy("series_id").agg(
        F.max("mean_value").alias("prediction"), F.max("std_value").alias("train_std"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.max("n").alias("n"),
    )
    peak = F.greatest(F.abs("amplitude"), injection.fixed_peak(F.col("n")), F.lit(1e-6))
    scen = scen.join(fit, "series_id").withColumns({"offset": F.col("onset") + F.col("duration"), "peak": peak})
    facts = ["family", "onset", "offset", "amplitude", "peak", "prediction", "train_std", "lo", "hi"]
    whole = injection.inject_whole(rows, scen, random=False, keep=facts).withColumnRenamed("value", "x")
    orders = {"tv": solver.step_terms(1.0, 0.05), "trend": solver.trend_terms(0.05, 0.2, 1.0)}
    reach = max(order for terms in orders.values() for order, *_ in terms)
    near = whole.filter(suites.inside(reach)).drop("sensor", "support")  # estimators with a declared interval see no others
    near = staged(near, "near")
    box = (F.col("lo") - 3 * F.col("train_std"), F.col("hi") + 3 * F.col("train_std"))
    parts = [
        suites.sparse_estimator(terms, *box, 0.0, True, F.col("train_std"), facts)(near).withColumn("estimator", F.lit(name))
        for name, terms in orders.items()
    ]
    results = metrics.scenario_metrics(parts[0].unionByName(parts[1]), ["estimator", "family", *PAIR], F.col("train_std"), F.col("peak"))
    out = metrics.family_reduction(staged(results, "results"), "tv", "trend")
    return rounded(out, "base_nrmse", "better_nrmse", "reduction_percent", digits=3)

"""Queries on recovery estimators, scenario scoring and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import injection, linear, metrics, recovery, scaling, scores, solver
from tidegauge.operators.ordered import with_lag, with_rank
from tidegauge.plans.injecting import (
    DURATIONS,
    STEPS_SQL,
    STRATIFIED_SQL,
    WAVE_SQL,
    cells,
    scaled_scenarios,
    scenarios_sql,
    series_scenarios,
    stratified,
)
from tidegauge.plans.registry import query, rnd, rounded, sql_round
from tidegauge.plans.scoring import FIT_SQL, PANEL_Z_SQL, fitted, panel_z
from tidegauge.session import staged
from tidegauge.sources import views
from tidegauge.sources.views import PANEL_SENSORS, PANEL_SQL, SERIES_SQL, SUPPLIER_SQL

KEY = ["series_id"]
PAIR = ["series_id", "scenario_id"]
UNITS = ["delta_hat", "x_hat", "unc"]


def block(spark, sf_dir):
    """Second half of every series from ``t = 0``; the first half is history at negative ``t``."""
    half = F.floor(F.col("n") / 2)
    rows = views.split_series(spark, sf_dir)
    return rows.select(
        "series_id", (F.col("t") - half).alias("t"), "value", (F.col("n") - half).alias("n"), "split"
    )


def _body(rows):
    """Rows of the block and, per series, the deviation of its history."""
    std = rows.filter("t < 0").groupBy("series_id").agg(F.stddev_samp("value").alias("train_std"))
    return rows.filter("t >= 0").select("series_id", "t", F.col("value").alias("x"), "n"), std


LAGS = (1, 5)


def attacked(spark, sf_dir, rows=None):
    """The attacked cells of every stratified step scenario, those of its interval alone.

    With the rows before the interval, and facts of the series: ``train_std``, the uncertainty
    ``unc_<lag>`` of each lag, and the range ``lo, hi`` of all its rows.
    """
    rows = block(spark, sf_dir) if rows is None else rows
    facts = rows.groupBy("series_id").agg(
        F.stddev_samp(F.when(F.col("t") < 0, F.col("value"))).alias("train_std"), F.max("n").alias("n"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    for lag in LAGS:
        facts = facts.join(noise(rows, lag).withColumnRenamed("unc", f"unc_{lag}"), "series_id")
    cells = recovery.interval_rows(stratified(spark, sf_dir), rows, max(LAGS), max(DURATIONS), facts)
    return cells.withColumn("delta", F.col("amplitude")).withColumn("y", F.col("x") + F.col("delta"))


def attacked_whole(spark, sf_dir, rows=None):
    """Every stratified step scenario on the whole block of its series."""
    rows = block(spark, sf_dir) if rows is None else rows
    grid = staged(stratified(spark, sf_dir), "grid")
    body, std = _body(rows)
    inside = (F.col("t") >= F.col("onset")) & (F.col("t") < F.col("offset"))
    joined = grid.join(std, "series_id").join(body, "series_id")
    return joined.withColumn("delta", F.when(inside, F.col("amplitude")).otherwise(0.0)).withColumn(
        "y", F.col("x") + F.col("delta")
    )


def inside_only(df):
    return df.filter((F.col("t") >= F.col("onset")) & (F.col("t") < F.col("offset")))


def noise(rows, lag):
    """Deviation of the lag differences in the history, ``unc`` per series."""
    history = rows.filter("t < 0").withColumn("t", F.col("t") + F.col("n"))
    return recovery.lag_variance(history, KEY, "value", lag).withColumn("unc", F.sqrt("variance")).drop("variance")


def persistence(rows, lag):
    """Declared persistence as an estimator over attacked rows in any order and partitioning."""
    clean = rows.select("series_id", "t", "value")
    unc = noise(rows, lag)

    def estimate(df):
        found = recovery.persistence_declared(inside_only(df), clean, lag)
        return found.join(unc, "series_id")

    return estimate


def repetition(lag):
    """The same over ``attacked``, whose cells carry what it needs."""

    def estimate(df):
        found = recovery.persistence_past(df, lag, F.col("first") + F.col("amplitude"))
        return found.withColumn("unc", F.col(f"unc_{lag}"))

    return estimate


ESTIMATORS = {"persistence": repetition(1), "seasonal": repetition(5)}
EXTRA = ["amplitude_std", "duration", "regime"]


# History rows run from -half to -1; n is the block length.
BLOCK_SQL = f"""{STRATIFIED_SQL},
clean AS (SELECT series_id, t - n // 2 AS t, value, n - n // 2 AS m FROM series),
att AS (SELECT g.*, c.t, c.value AS x, c.m, tstd.sd, CASE WHEN c.t >= onset AND c.t < offset_ THEN g.amplitude ELSE 0 END AS delta
  FROM grid g JOIN clean c ON c.series_id = g.series_id AND c.t >= 0 JOIN tstd ON tstd.series_id = g.series_id)"""


def persistence_sql(lag: int, name: str) -> str:
    return f"""noise_{name} AS (SELECT series_id, sqrt(coalesce(var_pop(d), 0)) AS unc FROM (
  SELECT series_id, value - lag(value, {lag}) OVER (PARTITION BY series_id ORDER BY t) AS d FROM clean WHERE t < 0) GROUP BY series_id),
{name} AS (SELECT a.*, b.value AS x_hat, a.x + a.delta - b.value AS delta_hat, v.unc FROM att a
  JOIN clean b ON b.series_id = a.series_id AND b.t = a.onset - {lag} + (a.t - a.onset) % {lag}
  JOIN noise_{name} v ON v.series_id = a.series_id WHERE a.t >= a.onset AND a.t < a.offset_)"""


def _register_persistence(name: str, lag: int) -> None:
    sql = f"""WITH {SERIES_SQL}, {BLOCK_SQL}, {persistence_sql(lag, 'est')}
    SELECT series_id, scenario_id, t, {sql_round('x_hat')} AS x_hat, {sql_round('delta_hat')} AS delta_hat, {sql_round('unc')} AS unc FROM est"""

    @query(name, sql)
    def run(spark, sf_dir):
        out = repetition(lag)(attacked(spark, sf_dir))
        return rounded(out.select(*PAIR, "t", *UNITS), *UNITS)


_register_persistence("persistence_recovery", 1)
_register_persistence("seasonal_recovery", 5)


@query(
    "undeclared_persistence",
    f"""WITH {SERIES_SQL}, {BLOCK_SQL}, full_ AS (
      SELECT series_id, scenario_id, t, x + delta AS y FROM att
      UNION ALL SELECT g.series_id, g.scenario_id, c.t, c.value FROM grid g JOIN clean c ON c.series_id = g.series_id AND c.t < 0),
    lagged AS (SELECT *, lag(y, 2) OVER (PARTITION BY scenario_id, series_id ORDER BY t) AS p FROM full_)
    SELECT series_id, scenario_id, t, {sql_round('p')} AS x_hat, {sql_round('y - p')} AS delta_hat FROM lagged WHERE t >= 0""",
)
def undeclared_persistence(spark, sf_dir):
    rows = block(spark, sf_dir)
    hits = attacked_whole(spark, sf_dir, rows)
    past = hits.select(*PAIR).distinct().join(rows.filter("t < 0 AND t >= -2"), "series_id")
    whole = hits.select(*PAIR, "t", "y").unionByName(past.select(*PAIR, "t", F.col("value").alias("y")))
    out = recovery.persistence_undeclared(whole, PAIR, 2)
    return rounded(out.select(*PAIR, "t", "x_hat", "delta_hat"), "x_hat", "delta_hat")


# Ridge of click on (view, error) with two companions, solved in closed form.
RIDGE_SQL = """
mom AS (SELECT count(*) AS n, avg(view) AS m1, avg(error) AS m2, avg(click) AS my, stddev_pop(view) AS s1, stddev_pop(error) AS s2,
  covar_pop(view, error) AS c12, covar_pop(view, click) AS c1y, covar_pop(error, click) AS c2y, var_pop(click) AS vy
  FROM filled WHERE split = 'train'),
sys AS (SELECT *, n + 1.0 AS a, n * c12 / (s1 * s2) AS b, n * c1y / s1 AS p, n * c2y / s2 AS q FROM mom),
sol AS (SELECT *, (p * a - b * q) / (a * a - b * b) / s1 AS w1, (q * a - b * p) / (a * a - b * b) / s2 AS w2 FROM sys),
ridge AS (SELECT *, my - m1 * w1 - m2 * w2 AS w0,
  vy - 2 * (w1 * c1y + w2 * c2y) + w1 * w1 * s1 * s1 + w2 * w2 * s2 * s2 + 2 * w1 * w2 * c12 AS rv FROM sol)"""


def panel_ridge(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    filled, _ = scaling.prepare_features(panel, panel.filter("split = 'train' AND label = 0"), KEY, PANEL_SENSORS)
    return filled, linear.ridge_fit(filled.filter("split = 'train'"), "click", ["view", "error"])


@query(
    "ridge_fit",
    f"WITH {PANEL_Z_SQL}, {RIDGE_SQL} SELECT {sql_round('w1')} AS w_view, {sql_round('w2')} AS w_error, {sql_round('w0')} AS intercept,"
    f" {sql_round('rv', 4)} AS residual_variance, {sql_round('1 - rv / vy')} AS r2 FROM ridge",
)
def ridge_fit(spark, sf_dir):
    _, model = panel_ridge(spark, sf_dir)
    row = (*model["weights"], model["intercept"], model["residual_variance"], model["r2"])
    fit = spark.createDataFrame([row], "w_view double, w_error double, intercept double, residual_variance double, r2 double")
    return rounded(rounded(fit, "w_view", "w_error", "intercept", "r2"), "residual_variance", digits=4)


@query(
    "prediction_recovery",
    f"""WITH {PANEL_Z_SQL}, {RIDGE_SQL}, y AS (SELECT t, click + CASE WHEN t >= 400 AND t < 430 THEN 30 ELSE 0 END AS y, w0 + w1 * view + w2 * error AS p
      FROM filled, ridge)
    SELECT t, {sql_round('CASE WHEN t >= 400 AND t < 430 THEN y - p ELSE 0 END')} AS delta_hat,
      {sql_round('CASE WHEN t >= 400 AND t < 430 THEN p ELSE y END')} AS x_hat FROM y""",
)
def prediction_recovery(spark, sf_dir):
    filled, model = panel_ridge(spark, sf_dir)
    inside = (F.col("t") >= 400) & (F.col("t") < 430)
    rows = linear.ridge_predict(filled, model).withColumn("y", F.col("click") + F.when(inside, 30.0).otherwise(0.0))
    out = recovery.recover_from_prediction(rows, inside=inside)
    return rounded(out.select("t", "delta_hat", "x_hat"), "delta_hat", "x_hat")


@query("ridge_prediction_vectors")
def ridge_prediction_vectors(spark, sf_dir):
    """First component from the other 63; sixty-three unknowns have no short SQL twin."""
    rows = views.vectors(spark, sf_dir)
    companions = [f"v{i}" for i in range(1, views.VECTOR_WIDTH)]
    model = linear.ridge_fit(rows, "v0", companions)
    out = linear.ridge_predict(rows, model)
    return rounded(out.select("t", F.col("v0").alias("y"), "prediction"), "prediction")


_PREDICTION_SQL = """fit2 AS (SELECT v0_.a AS my, v0_.b AS m1, c1y / v1 AS w FROM
  (SELECT avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b,
    covar_pop(embedding[2]::DOUBLE, embedding[1]::DOUBLE) * count(*) / (count(*) + 1.0) AS c1y, var_pop(embedding[2]::DOUBLE) AS v1 FROM embeddings) v0_),
reg AS (SELECT label, embedding[1]::DOUBLE AS y, my + w * (embedding[2] - m1) AS p FROM embeddings, fit2)"""


@query(
    "regression_metrics",
    f"""WITH {_PREDICTION_SQL} SELECT label, {sql_round('sqrt(avg((y - p) * (y - p)))')} AS rmse, {sql_round('avg(abs(y - p))')} AS mae,
      {sql_round('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2 FROM reg GROUP BY label""",
)
def regression_metrics(spark, sf_dir):
    raw = views.table(spark, sf_dir, "embeddings").select(
        "label", F.col("embedding")[0].cast("double").alias("y"), F.col("embedding")[1].cast("double").alias("x")
    )
    model = linear.ridge_fit(raw, "y", ["x"])
    out = metrics.regression_metrics(linear.ridge_predict(raw, model), ["label"], "y", "prediction")
    return rounded(out, "rmse", "mae", "r2")


@query(
    "delta_bounds",
    f"""WITH {SERIES_SQL}, lim AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM split WHERE split = 'train' GROUP BY series_id)
    SELECT s.series_id, t, {sql_round('CASE WHEN t >= n // 2 THEN least(value + 5 - hi, value + 5 - lo) ELSE 0 END')} AS low,
      {sql_round('CASE WHEN t >= n // 2 THEN value + 5 - lo ELSE 0 END')} AS high FROM series s JOIN lim ON lim.series_id = s.series_id""",
)
def delta_bounds(spark, sf_dir):
    rows = views.split_series(spark, sf_dir)
    limits = rows.filter("split = 'train'").groupBy("series_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    inside = F.col("t") >= F.floor(F.col("n") / 2)
    low, high = solver.delta_bounds(F.col("value") + 5.0, F.col("lo"), F.col("hi"), inside)
    out = rows.join(limits, "series_id").select("series_id", "t", low.alias("low"), high.alias("high"))
    return rounded(out, "low", "high")


def solver_input(spark, sf_dir, declared=True):
    """One step scenario per series with the train mean as prediction and the train range as box."""
    rows = fitted(spark, sf_dir).withColumn("sensor", F.lit("value"))
    scen = series_scenarios(rows, ["step"], 10)
    whole = injection.inject_whole(rows, scen, random=False, keep=["onset", "duration", "amplitude"])
    fit = rows.groupBy("series_id").agg(
        F.max("mean_value").alias("prediction"), F.max("std_value").alias("scale"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    whole = whole.join(fit, "series_id").withColumn("offset", F.col("onset") + F.col("duration"))
    # unit scale keeps the penalties comparable between series
    units = ["value", "y", "delta", "prediction", "lo", "hi", "amplitude"]
    whole = whole.withColumns({c: F.col(c) / F.col("scale") for c in units})
    inside = F.col("support") if declared else None
    return staged(recovery.solver_rows(whole, "prediction", F.col("lo") - 3, F.col("hi") + 3, inside), "problems")


def _register_solver(name: str, doc: str, **options) -> None:
    declared = options.pop("declared")

    def run(spark, sf_dir):
        rows = solver_input(spark, sf_dir, declared)
        out = recovery.recover_sparse(rows, PAIR, **options)
        return rounded(out.select(*PAIR, "t", "delta_hat", "x_hat", "iterations", "loss", "gap"), "delta_hat", "x_hat", "loss", "gap", digits=4)

    run.__doc__ = doc
    query(name)(run)


STEP = solver.step_terms(1.0, 0.05)
TREND = solver.trend_terms(0.05, 0.5, 1.0)
_register_solver("step_recovery", "Offline step recovery inside the declared interval.", declared=True, terms=STEP, watch_box=True, least_iter=7)
_register_solver("trend_recovery", "Offline multi-order recovery without declared interval.", declared=False, terms=TREND)
_register_solver("causal_step_recovery", "Rolling step recovery.", declared=True, terms=STEP, window=48)
_register_solver("causal_trend_recovery", "Rolling multi-order recovery.", declared=False, terms=TREND, window=48)


# ---- exact recovery of short windows, against closed forms
BEND = solver.trend_terms(0.05, 0.0, 1.0)
PIECE = 3
_EXACT = {"tol": 1e-12, "max_iter": 200_000}

# Standard units, a box 1.5 around the value inside the second half, closed before it.
_CELLS = f"""cells AS (SELECT series_id, t, z AS r, CASE WHEN t >= n // 2 THEN z - 1.5 ELSE 0 END AS low,
    CASE WHEN t >= n // 2 THEN z + 1.5 ELSE 0 END AS high FROM z)"""

_ROLLING = """problems AS (SELECT series_id, t, least(t, 2) + 1 AS m,
    [lag(r, 2) OVER w, lag(r) OVER w, r] AS r, [lag(low, 2) OVER w, lag(low) OVER w, low] AS low,
    [lag(high, 2) OVER w, lag(high) OVER w, high] AS high
  FROM cells WINDOW w AS (PARTITION BY series_id ORDER BY t))"""
_PIECES = """problems AS (SELECT series_id, min(t) AS t, count(*) AS m,
    [NULL, NULL, NULL][count(*) + 1:3] || list(r ORDER BY t) AS r, [NULL, NULL, NULL][count(*) + 1:3] || list(low ORDER BY t) AS low,
    [NULL, NULL, NULL][count(*) + 1:3] || list(high ORDER BY t) AS high
  FROM cells GROUP BY series_id, t // 3)"""

# A problem of m rows stands in the last m places of three. Step recovery: for every way of
# joining neighbours and every sign of the jumps between groups, each group has its own
# minimum in the common box; the best of these points is the solution.
_STEP_SOLVED = """patterns(m, g, s) AS (VALUES (3, [1, 1, 1], [0, 0]), (3, [1, 2, 2], [1, 0]), (3, [1, 2, 2], [-1, 0]),
    (3, [1, 1, 2], [0, 1]), (3, [1, 1, 2], [0, -1]), (3, [1, 2, 3], [1, 1]), (3, [1, 2, 3], [1, -1]),
    (3, [1, 2, 3], [-1, 1]), (3, [1, 2, 3], [-1, -1]), (2, [0, 1, 1], [0, 0]), (2, [0, 1, 2], [0, 1]), (2, [0, 1, 2], [0, -1])),
  places AS (SELECT p.*, g, s, unnest(range(4 - p.m, 4)) AS i FROM problems p JOIN patterns USING (m)),
  groups AS (SELECT *, g[i] AS own, list_filter([1, 2, 3], lambda j: g[j] = g[i]) AS js FROM places),
  placed AS (SELECT *, list_sum(list_transform(js, lambda j: r[j])) / len(js)
      - (s[1] * ((g[2] = own)::INT - (g[1] = own)::INT) + s[2] * ((g[3] = own)::INT - (g[2] = own)::INT)) / len(js) AS mean,
      list_max(list_transform(js, lambda j: low[j])) AS lo, list_min(list_transform(js, lambda j: high[j])) AS hi FROM groups),
  points AS (SELECT series_id, t, m, g, s, any_value(r) AS r, list(greatest(lo, least(hi, sign(mean) * greatest(0, abs(mean) - 0.05))) ORDER BY i) AS d
    FROM placed GROUP BY series_id, t, m, g, s HAVING bool_and(lo <= hi)),
  valued AS (SELECT *, list_sum(list_transform(range(1, m + 1), lambda i: 0.5 * pow(r[3 - m + i] - d[i], 2) + 0.05 * abs(d[i])))
      + list_sum(list_transform(range(1, m), lambda i: abs(d[i + 1] - d[i]))) AS loss FROM points),
  solved AS (SELECT series_id, t, m, min_by(d, loss) AS d, min(loss) AS loss FROM valued GROUP BY series_id, t, m
    UNION ALL SELECT series_id, t, m, [greatest(low[3], least(high[3], r[3]))],
      0.5 * pow(r[3] - greatest(low[3], least(high[3], r[3])), 2) + 0.05 * abs(greatest(low[3], least(high[3], r[3]))) FROM problems WHERE m = 1)"""

# Second differences of three rows have one multiplier v; the bend falls as v grows, so v is
# an end of [-1, 1] or found by halving. Without a bend, each row has its own minimum.
_AT = "list_transform([1, 2, 3], lambda i: greatest(low[i], least(high[i], sign(r[i] - c[i] * {v}) * greatest(0, abs(r[i] - c[i] * {v}) - 0.05))))"
_BEND_SOLVED = f"""halved AS (SELECT series_id, t, r, low, high, [1, -2, 1] AS c, -1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0 AS k FROM problems WHERE m = 3
    UNION ALL SELECT series_id, t, r, low, high, c, CASE WHEN bend > 0 THEN (a + b) / 2 ELSE a END, CASE WHEN bend > 0 THEN b ELSE (a + b) / 2 END, k + 1
    FROM (SELECT *, list_dot_product({_AT.format(v='((a + b) / 2)')}, c::DOUBLE[]) AS bend FROM halved WHERE k < 60)),
  places AS (SELECT series_id, t, r, 3 AS m, {_AT.format(v='b')} AS d FROM halved WHERE k = 60
    UNION ALL SELECT series_id, t, r, m, CASE WHEN m = 2 THEN list_transform([2, 3], lambda i: greatest(low[i], least(high[i], sign(r[i]) * greatest(0, abs(r[i]) - 0.05))))
      ELSE [greatest(low[3], least(high[3], r[3]))] END FROM problems WHERE m < 3),
  solved AS (SELECT *, list_sum(list_transform(range(1, m + 1), lambda i: 0.5 * pow(r[3 - m + i] - d[i], 2) + 0.05 * abs(d[i])))
      + CASE WHEN m = 3 THEN abs(d[1] - 2 * d[2] + d[3]) ELSE 0 END AS loss FROM places)"""


def _register_exact(name: str, doc: str, terms: list, solved: str, rolling: bool) -> None:
    last = f"SELECT series_id, t, {sql_round('d[m]', 5)} AS delta_hat, {sql_round('loss', 5)} AS loss FROM solved"
    each = f"SELECT series_id, t + i - 1 AS t, {sql_round('d[i]', 5)} AS delta_hat, {sql_round('loss', 5)} AS loss FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM solved)"

    @query(name, f"WITH RECURSIVE {SERIES_SQL}, {FIT_SQL}, {_CELLS}, {_ROLLING if rolling else _PIECES}, {solved} {last if rolling else each}")
    def run(spark, sf_dir):
        cells = fitted(spark, sf_dir)
        inside = F.col("t") >= F.floor(F.col("n") / 2)
        low, high = (F.when(inside, F.col("z") + d).otherwise(0.0) for d in (-1.5, 1.5))
        cells = cells.select("series_id", "t", F.col("z").alias("r"), low.alias("low"), high.alias("high"))
        if rolling:
            out = solver.recover_rolling(cells, KEY, terms, PIECE, **_EXACT)
        else:
            pieces = cells.withColumn("piece", F.floor(F.col("t") / PIECE))
            out = solver.recover_whole(pieces, [*KEY, "piece"], terms, **_EXACT)
        return rounded(out.select("series_id", "t", "delta_hat", "loss"), "delta_hat", "loss", digits=5)

    run.__doc__ = doc


_register_exact("step_recovery_exact", "Step recovery of pieces of three rows.", STEP, _STEP_SOLVED, rolling=False)
_register_exact("trend_recovery_exact", "Recovery with second differences of pieces of three rows.", BEND, _BEND_SOLVED, rolling=False)
_register_exact("causal_step_recovery_exact", "Rolling step recovery over three rows.", STEP, _STEP_SOLVED, rolling=True)
_register_exact("causal_trend_recovery_exact", "Rolling recovery with second differences over three rows.", BEND, _BEND_SOLVED, rolling=True)


@query("long_recovery")
def long_recovery(spark, sf_dir):
    """All readings in time order as one series, recovered by blocks in parallel tasks."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "value", F.lit(0).alias("one"))
    rows = with_rank(events, ["one"], ["ts", "event_id"], "t")
    fit = rows.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    r = (F.col("value") - fit["m"]) / fit["s"]
    cells = rows.select("one", "t", r.alias("r"), (r - 1.5).alias("low"), (r + 1.5).alias("high"))
    out = solver.recover_long(cells, ["one"], STEP, gap=1e-4, tol=1e-6)
    return rounded(out.select("t", "delta_hat", "loss", "rounds"), "delta_hat", "loss", digits=3)


@query("noise_floor_sweep")
def noise_floor_sweep(spark, sf_dir):
    """Steps and drifts of a quarter to three residual deviations, recovered offline."""
    rows = fitted(spark, sf_dir).withColumn("sensor", F.lit("value")).withColumn("value", F.col("z"))
    base = series_scenarios(rows, ["step", "drift"], 16).drop("amplitude")
    weak = F.explode(F.array(*[F.lit(m) for m in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)]))
    scen = base.withColumn("amplitude", weak).withColumn(
        "scenario_id", F.concat_ws("_", "scenario_id", F.col("amplitude").cast("string"))
    )
    whole = injection.inject_whole(rows, scen, random=False).withColumn("prediction", F.lit(0.0))
    infinite = F.lit(float("inf"))
    problems = staged(recovery.solver_rows(whole, "prediction", -infinite, infinite), "problems")
    found = recovery.recover_sparse(problems, PAIR, TREND).filter("support")
    found = found.join(scen.select(*PAIR, "family", "amplitude"), PAIR)
    out = recovery.noise_floor_sweep(found, ["family", "amplitude"])
    return rounded(out, "delta_nrmse", "estimated_amplitude", "non_zero_fraction", digits=4)


# ------------------------------------------------------------------ constraints
@query(
    "channel_profile",
    f"""WITH {SUPPLIER_SQL}, named AS (SELECT ['L_', 'F_', 'P_'][sensor % 3 + 1] || sensor AS sensor, t, value FROM supplier_days),
    st AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY sensor ORDER BY t)) AS step FROM named)
    SELECT sensor, min(value) AS minimum, max(value) AS maximum, coalesce(max(step), 0) AS max_step,
      CASE WHEN sensor = 'F_1' THEN 'target_measurement' ELSE 'recorded_companion' END AS role,
      CASE WHEN sensor = 'F_1' THEN 'attackable' ELSE 'declared_unaffected' END AS attackability,
      'continuous' AS value_type, CASE WHEN sensor LIKE 'F%' THEN 'L/s' ELSE 'm' END AS unit FROM st GROUP BY sensor""",
)
def channel_profile(spark, sf_dir):
    from tidegauge.operators.ordered import with_rank

    days = views.supplier_days(spark, sf_dir)
    prefix = F.array(F.lit("L_"), F.lit("F_"), F.lit("P_"))
    named = days.withColumn("sensor", F.concat(F.element_at(prefix, (F.col("sensor") % 3 + 1).cast("int")), F.col("sensor").cast("string")))
    rows = with_rank(named.select("sensor", "t", "value"), ["sensor"], ["t"], "i")
    out = recovery.channel_profile(rows, [], "F_1", t="i")
    return out.select("sensor", "minimum", "maximum", "max_step", "role", "attackability", "value_type", "unit")


@query(
    "constraint_target_range",
    f"""WITH {PANEL_SQL} SELECT 'click' AS target_sensor, count(*) AS row_count, 5 AS sensor_count, 0 AS constant_sensor_count,
      {sql_round('min(click)')} AS minimum, {sql_round('max(click)')} AS maximum, {sql_round('stddev_pop(click)')} AS standard_deviation,
      count(*) - count(click) AS missing_count, {sql_round('quantile_cont(click, 0.01)')} AS quantile_01,
      {sql_round('quantile_cont(click, 0.5)')} AS median, {sql_round('quantile_cont(click, 0.99)')} AS quantile_99 FROM panel""",
)
def constraint_target_range(spark, sf_dir):
    out, _ = recovery.constraint_summary(views.hour_panel(spark, sf_dir), "click", PANEL_SENSORS, 3)
    return rounded(out, "minimum", "maximum", "standard_deviation", "quantile_01", "median", "quantile_99")


@query(
    "constraint_companions",
    f"""WITH {PANEL_SQL}, c AS ({' UNION ALL '.join(f"SELECT '{s}' AS sensor, corr({s}, click) AS c FROM panel" for s in PANEL_SENSORS if s != 'click')})
    SELECT sensor, {sql_round('c')} AS correlation, {sql_round('abs(c)')} AS absolute_correlation,
      row_number() OVER (ORDER BY abs(c) DESC, sensor) AS rank FROM c QUALIFY rank <= 3""",
)
def constraint_companions(spark, sf_dir):
    _, out = recovery.constraint_summary(views.hour_panel(spark, sf_dir), "click", PANEL_SENSORS, 3)
    return rounded(out, "correlation", "absolute_correlation")


_CANDIDATES_SQL = """cand AS (SELECT series_id, k, t, t >= n // 3 AND t < n // 3 + 8 AS support,
   CASE WHEN t >= n // 3 AND t < n // 3 + 8 THEN k * value * (t % 3) ELSE 0 END AS delta FROM series, range(3) r(k))"""


def candidates(spark, sf_dir):
    rows = views.user_series(spark, sf_dir)
    inside = (F.col("t") >= F.floor(F.col("n") / 3)) & (F.col("t") < F.floor(F.col("n") / 3) + 8)
    k = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    delta = F.when(inside, F.col("candidate") * F.col("value") * (F.col("t") % 3)).otherwise(0.0)
    out = rows.withColumn("candidate", k).withColumns({"delta": delta, "support": inside, "y": F.col("value")})
    return out.withColumn("clean", F.col("y") - F.col("delta")).select(
        F.col("series_id").alias("case_id"), "candidate", "t", "y", "clean", "delta", "support"
    )


@query(
    "candidate_separation",
    f"""WITH {SERIES_SQL}, {_CANDIDATES_SQL}, pair AS (SELECT a.series_id, max(abs(a.delta - b.delta)) AS d FROM cand a JOIN cand b
      ON a.series_id = b.series_id AND a.t = b.t AND a.k < b.k GROUP BY a.series_id, a.k, b.k)
    SELECT series_id AS case_id, 3 AS candidate_count, {sql_round('max(d)')} AS max_separation, CASE WHEN max(d) > 100 THEN TRUE END AS ambiguous,
      TRUE AS valid FROM pair GROUP BY series_id""",
)
def candidate_separation(spark, sf_dir):
    out = recovery.candidate_separation(candidates(spark, sf_dir), tau=100.0, tolerance=1e-9)
    return rounded(out.select("case_id", "candidate_count", "max_separation", "ambiguous", "valid"), "max_separation")


@query(
    "candidate_separation_l1",
    f"""WITH {SERIES_SQL}, {_CANDIDATES_SQL}, pair AS (SELECT a.series_id, sum(abs(a.delta - b.delta)) AS d FROM cand a JOIN cand b
      ON a.series_id = b.series_id AND a.t = b.t AND a.k < b.k GROUP BY a.series_id, a.k, b.k)
    SELECT series_id::VARCHAR AS case_id, {sql_round('max(d)')} AS max_separation, max(d) > 500 AS ambiguous FROM pair GROUP BY series_id""",
)
def candidate_separation_l1(spark, sf_dir):
    out = recovery.candidate_separation(candidates(spark, sf_dir), 500.0, "l1", 1e-9, exhaustive=True)
    return rounded(out.select("case_id", "max_separation", "ambiguous"), "max_separation")


# ---------------------------------------------------------------- scenario scores
SCORE_COLUMNS = [
    "delta_nrmse", "support_f1", "support_precision", "support_recall", "signed_amplitude_error", "clean_x_nrmse",
    "sign_accuracy", "coverage_90", "interval_sharpness", "interval_coverage_90",
]
SCORE_SQL = """scored AS (SELECT estimator, series_id, scenario_id, any_value(amplitude_std) AS amplitude_std, any_value(duration) AS duration,
    any_value(regime) AS regime, sqrt(avg((delta_hat - delta) * (delta_hat - delta))) / abs(any_value(amplitude)) AS delta_nrmse,
    count(*) FILTER (WHERE abs(delta_hat) > 0.1 * abs(amplitude)) AS tp, count(*) AS cells, any_value(m) AS m,
    quantile_cont(delta_hat, 0.5) AS med, any_value(amplitude) AS amp, any_value(sd) AS sd, any_value(unc) AS unc,
    sqrt(avg((x_hat - x) * (x_hat - x))) AS xr, sum(CASE WHEN abs(x_hat - x) <= 1.645 * unc THEN 1 ELSE 0 END) AS cov
  FROM est GROUP BY estimator, series_id, scenario_id),
sm AS (SELECT estimator, series_id, scenario_id, amplitude_std, duration, regime, delta_nrmse,
    CASE WHEN tp > 0 THEN 2.0 * (tp / cells) / (1 + tp / cells) ELSE 0 END AS support_f1, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END AS support_precision,
    tp / cells AS support_recall, (med - amp) / sd AS signed_amplitude_error, xr / sd AS clean_x_nrmse,
    CASE WHEN sign(med) = sign(amp) THEN 1.0 ELSE 0.0 END AS sign_accuracy,
    CASE WHEN unc > 0 THEN (cov + m - cells) / m ELSE 0 END AS coverage_90, 2 * 1.645 * unc AS interval_sharpness,
    CASE WHEN unc > 0 THEN cov / cells ELSE 0 END AS interval_coverage_90 FROM scored)"""
SUITE_SQL = f"""{BLOCK_SQL}, {persistence_sql(1, 'e1')}, {persistence_sql(5, 'e5')},
est AS (SELECT 'persistence' AS estimator, * FROM e1 UNION ALL SELECT 'seasonal' AS estimator, * FROM e5), {SCORE_SQL}"""


def suite(spark, sf_dir):
    return recovery.run_suite(attacked(spark, sf_dir), ESTIMATORS, extra=EXTRA)


@query(
    "benchmark_suite",
    f"WITH {SERIES_SQL}, {SUITE_SQL} SELECT estimator, series_id, scenario_id, "
    + ", ".join(f"{sql_round(c)} AS {c}" for c in SCORE_COLUMNS)
    + " FROM sm",
)
def benchmark_suite(spark, sf_dir):
    out = suite(spark, sf_dir).select("estimator", *PAIR, *SCORE_COLUMNS)
    return rounded(out, *SCORE_COLUMNS)


_LEVELS_SQL = """lv AS (SELECT 'overall' AS grouping_, 'all' AS bucket, * FROM sm UNION ALL SELECT 'amplitude', amplitude_std::VARCHAR, * FROM sm
  UNION ALL SELECT 'duration', duration::VARCHAR, * FROM sm UNION ALL SELECT 'regime', regime, * FROM sm),
summ AS (SELECT estimator, grouping_ AS grouping, bucket, count(*) AS n_scenarios, avg(delta_nrmse) AS mean_delta_nrmse, avg(support_f1) AS mean_support_f1,
  avg(clean_x_nrmse) AS mean_clean_x_nrmse, count(*) FILTER (WHERE amplitude_std >= 1) AS n_eligible,
  coalesce(avg(sign_accuracy) FILTER (WHERE amplitude_std >= 1), 1) AS sign_accuracy_ge_1std, avg(coverage_90) AS mean_coverage_90,
  avg(interval_sharpness) AS mean_interval_sharpness, quantile_cont(delta_nrmse, 0.5) AS median_delta_nrmse,
  quantile_cont(support_f1, 0.5) AS median_support_f1, quantile_cont(abs(signed_amplitude_error), 0.5) AS median_abs_amplitude_error
  FROM lv GROUP BY estimator, grouping_, bucket)"""
SUMMARY_COLUMNS = [
    "mean_delta_nrmse", "mean_support_f1", "mean_clean_x_nrmse", "sign_accuracy_ge_1std", "mean_coverage_90",
    "mean_interval_sharpness", "median_delta_nrmse", "median_support_f1", "median_abs_amplitude_error",
]


@query(
    "benchmark_summary",
    f"WITH {SERIES_SQL}, {SUITE_SQL}, {_LEVELS_SQL} SELECT estimator, grouping, bucket, n_scenarios, n_eligible, "
    + ", ".join(f"{sql_round(c)} AS {c}" for c in SUMMARY_COLUMNS)
    + " FROM summ",
)
def benchmark_summary(spark, sf_dir):
    out = metrics.benchmark_summary(staged(suite(spark, sf_dir), "suite"))
    return rounded(out, *SUMMARY_COLUMNS)


@query(
    "benchmark_improvement",
    f"""WITH {SERIES_SQL}, {SUITE_SQL}, {_LEVELS_SQL}, b AS (SELECT min(median_delta_nrmse) AS base, arg_min(estimator, median_delta_nrmse) AS best
      FROM summ WHERE grouping = 'overall')
    SELECT estimator, best AS best_causal, {sql_round('(base - median_delta_nrmse) / base')} AS improvement FROM summ, b WHERE grouping = 'overall'""",
)
def benchmark_improvement(spark, sf_dir):
    summary = staged(metrics.benchmark_summary(staged(suite(spark, sf_dir), "suite")), "summary")
    out = metrics.improvements(summary, ["persistence", "seasonal"])
    return rounded(out.select("estimator", "best_causal", "improvement"), "improvement")


@query(
    "benchmark_acceptance",
    f"""WITH {SERIES_SQL}, {SUITE_SQL}, {_LEVELS_SQL}, s AS (SELECT * FROM summ WHERE grouping = 'overall' AND estimator = 'seasonal'),
    b AS (SELECT median_delta_nrmse AS base FROM summ WHERE grouping = 'overall' AND estimator = 'persistence'),
    lim AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM series GROUP BY series_id),
    v AS (SELECT count(*) FILTER (WHERE x_hat < lo - 1e-4 OR x_hat > hi + 1e-4) AS v FROM e5 JOIN lim ON lim.series_id = e5.series_id),
    g AS (SELECT (base - median_delta_nrmse) / base >= 0.2 AS improvement_ge_20pct, median_abs_amplitude_error <= 0.25 AS amplitude_error_le_0_25std,
      sign_accuracy_ge_1std >= 0.95 AS sign_accuracy_ge_95pct, mean_coverage_90 >= 0.85 AS coverage_ge_85pct,
      mean_interval_sharpness < 0.25 AS sharpness_lt_0_25, v = 0 AS zero_violations FROM s, b, v),
    a AS (SELECT *, improvement_ge_20pct AND amplitude_error_le_0_25std AND sign_accuracy_ge_95pct AND coverage_ge_85pct AND sharpness_lt_0_25 AND zero_violations AS all_gates FROM g)
    UNPIVOT a ON COLUMNS(*) INTO NAME gate VALUE passed""",
)
def benchmark_acceptance(spark, sf_dir):
    hits = staged(attacked(spark, sf_dir), "attacked")
    results = recovery.run_suite(hits, ESTIMATORS, extra=EXTRA, written=True)
    summary = staged(metrics.benchmark_summary(staged(results, "suite")), "summary")
    found = ESTIMATORS["seasonal"](hits).withColumn("estimator", F.lit("seasonal"))
    broken = metrics.bound_violations(found, ["estimator"], "x_hat", F.col("lo"), F.col("hi"))
    return metrics.acceptance(summary, ["persistence"], ["seasonal"], broken)


@query(
    "bound_violations",
    f"""WITH {SERIES_SQL}, {BLOCK_SQL}, {persistence_sql(1, 'est')}
    SELECT series_id, count(*) FILTER (WHERE x_hat < 10 - 1e-4 OR x_hat > 60 + 1e-4) AS violations FROM est GROUP BY series_id""",
)
def bound_violations(spark, sf_dir):
    found = repetition(1)(attacked(spark, sf_dir))
    return metrics.bound_violations(found, KEY, "x_hat", F.lit(10.0), F.lit(60.0))


_FAMILY_SQL = f"""{scenarios_sql(['step', 'ramp', 'periodic', 'trapezoid'], 10)}, {STEPS_SQL},
tstd AS (SELECT series_id, stddev_samp(value) AS sd FROM split WHERE split = 'train' GROUP BY series_id),
full_ AS (SELECT c.*, s.t, s.value AS x, coalesce(st.delta, 0) AS delta, tstd.sd FROM scen c JOIN series s ON s.series_id = c.series_id
  JOIN tstd ON tstd.series_id = c.series_id
  LEFT JOIN steps st ON st.scenario_id = c.scenario_id AND s.t = st.onset + st.i),
est AS (SELECT *, x + delta - coalesce(lag(x + delta) OVER (PARTITION BY scenario_id ORDER BY t), x + delta) AS d1,
  x + delta - coalesce(lag(x + delta, 2) OVER (PARTITION BY scenario_id ORDER BY t), x + delta) AS d2 FROM full_)"""


def family_recovered(spark, sf_dir):
    """Waveform scenarios on whole series with two undeclared lag estimators, as rows per estimator."""
    rows = cells(spark, sf_dir)
    scen = series_scenarios(rows, ["step", "ramp", "periodic", "trapezoid"], 10)
    std = views.split_series(spark, sf_dir).filter("split = 'train'").groupBy("series_id").agg(
        F.stddev_samp("value").alias("train_std")
    )
    whole = injection.inject_whole(rows, scen, random=False, keep=["family", "onset", "duration", "amplitude"])
    whole = whole.join(std, "series_id").withColumnRenamed("value", "x").withColumn(
        "offset", F.col("onset") + F.col("duration")
    )
    whole = staged(whole, "whole")
    parts = [
        recovery.persistence_undeclared(whole, PAIR, lag).withColumns({"estimator": F.lit(f"lag{lag}"), "unc": F.lit(0.0)})
        for lag in (1, 2)
    ]
    return parts[0].unionByName(parts[1])


_PEAK_SQL = """pk AS (SELECT scenario_id, estimator, *  EXCLUDE (scenario_id, estimator), greatest(max(abs(a)) OVER w, max(abs(delta)) OVER w, 1e-6) AS peak,
   t >= onset AND t < onset + d AS inside FROM (
     SELECT 'lag1' AS estimator, d1 AS dh, * FROM est UNION ALL SELECT 'lag2', d2, * FROM est) WINDOW w AS (PARTITION BY scenario_id, estimator)),
cnt AS (SELECT estimator, series_id, scenario_id, any_value(family) AS family, any_value(sd) AS sd, any_value(a) AS a, any_value(peak) AS peak,
   sqrt(avg((dh - delta) * (dh - delta)) FILTER (WHERE inside)) / any_value(peak) AS delta_nrmse,
   count(*) FILTER (WHERE abs(dh) > 0.1 * peak AND abs(delta) > 0.1 * peak) AS tp, count(*) FILTER (WHERE abs(dh) > 0.1 * peak AND abs(delta) <= 0.1 * peak) AS fp,
   count(*) FILTER (WHERE abs(dh) <= 0.1 * peak AND abs(delta) > 0.1 * peak) AS fn, count(*) FILTER (WHERE abs(dh) <= 0.1 * peak AND abs(delta) <= 0.1 * peak) AS tn,
   quantile_cont(dh, 0.5) FILTER (WHERE inside) AS med, avg((dh - delta) * (dh - delta)) FILTER (WHERE inside) AS mse, avg(abs(dh - delta)) FILTER (WHERE inside) AS mae,
   max(abs(dh - delta)) FILTER (WHERE inside) AS max_error, avg((dh - delta) * (dh - delta)) AS full_mse, avg(abs(dh - delta)) AS full_mae,
   max(abs(dh - delta)) AS full_max_error, sqrt(sum(dh * dh)) AS l2, max(abs(dh)) AS linf, sqrt(sum((x + delta - dh) * (x + delta - dh))) AS xl2, max(abs(x + delta - dh)) AS xlinf
   FROM pk GROUP BY estimator, series_id, scenario_id)"""


@query(
    "scenario_metrics_peak",
    f"""WITH {SERIES_SQL}, {_FAMILY_SQL}, {_PEAK_SQL}
    SELECT estimator, series_id, scenario_id, {sql_round('delta_nrmse')} AS delta_nrmse, {sql_round('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS support_f1,
      {sql_round('(med - a) / sd')} AS signed_amplitude_error, CASE WHEN sign(med) = sign(a) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sign_accuracy FROM cnt""",
)
def scenario_metrics_peak(spark, sf_dir):
    out = metrics.scenario_metrics(family_recovered(spark, sf_dir), ["estimator", *PAIR], F.col("train_std"), peak=True)
    out = out.select("estimator", *PAIR, "delta_nrmse", "support_f1", "signed_amplitude_error", "sign_accuracy")
    return rounded(out, "delta_nrmse", "support_f1", "signed_amplitude_error")


TRAJECTORY = [
    "mse", "nrmse", "mae", "max_error", "full_mse", "full_rmse", "full_mae", "full_max_error", "delta_l2_norm",
    "delta_linf_norm", "x_hat_l2_norm", "x_hat_linf_norm", "tpr", "far", "f1_score",
]
_TRAJECTORY_SQL = [
    "mse", "delta_nrmse", "mae", "max_error", "full_mse", "sqrt(full_mse)", "full_mae", "full_max_error", "l2", "linf", "xl2", "xlinf",
    "coalesce(tp / nullif(tp + fn, 0), 1)", "coalesce(fp / nullif(fp + tn, 0), 0)", "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 1)",
]


@query(
    "trajectory_metrics",
    f"WITH {SERIES_SQL}, {_FAMILY_SQL}, {_PEAK_SQL} SELECT estimator, series_id, scenario_id, "
    + ", ".join(f"{sql_round(e)} AS {n}" for e, n in zip(_TRAJECTORY_SQL, TRAJECTORY))
    + " FROM cnt",
)
def trajectory_metrics(spark, sf_dir):
    out = metrics.trajectory_metrics(family_recovered(spark, sf_dir), ["estimator", *PAIR])
    return rounded(out, *TRAJECTORY)


@query(
    "family_reduction",
    f"""WITH {SERIES_SQL}, {_FAMILY_SQL}, {_PEAK_SQL}, f AS (SELECT family, quantile_cont(delta_nrmse, 0.5) FILTER (WHERE estimator = 'lag1') AS b,
      quantile_cont(delta_nrmse, 0.5) FILTER (WHERE estimator = 'lag2') AS c FROM cnt GROUP BY family)
    SELECT family, {sql_round('b')} AS base_nrmse, {sql_round('c')} AS better_nrmse, {sql_round('(b - c) / b * 100', 4)} AS reduction_percent FROM f""",
)
def family_reduction(spark, sf_dir):
    rows = family_recovered(spark, sf_dir)
    results = metrics.scenario_metrics(rows, ["estimator", "family", *PAIR], F.col("train_std"), peak=True)
    out = metrics.family_reduction(staged(results, "results"), "lag1", "lag2")
    return rounded(rounded(out, "base_nrmse", "better_nrmse"), "reduction_percent", digits=4)


@query(
    "metric_pivot",
    f"""WITH {SERIES_SQL}, {_FAMILY_SQL}, {_PEAK_SQL} SELECT series_id, family, {sql_round("max(delta_nrmse) FILTER (WHERE estimator = 'lag1')")} AS lag1,
      {sql_round("max(delta_nrmse) FILTER (WHERE estimator = 'lag2')")} AS lag2 FROM cnt GROUP BY series_id, family""",
)
def metric_pivot(spark, sf_dir):
    rows = family_recovered(spark, sf_dir)
    results = metrics.scenario_metrics(rows, ["estimator", "family", *PAIR], F.col("train_std"), peak=True)
    out = metrics.pivot_metric(results, ["series_id", "family"], "estimator", ["lag1", "lag2"], "delta_nrmse")
    return rounded(out, "lag1", "lag2")


@query(
    "declared_comparison",
    f"""WITH {SERIES_SQL}, {SUITE_SQL}, {_LEVELS_SQL}, o AS (SELECT * FROM summ WHERE grouping = 'overall'), w AS (SELECT * FROM summ WHERE grouping = 'regime' AND bucket = 'low_dynamics')
    SELECT w.estimator, {sql_round('o.median_delta_nrmse')} AS median_delta_nrmse_all, {sql_round('w.median_delta_nrmse')} AS median_delta_nrmse_low
    FROM w LEFT JOIN o ON o.estimator = w.estimator""",
)
def declared_comparison(spark, sf_dir):
    summary = staged(metrics.benchmark_summary(staged(suite(spark, sf_dir), "suite")), "summary")
    overall = summary.filter("grouping = 'overall'")
    low = summary.filter("grouping = 'regime' AND bucket = 'low_dynamics'")
    out = metrics.compare_runs(overall, low, ["median_delta_nrmse"], ("all", "low"))
    return rounded(out, "median_delta_nrmse_all", "median_delta_nrmse_low")


@query(
    "run_ranking",
    f"""WITH {SERIES_SQL}, r AS (SELECT series_id AS run_name, {sql_round('avg(value)', 8)} AS loss, {sql_round('avg(label)')} AS fpr, max(n) AS recall, min(value) AS delay FROM series GROUP BY series_id)
    SELECT row_number() OVER (ORDER BY loss, fpr, recall DESC, delay, run_name) AS selection_rank, run_name, loss, fpr, recall, delay FROM r""",
)
def run_ranking(spark, sf_dir):
    runs = views.user_series(spark, sf_dir).groupBy(F.col("series_id").alias("run_name")).agg(
        rnd(F.avg("value"), 8).alias("loss"), rnd(F.avg("label")).alias("fpr"),
        F.max("n").alias("recall"), F.min("value").alias("delay"),
    )
    order = [F.col("loss"), F.col("fpr"), -F.col("recall"), F.col("delay")]
    out = metrics.rank_runs(staged(runs, "runs"), order, ["loss", "fpr", "recall", "delay"], position="run_name")
    return out.select("selection_rank", "run_name", "loss", "fpr", "recall", "delay")


_SWEEP_SQL = f"""{FIT_SQL}, sh AS (SELECT unnest([0.0, 1.0, 3.0])::DOUBLE AS shift),
d AS (SELECT series_id, shift, t, n, s, (value - m) + CASE WHEN t >= n // 2 THEN shift * s ELSE 0 END AS y,
   (value - m) + CASE WHEN t >= n // 2 THEN shift * s ELSE 0 END - 0.5 * s AS d, 4 * s AS h FROM z, sh),
r AS (SELECT series_id, shift, t, greatest(0, d) AS before, h FROM d WHERE t = 0 UNION ALL
  SELECT d.series_id, d.shift, d.t, greatest(0, (CASE WHEN r.before > r.h THEN 0 ELSE r.before END) + d.d), d.h
  FROM r JOIN d ON d.series_id = r.series_id AND d.shift = r.shift AND d.t = r.t + 1),
runs AS (SELECT d.series_id, d.shift, min(d.t) FILTER (WHERE before > r.h AND d.t > n // 2) - any_value(n // 2) AS delay, avg(CASE WHEN before > r.h THEN 1.0 ELSE 0 END) AS fpr,
  avg(y) FILTER (WHERE d.t >= n // 2 AND d.t < n // 2 + 15) AS est, any_value(d.shift * s) AS level FROM d JOIN r ON r.series_id = d.series_id AND r.shift = d.shift AND r.t = d.t GROUP BY d.series_id, d.shift),
sweep AS (SELECT a.series_id, a.shift, a.delay, CASE WHEN a.delay IS NULL THEN 1 ELSE 0 END AS missed, c.fpr, abs(a.est - a.level) / abs(a.level) * 100 AS error_pct
  FROM runs a JOIN runs c ON c.series_id = a.series_id AND c.shift = 0 WHERE a.shift <> 0)"""


def sweep(spark, sf_dir):
    rows = fitted(spark, sf_dir).select(
        "series_id", "t", "n", (F.col("value") - F.col("mean_value")).alias("dev"),
        F.col("std_value").alias("scale"), F.floor(F.col("n") / 2).alias("t0"),
    )
    return recovery.delay_sweep(rows, [1.0, 3.0], 0.5, 4.0, 15)


@query(
    "delay_sweep",
    f"WITH RECURSIVE {SERIES_SQL}, {_SWEEP_SQL} SELECT series_id, shift, delay, missed, {sql_round('fpr')} AS fpr, {sql_round('error_pct', 4)} AS error_pct FROM sweep",
)
def delay_sweep(spark, sf_dir):
    return rounded(rounded(sweep(spark, sf_dir), "fpr"), "error_pct", digits=4)


@query(
    "sweep_summary",
    f"""WITH RECURSIVE {SERIES_SQL}, {_SWEEP_SQL} SELECT shift, round(avg(delay), 3) AS delay_mean, round(stddev_samp(delay), 3) AS delay_std, count(delay) AS delay_n,
      sum(missed)::BIGINT AS missed, round(avg(fpr), 3) AS fpr_mean, round(max(fpr), 3) AS fpr_max, round(avg(error_pct), 3) AS err_mean_pct, round(max(error_pct), 3) AS err_max_pct
    FROM sweep GROUP BY shift""",
)
def sweep_summary(spark, sf_dir):
    return metrics.sweep_summary(sweep(spark, sf_dir), ["shift"])


@query(
    "run_divergence",
    f"""WITH {SERIES_SQL}, {BLOCK_SQL}, {persistence_sql(1, 'est')}, run AS (
      SELECT series_id, scenario_id, t, delta_hat, r FROM est, range(3) q(r)
      UNION ALL SELECT series_id, scenario_id, t, delta_hat + CASE WHEN t % 5 = 0 THEN 0.5 ELSE 0 END, 3 FROM est WHERE t % 10 < 6)
    SELECT series_id, scenario_id, t, {sql_round('max(delta_hat) - min(delta_hat)')} AS max_difference,
      max(delta_hat) - min(delta_hat) <= 1e-12 AS verified FROM run GROUP BY series_id, scenario_id, t""",
)
def run_divergence(spark, sf_dir):
    """One estimator run three times under other partitionings, and a run that went wrong on some rows."""
    rows = block(spark, sf_dir)
    hits = staged(attacked(spark, sf_dir, rows), "attacked")
    runs = [
        persistence(rows.repartition(n, "t"), 1)(hits.repartition(n, "scenario_id")).select(*PAIR, "t", "delta_hat")
        for n in (2, 3, 7)
    ]
    error = F.when(F.pmod("t", F.lit(5)) == 0, 0.5).otherwise(0.0)
    wrong = runs[0].filter(F.pmod("t", F.lit(10)) < 6).withColumn("delta_hat", F.col("delta_hat") + error)
    every = runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(wrong)
    return rounded(metrics.run_divergence(every, [*PAIR, "t"], "delta_hat"), "max_difference")


# ------------------------------------------------------------------- known-delta pilot
_PILOT_SQL = f"""{FIT_SQL}, {scenarios_sql(['step', 'ramp', 'periodic'], 8)},
steps AS (SELECT *, {WAVE_SQL} AS u FROM (SELECT series_id, scenario_id, family, onset, d, a / 10 * 3 AS a, unnest(range(d)) AS i FROM scen)),
res0 AS (SELECT series_id, t, value, s, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS r FROM z),
cal AS (SELECT series_id, quantile_cont(abs(r) / s, 0.9) AS hi, quantile_cont(abs(r) / s, 0.6) AS lo FROM res0 WHERE t < 16 AND r IS NOT NULL GROUP BY series_id),
w AS (SELECT c.series_id, c.scenario_id, c.onset, c.onset + c.d AS offset_, z.t, z.s, coalesce(u, 0) * z.s AS delta, st.i IS NOT NULL AS support, z.value + coalesce(u, 0) * z.s AS y
  FROM scen c JOIN z ON z.series_id = c.series_id LEFT JOIN steps st ON st.scenario_id = c.scenario_id AND z.t = st.onset + st.i),
res AS (SELECT * FROM (SELECT w.*, y - lag(y) OVER (PARTITION BY w.scenario_id ORDER BY t) AS r, hi, lo FROM w JOIN cal ON cal.series_id = w.series_id) WHERE r IS NOT NULL),
act AS (SELECT *, abs(r / s) >= lo AS on_, abs(r / s) >= hi AS seed FROM res),
sst AS (SELECT *, CASE WHEN on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY scenario_id ORDER BY t), FALSE) THEN 1 ELSE 0 END AS st FROM act),
srun AS (SELECT *, sum(st) OVER (PARTITION BY scenario_id ORDER BY t) AS run FROM sst),
srun2 AS (SELECT *, count(*) FILTER (WHERE on_) OVER (PARTITION BY scenario_id, run) AS len, max(CASE WHEN on_ AND seed THEN 1 ELSE 0 END) OVER (PARTITION BY scenario_id, run) AS sd FROM srun),
est AS (SELECT 'pointwise' AS estimator, series_id, scenario_id, onset, offset_, t, delta, support, CASE WHEN seed THEN r ELSE 0 END AS dh FROM srun2
  UNION ALL SELECT 'temporal_support', series_id, scenario_id, onset, offset_, t, delta, support, CASE WHEN on_ AND len >= 2 AND sd = 1 THEN r ELSE 0 END FROM srun2),
ct AS (SELECT estimator, scenario_id, series_id, count(*) FILTER (WHERE support AND dh <> 0) AS tp, count(*) FILTER (WHERE NOT support AND dh <> 0) AS fp,
  count(*) FILTER (WHERE support AND dh = 0) AS fn, coalesce(avg(abs(dh - delta)) FILTER (WHERE support), 0) AS mae,
  coalesce(avg(CASE WHEN sign(dh) = sign(delta) THEN 1.0 ELSE 0.0 END) FILTER (WHERE support), 1) AS sg,
  coalesce(abs(min(t) FILTER (WHERE dh <> 0) - any_value(onset)), 'inf'::DOUBLE) AS oe,
  coalesce(abs(max(t) FILTER (WHERE dh <> 0) + 1 - min(t) FILTER (WHERE dh <> 0) - any_value(offset_ - onset)), 'inf'::DOUBLE) AS de
  FROM est GROUP BY estimator, scenario_id, series_id),
pilot AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM ct)"""


def pilot(spark, sf_dir):
    """Prefix calibration, injection, lag-1 residual, pointwise and hysteresis support."""
    rows, scales, scen = scaled_scenarios(spark, sf_dir)
    scen = scen.withColumn("amplitude", F.col("amplitude") * 3)
    fit = rows.groupBy("series_id").agg(F.max("std_value").alias("scale"))
    clean = with_lag(rows, KEY, {"_p": ("value", 1)}).filter(F.col("_p").isNotNull())
    gap = F.col("value") - F.col("_p")
    q = [metrics.sensor_thresholds(clean, KEY, gap, F.col("std_value"), 16, level) for level in (0.9, 0.6)]
    limits = q[0].withColumnRenamed("threshold", "high").join(q[1].withColumnRenamed("threshold", "low"), "series_id")
    whole = injection.inject_whole(rows, scen, random=False).join(fit, "series_id")
    whole = whole.withColumn("delta", F.col("delta") * F.col("scale")).withColumn("y", F.col("value") + F.col("delta"))
    whole = staged(whole, "whole")
    residual = with_lag(whole, PAIR, {"_p": ("y", 1)}).filter(F.col("_p").isNotNull())
    residual = residual.withColumn("r", F.col("y") - F.col("_p")).join(limits, "series_id")
    residual = staged(residual.join(scen.select(*PAIR, "onset", "duration"), PAIR), "residual")
    z = F.col("r") / F.col("scale")
    point = residual.withColumns(
        {"estimator": F.lit("pointwise"), "delta_hat": scores.threshold_delta(F.col("r"), F.col("scale"), F.col("high"))}
    )
    held = scores.temporal_support(
        residual.withColumnRenamed("support", "declared"), PAIR, z, F.col("high"), F.col("low"), 2
    ).withColumns(
        {"estimator": F.lit("temporal_support"), "delta_hat": F.when(F.col("support"), F.col("r")).otherwise(0.0)}
    ).drop("support").withColumnRenamed("declared", "support")
    return point.unionByName(held)


@query(
    "known_delta_pilot",
    f"""WITH {SERIES_SQL}, {_PILOT_SQL} SELECT estimator, series_id, scenario_id, {sql_round('pr')} AS support_precision, {sql_round('rc')} AS support_recall,
      {sql_round('coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)')} AS support_f1, {sql_round('coalesce(tp / nullif(tp + fp + fn, 0), 0)')} AS support_iou,
      {sql_round('mae')} AS magnitude_mae_on_support, {sql_round('sg')} AS sign_accuracy_on_support, oe AS onset_error_samples, de AS duration_error_samples FROM pilot""",
)
def known_delta_pilot(spark, sf_dir):
    rows = staged(pilot(spark, sf_dir), "pilot")
    by = ["estimator", *PAIR]
    found = metrics.recovery_metrics(rows, by, support="support")
    timing = metrics.timing_metrics(rows, by, "delta_hat", F.col("onset"), F.col("onset") + F.col("duration"))
    names = [c for c in found.columns if c not in by]
    return rounded(found.join(timing, by), *names)


@query(
    "recovery_metrics",
    f"""WITH {SERIES_SQL}, {_PILOT_SQL} SELECT estimator, sum(tp)::BIGINT AS tp, {sql_round('sum(tp) / sum(tp + fp)')} AS support_precision, {sql_round('sum(tp) / sum(tp + fn)')} AS support_recall FROM ct GROUP BY estimator""",
)
def recovery_metrics(spark, sf_dir):
    rows = staged(pilot(spark, sf_dir), "pilot")
    out = metrics.recovery_metrics(rows, ["estimator"], support="support")
    hits = rows.groupBy("estimator").agg(metrics.count_if(F.col("support") & (F.col("delta_hat") != 0)).alias("tp"))
    return rounded(
        out.join(hits, "estimator").select("estimator", "tp", "support_precision", "support_recall"),
        "support_precision", "support_recall",
    )


# ----------------------------------------------------------------------- diagnostics
_LONG_SQL = f"long AS ({' UNION ALL '.join(f'SELECT {chr(39)}{s}{chr(39)} AS sensor, t, {s} AS z FROM pz' for s in PANEL_SENSORS)})"


def panel_long(spark, sf_dir):
    long = panel_z(spark, sf_dir).unpivot(["series_id", "t"], PANEL_SENSORS, "sensor", "z")
    return long.withColumn("active", F.abs("z") >= 1.0)


@query(
    "window_activation",
    f"""WITH {PANEL_Z_SQL}, {_LONG_SQL}, st AS (SELECT t, count(*) AS c, count(*) FILTER (WHERE abs(z) >= 1) AS a FROM long GROUP BY t),
    wn AS (SELECT *, t >= 250 AS late, CASE WHEN t >= 250 THEN (t - 250) // 48 ELSE t // 48 END AS w FROM st)
    SELECT CASE WHEN late THEN 'assessment' ELSE 'calibration' END AS window_role, min(t) AS window_start, max(t) + 1 AS window_end,
      {sql_round('sum(a) / sum(c)')} AS active_sensor_fraction, {sql_round('avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END)')} AS active_timestep_fraction FROM wn GROUP BY late, w""",
)
def window_activation(spark, sf_dir):
    out = metrics.window_activation(panel_long(spark, sf_dir), KEY, 48, 250).drop("series_id")
    return rounded(out, "active_sensor_fraction", "active_timestep_fraction")


@query(
    "phase_activation",
    f"""WITH {PANEL_Z_SQL}, {_LONG_SQL}, st AS (SELECT t, count(*) AS c, count(*) FILTER (WHERE abs(z) >= 1) AS a FROM long WHERE sensor IN ('click', 'view') GROUP BY t)
    SELECT CASE WHEN t < 300 THEN 'pre_attack' WHEN t < 340 THEN 'attack' ELSE 'post_attack' END AS phase, count(*) AS sample_count,
      {sql_round('sum(a) / sum(c)')} AS active_sensor_fraction, {sql_round('avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END)')} AS active_timestep_fraction FROM st GROUP BY 1""",
)
def phase_activation(spark, sf_dir):
    rows = panel_long(spark, sf_dir).filter(F.col("sensor").isin("click", "view"))
    out = metrics.phase_activation(rows, KEY, F.lit(300), F.lit(340)).drop("series_id")
    return rounded(out, "active_sensor_fraction", "active_timestep_fraction")


@query(
    "sensor_trace",
    f"""WITH {PANEL_Z_SQL} SELECT t, {sql_round('(click + view) / 2')} AS mean_signed_residual,
      {sql_round('(CASE WHEN t >= 300 AND t < 340 THEN 2.0 ELSE 0 END)')} AS mean_signed_true_delta FROM pz""",
)
def sensor_trace(spark, sf_dir):
    rows = panel_long(spark, sf_dir).filter(F.col("sensor").isin("click", "view"))
    delta = F.when((F.col("t") >= 300) & (F.col("t") < 340), 2.0).otherwise(0.0)
    out = metrics.sensor_trace(rows, KEY, F.col("z"), delta, F.lit(1.0)).drop("series_id")
    return rounded(out, "mean_signed_residual", "mean_signed_true_delta")

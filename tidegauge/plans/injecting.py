"""Queries on injections and scenario grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.hashing import sql_gaussian, sql_uniform
from tidegauge.functions.waveforms import FAMILIES, canonical_family
from tidegauge.operators import injection
from tidegauge.plans.registry import query, rnd, rounded, sql_round
from tidegauge.plans.scoring import FIT_SQL, fitted
from tidegauge.sources import views
from tidegauge.sources.views import SERIES_SQL

FIXED = [f for f in FAMILIES if f not in ("brownian", "ou")]
LENGTHS_SQL = "lens AS (SELECT series_id, max(n) AS n FROM series GROUP BY series_id)"


def cells(spark, sf_dir):
    """User series as long cells with the single sensor ``value``."""
    return views.user_series(spark, sf_dir).withColumn("sensor", F.lit("value"))


def lengths(rows):
    return rows.groupBy("series_id").agg(F.max("n").alias("n"))


def series_scenarios(rows, families, duration=12):
    """One scenario per series and family, onset at a third, amplitude 10 + family index.

    Joins of these rows are merged, see ``injection.scenario_deltas``.
    """
    family = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(i).alias("k")) for i, f in enumerate(families)]))
    return (
        lengths(rows).withColumn("_f", family).select("series_id", "n", "_f.*")
        .select(
            "series_id",
            F.concat_ws("_", F.col("series_id").cast("string"), "family").alias("scenario_id"),
            "family",
            F.array(F.lit("value")).alias("sensors"),
            F.floor(F.col("n") / 3).alias("onset"),
            F.lit(duration).cast("long").alias("duration"),
            (10.0 + F.col("k")).alias("amplitude"),
            injection.no_parameters().alias("parameters"),
        )
        .hint("merge")
    )


def scenarios_sql(families, duration=12) -> str:
    values = ", ".join(f"('{f}', {i})" for i, f in enumerate(families))
    return f"""{LENGTHS_SQL}, scen AS (SELECT series_id, series_id || '_' || family AS scenario_id, family,
      n // 3 AS onset, {duration} AS d, 10.0::DOUBLE + k AS a FROM lens, (VALUES {values}) f(family, k))"""


WAVE_SQL = """CASE family WHEN 'step' THEN a WHEN 'ramp' THEN a * i / (d - 1) WHEN 'drift' THEN a * i / (d - 1)
  WHEN 'pulse' THEN a WHEN 'periodic' THEN a * sin(2 * pi() * i / 24)
  WHEN 'trapezoid' THEN a * CASE WHEN i / (d - 1) < 0.2 THEN i / (d - 1) / 0.2 WHEN i / (d - 1) < 0.8 THEN 1 ELSE (1 - i / (d - 1)) / (1 - 0.8) END
  WHEN 'sigmoidal' THEN a * (1 / (1 + exp(-10 / (d - 1) * (i - (d - 1) / 2))) - 1 / (1 + exp(5))) / (1 / (1 + exp(-5)) - 1 / (1 + exp(5)))
  WHEN 'chirp' THEN a * sin(2 * pi() * (0.01 + 0.09 / (2 * d) * i) * i) END"""
STEPS_SQL = f"steps AS (SELECT *, {WAVE_SQL} AS delta FROM (SELECT *, unnest(range(d)) AS i FROM scen))"


@query(
    "injected_waveforms",
    f"""WITH {SERIES_SQL}, {scenarios_sql(FIXED)}, {STEPS_SQL}
    SELECT st.series_id, scenario_id, s.t, {sql_round('delta')} AS delta, {sql_round('s.value + delta')} AS y
    FROM steps st JOIN series s ON s.series_id = st.series_id AND s.t = st.onset + st.i""",
)
def injected_waveforms(spark, sf_dir):
    rows = cells(spark, sf_dir)
    out = injection.inject(rows, series_scenarios(rows, FIXED), random=False)
    return rounded(out.select("series_id", "scenario_id", "t", "delta", "y"), "delta", "y")


@query(
    "injected_whole_series",
    f"""WITH {SERIES_SQL}, {scenarios_sql(['step', 'ramp', 'periodic'], 10)}, {STEPS_SQL}
    SELECT c.series_id, c.scenario_id, s.t, {sql_round('coalesce(delta, 0)')} AS delta, st.i IS NOT NULL AS support,
      {sql_round('s.value + coalesce(delta, 0)')} AS y
    FROM scen c JOIN series s ON s.series_id = c.series_id
      LEFT JOIN steps st ON st.scenario_id = c.scenario_id AND st.series_id = c.series_id AND s.t = st.onset + st.i""",
)
def injected_whole_series(spark, sf_dir):
    rows = cells(spark, sf_dir)
    out = injection.inject_whole(rows, series_scenarios(rows, ["step", "ramp", "periodic"], 10), random=False)
    return rounded(out.select("series_id", "scenario_id", "t", "delta", "support", "y"), "delta", "y")


@query(
    "injected_brownian",
    f"""WITH {SERIES_SQL}, {scenarios_sql(['brownian'], 16)},
    w AS (SELECT *, a / sqrt(d) * {sql_gaussian("'7:' || scenario_id || ':' || i")} AS e FROM (SELECT *, unnest(range(d)) AS i FROM scen))
    SELECT series_id, scenario_id, onset + i AS t, {sql_round('sum(e) OVER (PARTITION BY scenario_id ORDER BY i)')} AS delta FROM w""",
)
def injected_brownian(spark, sf_dir):
    rows = cells(spark, sf_dir)
    deltas = injection.scenario_deltas(series_scenarios(rows, ["brownian"], 16), seed=7)
    return rounded(deltas.select("series_id", "scenario_id", "t", "delta"), "delta")


@query(
    "injected_mean_reverting",
    f"""WITH {SERIES_SQL}, {scenarios_sql(['ou'], 16)},
    w AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE 0.1 * a + 0.1 * a * {sql_gaussian("'7:' || scenario_id || ':' || (i - 1)")} END AS x
          FROM (SELECT *, unnest(range(d)) AS i FROM scen))
    SELECT p.series_id, p.scenario_id, p.onset + p.i AS t, {sql_round('sum(pow(0.9, p.i - q.i) * q.x)')} AS delta
    FROM w p JOIN w q ON p.scenario_id = q.scenario_id AND q.i <= p.i GROUP BY ALL""",
)
def injected_mean_reverting(spark, sf_dir):
    rows = cells(spark, sf_dir)
    deltas = injection.scenario_deltas(series_scenarios(rows, ["ou"], 16), seed=7)
    return rounded(deltas.select("series_id", "scenario_id", "t", "delta"), "delta")


@query(
    "family_names",
    """SELECT event_type AS raw, CASE event_type WHEN 'click' THEN 'periodic' WHEN 'view' THEN 'ou'
      WHEN 'signup' THEN 'step' WHEN 'purchase' THEN 'sigmoidal' END AS family, count(*) AS n FROM events GROUP BY event_type""",
)
def family_names(spark, sf_dir):
    """Aliases, spelling and unknown names, one per event type."""
    given = F.create_map(
        *[
            F.lit(x)
            for x in (
                "click", " Sinusoid", "view", "ORNSTEIN_UHLENBECK", "signup", "step ", "purchase", "sigmoid",
                "error", "sawtooth",
            )
        ]
    )
    events = views.table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "family", canonical_family(given[F.col("raw")])
    )


@query(
    "open_ended_injection",
    f"""WITH {SERIES_SQL} SELECT series_id, t,
      {sql_round('value + CASE WHEN t >= n // 2 THEN 20.0 ELSE 0 END')} AS step,
      {sql_round('value + CASE WHEN t >= n // 2 THEN 0.5 * (t - n // 2) ELSE 0 END')} AS ramp,
      {sql_round('value + CASE WHEN t >= n // 2 THEN 5 * sin(2 * pi() * 0.05 * (t - n // 2)) ELSE 0 END')} AS periodic,
      {sql_round("value + CASE WHEN t >= n // 2 AND series_id % 2 = 0 THEN 20.0 ELSE 0 END")} AS coordinated FROM series""",
)
def open_ended_injection(spark, sf_dir):
    rows = views.user_series(spark, sf_dir).withColumn(
        "sensor", F.when(F.col("series_id") % 2 == 0, "even").otherwise("odd")
    )
    half = F.floor(F.col("n") / 2)
    out = rows
    for name, options in (
        ("step", {"c": 20.0}),
        ("ramp", {"r": 0.5}),
        ("periodic", {"amplitude": 5.0, "frequency": 0.05}),
        ("coordinated", {"c": 20.0, "sensors": ["even"]}),
    ):
        out = injection.inject_open(out, ["series_id"], name, half, **options).withColumnRenamed("y", name).drop("delta")
    return rounded(out.select("series_id", "t", "step", "ramp", "periodic", "coordinated"), "step", "ramp", "periodic", "coordinated")


def scaled_scenarios(spark, sf_dir, families=("step", "ramp", "periodic")):
    rows = fitted(spark, sf_dir).withColumn("sensor", F.lit("value"))
    scales = rows.groupBy("series_id", "sensor").agg(F.max("std_value").alias("scale"))
    scen = series_scenarios(rows, list(families), 8).withColumn("amplitude", F.col("amplitude") / 10.0)
    return rows, scales, scen


@query(
    "standardized_injection",
    f"""WITH {SERIES_SQL}, {FIT_SQL}, {scenarios_sql(['step', 'ramp', 'periodic'], 8)},
      steps AS (SELECT *, {WAVE_SQL} AS delta FROM (SELECT series_id, scenario_id, family, onset, d, a / 10 AS a, unnest(range(d)) AS i FROM scen))
    SELECT st.series_id, scenario_id, z.t, {sql_round('delta * s')} AS delta, {sql_round('z.value + delta * s')} AS y
    FROM steps st JOIN z ON z.series_id = st.series_id AND z.t = st.onset + st.i""",
)
def standardized_injection(spark, sf_dir):
    rows, scales, scen = scaled_scenarios(spark, sf_dir)
    out = injection.inject_standardized(rows, scen, scales)
    return rounded(out.select("series_id", "scenario_id", "t", "delta", "y"), "delta", "y")


def _audit_sql(wrong: str, off: str) -> str:
    return f"""WITH {SERIES_SQL}, {FIT_SQL}, {scenarios_sql(['step', 'ramp', 'periodic'], 8)},
      steps AS (SELECT *, {WAVE_SQL} AS u FROM (SELECT series_id, scenario_id, family, onset, d, a / 10 AS a, unnest(range(d)) AS i FROM scen)),
      w AS (SELECT c.series_id, c.scenario_id, z.value, z.m, z.s, st.i IS NOT NULL AS support, coalesce(u, 0) * z.s AS delta
        FROM scen c JOIN z ON z.series_id = c.series_id
        LEFT JOIN steps st ON st.scenario_id = c.scenario_id AND z.t = st.onset + st.i),
      a AS (SELECT series_id, scenario_id, value, m, s, support, delta AS expected, delta + {wrong} AS delta, value + delta + {off} AS y FROM w),
      b AS (SELECT *, (((((value - m) / s)::FLOAT::DOUBLE + expected / s)::FLOAT::DOUBLE * s + m)::FLOAT::DOUBLE) - value AS leak FROM a)
    SELECT series_id, scenario_id, count(*) FILTER (WHERE support) AS declared_support_count,
      count(*) FILTER (WHERE NOT support AND delta <> 0) AS nonzero_off_support, bool_and(y = value + delta) AS observed_is_sum,
      bool_and(delta = expected) AS delta_is_expected, count(*) FILTER (WHERE NOT support AND leak <> 0) AS single_precision_leaks,
      {sql_round('coalesce(max(abs(leak)) FILTER (WHERE NOT support), 0)', 7)} AS single_precision_max_leak FROM b GROUP BY series_id, scenario_id"""


def audited(spark, sf_dir, wrong=None, off=None):
    """Audit of whole-series injections against the standardised route, rescaled.

    ``wrong`` is added to the disturbance and ``off`` to the observation, to see the checks fail.
    """
    rows, scales, scen = scaled_scenarios(spark, sf_dir)
    fit = rows.groupBy("series_id").agg(F.max("mean_value").alias("mean"), F.max("std_value").alias("scale"))
    expected = injection.inject_standardized(rows, scen, scales).select(
        "series_id", "scenario_id", "t", F.col("delta").alias("expected")
    )
    whole = injection.inject_whole(rows, scen, random=False).join(fit, "series_id")
    whole = whole.join(expected, ["series_id", "scenario_id", "t"], "left").withColumns(
        {"expected": F.coalesce("expected", F.lit(0.0)), "delta": F.col("delta") * F.col("scale")}
    )
    whole = whole.withColumn("y", F.col("value") + F.col("delta") + (F.lit(0.0) if off is None else off))
    if wrong is not None:
        whole = whole.withColumn("delta", F.col("delta") + wrong)
    out = injection.audit_injection(whole, ["series_id", "scenario_id"], "expected", "mean", "scale")
    return rounded(out, "single_precision_max_leak", digits=7)


@query("injection_audit", _audit_sql("0", "0"))
def injection_audit(spark, sf_dir):
    return audited(spark, sf_dir)


@query("injection_audit_failing", _audit_sql("CASE WHEN m > 55 AND NOT support THEN 0.25 ELSE 0 END", "CASE WHEN m < 50 AND support THEN 0.125 ELSE 0 END"))
def injection_audit_failing(spark, sf_dir):
    """Some series with a disturbance off its support, some with an observation that is no sum."""
    wrong = F.when((F.col("mean") > 55) & ~F.col("support"), 0.25).otherwise(0.0)
    off = F.when((F.col("mean") < 50) & F.col("support"), 0.125).otherwise(0.0)
    return audited(spark, sf_dir, wrong, off)


GRID = {
    "families": ["step", "ramp", "periodic"],
    "channels": ["click", "view"],
    "durations": [20, 50],
    "onsets": [180, 360, 690],
    "amplitudes": [1.0, 5.0],
}


def panel_length(spark, sf_dir) -> int:
    return views.hour_panel(spark, sf_dir).count()


@query(
    "scenario_grid",
    """WITH n AS (SELECT date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 AS n FROM events),
    g AS (SELECT *, row_number() OVER (ORDER BY fi, ci, di, oi, ai) - 1 AS k FROM (
      SELECT f.*, c.*, d.*, o.oi, least(o.o, greatest(0, n - 21)) AS o, a.*, n FROM n,
       (VALUES (0, 'step'), (1, 'ramp'), (2, 'periodic')) f(fi, f), (VALUES (0, 'click'), (1, 'view')) c(ci, c),
       (VALUES (0, 20), (1, 50)) d(di, d), (SELECT r AS oi, 24 * r AS o FROM n, range((n + 23) // 24) q(r)) o, (VALUES (0, 1.0), (1, 5.0)) a(ai, a))
      WHERE o + d <= n)
    SELECT format('sweep_{:06d}_{}', k, f) AS scenario_id, f AS family, c AS sensor, o AS onset, d AS duration, a::DOUBLE AS amplitude FROM g""",
)
def scenario_grid(spark, sf_dir):
    """A sweep with one onset per day of the panel."""
    n = panel_length(spark, sf_dir)
    out = injection.scenario_grid(spark, "panel", n, **{**GRID, "onsets": range(0, n, 24)})
    return out.select("scenario_id", "family", F.col("sensors")[0].alias("sensor"), "onset", "duration", "amplitude")


@query(
    "scenario_cycle",
    """WITH n AS (SELECT date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 AS n, count(*) // 10 AS total FROM events),
    g AS (SELECT i, n, ['step', 'ramp', 'periodic'][i % 3 + 1] AS f, ['click', 'view'][i % 2 + 1] AS c, [20, 50][i % 2 + 1] AS d,
       least([180, 360, 690][i % 3 + 1], greatest(0, n - 21)) AS o, [1.0, 5.0][i % 2 + 1] AS a FROM n, range(total) r(i))
    SELECT format('batch_{:06d}_{}', i, f) AS scenario_id, f AS family, c AS sensor,
      CASE WHEN o + d > n THEN greatest(0, n - d) // 2 ELSE o END AS onset, d AS duration, a::DOUBLE AS amplitude FROM g""",
)
def scenario_cycle(spark, sf_dir):
    """One scenario for every ten events."""
    total = views.table(spark, sf_dir, "events").count() // 10
    out = injection.scenario_cycle(spark, "panel", panel_length(spark, sf_dir), total, **GRID)
    return out.select("scenario_id", "family", F.col("sensors")[0].alias("sensor"), "onset", "duration", "amplitude")


def _hash_int(low: str, high: str, what: str) -> str:
    return f"({low} + floor({sql_uniform(chr(39) + '42:' + what + ':' + chr(39) + ' || name')} * ({high} - {low})))::BIGINT"


@query(
    "random_corpus",
    f"""WITH n AS (SELECT count(*) // 10 AS total, (SELECT date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 FROM events) AS n FROM events),
    k AS (SELECT greatest(1, total // 10) AS per, * FROM n),
    g AS (SELECT n, [{', '.join(repr(f) for f in FAMILIES)}][i // per + 1] AS f, i % per AS j FROM k, range(least(total, per * 10)) r(i)),
    m AS (SELECT *, format('{{}}_{{:05d}}', f, j) AS name FROM g),
    d AS (SELECT *, least({_hash_int('20', '100', 'duration')}, n - 1) AS d FROM m)
    SELECT name AS scenario_id, f AS family, ['click', 'view'][{_hash_int('0', '2', 'channel')} + 1] AS sensor,
      {_hash_int('0', '(n - d)', 'onset')} AS onset, d AS duration,
      {sql_round(f"1.0 + 9.0 * {sql_uniform(chr(39) + '42:amplitude:' + chr(39) + ' || name')}")} AS amplitude FROM d""",
)
def random_corpus(spark, sf_dir):
    """One scenario for every ten events."""
    total = views.table(spark, sf_dir, "events").count() // 10
    out = injection.random_corpus(spark, "panel", panel_length(spark, sf_dir), ["click", "view"], total)
    return out.select(
        "scenario_id", "family", F.col("sensors")[0].alias("sensor"), "onset", "duration", rnd("amplitude").alias("amplitude")
    )


_ENVELOPE = f"""{scenarios_sql(FIXED)}, {STEPS_SQL},
  cell AS (SELECT c.series_id, c.scenario_id, s.value + coalesce(st.delta, 0) AS y
    FROM scen c JOIN series s ON s.series_id = c.series_id
    LEFT JOIN steps st ON st.scenario_id = c.scenario_id AND s.t = st.onset + st.i)"""


@query(
    "envelope_check",
    f"""WITH {SERIES_SQL}, {_ENVELOPE}, lim AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM series GROUP BY series_id)
    SELECT c.series_id, scenario_id, count(*) FILTER (WHERE y < lo - 1e-9 OR y > hi + 1e-9) AS violation_count,
      count(*) FILTER (WHERE y < lo - 1e-9 OR y > hi + 1e-9) = 0 AS is_valid,
      {sql_round('nullif(greatest(max(lo - y), 0), 0)')} AS under, {sql_round('nullif(greatest(max(y - hi), 0), 0)')} AS over
    FROM cell c JOIN lim ON lim.series_id = c.series_id GROUP BY c.series_id, scenario_id""",
)
def envelope_check(spark, sf_dir):
    rows = cells(spark, sf_dir)
    scen = series_scenarios(rows, FIXED)
    out = injection.check_envelope(rows, scen, injection.scenario_deltas(scen, random=False))
    return out.select(
        "series_id", "scenario_id", "violation_count", "is_valid",
        rnd(F.try_element_at("min_violations", F.lit("value"))).alias("under"),
        rnd(F.try_element_at("max_violations", F.lit("value"))).alias("over"),
    )


@query(
    "envelope_check_given_bounds",
    f"""WITH {SERIES_SQL}, {_ENVELOPE}
    SELECT series_id, scenario_id, count(*) FILTER (WHERE y < 5 - 1e-9 OR y > 120 + 1e-9) AS violation_count,
      {sql_round('nullif(greatest(max(5 - y), 0), 0)')} AS under, {sql_round('nullif(greatest(max(y - 120), 0), 0)')} AS over
    FROM cell GROUP BY series_id, scenario_id""",
)
def envelope_check_given_bounds(spark, sf_dir):
    rows = cells(spark, sf_dir)
    scen = series_scenarios(rows, FIXED)
    bounds = rows.groupBy("sensor").agg(F.lit(5.0).alias("low"), F.lit(120.0).alias("high"))
    out = injection.check_envelope(rows, scen, injection.scenario_deltas(scen, random=False), bounds)
    return out.select(
        "series_id", "scenario_id", "violation_count",
        rnd(F.try_element_at("min_violations", F.lit("value"))).alias("under"),
        rnd(F.try_element_at("max_violations", F.lit("value"))).alias("over"),
    )


@query(
    "first_valid_onset",
    f"""WITH {SERIES_SQL}, {scenarios_sql(['step', 'ramp', 'trapezoid'], 8)},
    cand AS (SELECT c.* EXCLUDE (onset), unnest(range(5, n - d)) AS onset FROM scen c JOIN lens USING (series_id)),
    steps AS (SELECT *, {WAVE_SQL} AS delta FROM (SELECT *, unnest(range(d)) AS i FROM cand)),
    ok AS (SELECT st.series_id, scenario_id, st.onset FROM steps st JOIN series s ON s.series_id = st.series_id AND s.t = st.onset + st.i
      GROUP BY ALL HAVING bool_and(s.value + delta BETWEEN 0 - 1e-9 AND 90 + 1e-9))
    SELECT c.series_id, c.scenario_id, min(ok.onset) AS onset FROM scen c LEFT JOIN ok ON ok.scenario_id = c.scenario_id GROUP BY ALL""",
)
def first_valid_onset(spark, sf_dir):
    rows = cells(spark, sf_dir)
    shapes = series_scenarios(rows, ["step", "ramp", "trapezoid"], 8).drop("onset").join(lengths(rows), "series_id")
    bounds = rows.groupBy("sensor").agg(F.lit(0.0).alias("low"), F.lit(90.0).alias("high"))
    out = injection.first_valid_onset(rows, shapes, bounds, 5, F.col("n") - F.col("duration"))
    return out.select("series_id", "scenario_id", "onset")


@query(
    "scenario_ledger",
    f"""WITH {SERIES_SQL}, {scenarios_sql(FIXED)}, {STEPS_SQL}
    SELECT st.series_id, st.scenario_id, family, 'value' AS target_channels, 1 AS target_channel_count, any_value(onset) AS onset,
      any_value(d) AS duration, any_value(a) AS amplitude, '{{}}' AS parameters, {sql_round('sqrt(sum(delta * delta))')} AS l2_norm,
      {sql_round('max(abs(delta))')} AS max_abs_delta, {sql_round('count(*) / any_value(n)')} AS support_fraction
    FROM steps st JOIN lens l ON l.series_id = st.series_id GROUP BY st.series_id, st.scenario_id, family""",
)
def scenario_ledger(spark, sf_dir):
    rows = cells(spark, sf_dir)
    scen = series_scenarios(rows, FIXED)
    out = injection.scenario_ledger(scen, injection.scenario_deltas(scen, random=False), lengths(rows), 1)
    return rounded(out, "l2_norm", "max_abs_delta", "support_fraction")


@query(
    "rejected_scenarios",
    f"""WITH {SERIES_SQL}, {LENGTHS_SQL}
    SELECT series_id, series_id || '_late' AS scenario_id, 'interval leaves the series' AS reason FROM lens
    UNION ALL SELECT series_id, series_id || '_odd', 'unknown family' FROM lens
    UNION ALL SELECT series_id, series_id || '_twice', 'duplicate sensors' FROM lens""",
)
def rejected_scenarios(spark, sf_dir):
    rows = cells(spark, sf_dir)
    base = series_scenarios(rows, ["step"], 8)
    name = F.col("series_id").cast("string")
    bad = (
        base.unionByName(base.withColumns({"scenario_id": F.concat(name, F.lit("_late")), "duration": F.col("onset") * 3 + 3}))
        .unionByName(base.withColumns({"scenario_id": F.concat(name, F.lit("_odd")), "family": F.lit("sawtooth")}))
        .unionByName(
            base.withColumns({"scenario_id": F.concat(name, F.lit("_twice")), "sensors": F.array(F.lit("value"), F.lit("value"))})
        )
    )
    return injection.rejected_scenarios(bad, lengths(rows), ["value"])


REGIME_SQL = f"""
dfit AS (SELECT series_id, quantile_cont(abs(d), 1.0 / 3) AS q1, quantile_cont(abs(d), 2.0 / 3) AS q2 FROM (
  SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS d FROM split WHERE split = 'train') GROUP BY series_id),
prev AS (SELECT series_id, max_by(value, t) AS v FROM split WHERE split = 'train' GROUP BY series_id),
blk AS (SELECT s.series_id, s.t - n // 2 AS t, s.value, n - n // 2 AS m,
  abs(s.value - coalesce(lag(s.value) OVER (PARTITION BY s.series_id ORDER BY s.t), p.v)) AS d
  FROM split s JOIN prev p ON p.series_id = s.series_id WHERE split <> 'train'),
reg AS (SELECT blk.*, CASE WHEN d < q1 THEN 'low_dynamics' WHEN d < q2 THEN 'medium_dynamics' ELSE 'high_dynamics' END AS regime
  FROM blk JOIN dfit USING (series_id))"""


def classified(spark, sf_dir):
    """Regime of every row of the second half of each series, ``t`` from 0."""
    rows = views.split_series(spark, sf_dir)
    train = rows.filter("split = 'train'")
    cutoffs = injection.regime_cutoffs(train, ["series_id"], "value")
    last = train.groupBy("series_id").agg(F.max_by("value", "t").alias("previous"))
    half = F.floor(F.col("n") / 2)
    block = rows.filter("split <> 'train'").withColumns({"t": F.col("t") - half, "n": F.col("n") - half})
    return injection.regimes(block.join(last, "series_id"), cutoffs, ["series_id"], "value", "previous")


@query("regimes", f"WITH {SERIES_SQL}, {REGIME_SQL} SELECT series_id, t, regime FROM reg")
def regimes(spark, sf_dir):
    return classified(spark, sf_dir).select("series_id", "t", "regime")


@query(
    "hash_ranking",
    f"""WITH {SERIES_SQL} SELECT series_id, t, rank FROM (SELECT series_id, t, row_number() OVER (
      PARTITION BY series_id ORDER BY sha256('42:' || series_id || ':' || t)) - 1 AS rank FROM series) WHERE rank < 8""",
)
def hash_ranking(spark, sf_dir):
    rows = views.user_series(spark, sf_dir)
    out = injection.hash_rank(rows, ["series_id"], 42, F.col("series_id").cast("string"), "t", 8)
    return out.select("series_id", "t", "rank")


STRATIFIED_SQL = f"""{REGIME_SQL},
  tstd AS (SELECT series_id, stddev_samp(value) AS sd FROM split WHERE split = 'train' GROUP BY series_id),
  combo AS (SELECT row_number() OVER (ORDER BY ai, di, si) - 1 AS combo, a, d, s FROM
    (VALUES (0, 0.5), (1, 1.0), (2, 2.0)) a(ai, a), (VALUES (0, 2), (1, 4)) d(di, d), (VALUES (0, 1), (1, -1)) s(si, s)),
  cand AS (SELECT r.series_id, r.t, r.regime, r.m, c.*, row_number() OVER (PARTITION BY r.series_id, c.combo, r.regime
      ORDER BY sha256('42:' || format('{{:.2f}}_{{}}_{{}}_{{}}', a::DOUBLE, c.d, s, regime) || ':' || t)) - 1 AS rank
    FROM reg r, combo c WHERE r.t + c.d <= r.m),
  rep AS (SELECT *, ((CASE regime WHEN 'low_dynamics' THEN 0 WHEN 'medium_dynamics' THEN 1 ELSE 2 END - combo) % 3 + 3) % 3 + 3 * rank AS rep FROM cand),
  grid AS (SELECT series_id, format('dev_amp{{:.2f}}_dur{{:02d}}_sign{{:+d}}_{{}}_rep{{}}', a::DOUBLE, d, s, regime, rep) AS scenario_id,
    a::DOUBLE AS amplitude_std, s AS sign, d AS duration, t AS onset, t + d AS offset_, regime, s * a * sd AS amplitude
    FROM rep JOIN tstd USING (series_id) WHERE rep < 5)"""


AMPLITUDES, DURATIONS, SIGNS, REPEATS = [0.5, 1.0, 2.0], [2, 4], [1, -1], 5


def stratified(spark, sf_dir):
    block = classified(spark, sf_dir)
    train = views.split_series(spark, sf_dir).filter("split = 'train'")
    std = train.groupBy("series_id").agg(F.stddev_samp("value").alias("train_std"))
    size = block.groupBy("series_id").agg(F.max("n").alias("n"))
    return injection.stratified_grid(
        block.select("series_id", "t", "regime"), size, 42, AMPLITUDES, DURATIONS, SIGNS, REPEATS, std
    )


@query(
    "stratified_grid",
    f"WITH {SERIES_SQL}, {STRATIFIED_SQL} SELECT series_id, scenario_id, amplitude_std, sign, duration, onset, offset_ AS offset, regime,"
    f" {sql_round('amplitude')} AS amplitude FROM grid",
)
def stratified_grid(spark, sf_dir):
    return rounded(stratified(spark, sf_dir), "amplitude")


@query(
    "grid_shortfall",
    f"""WITH {SERIES_SQL}, {STRATIFIED_SQL}, wanted AS (
      SELECT series_id, a::DOUBLE AS amplitude_std, d AS duration, s AS sign,
        ['low_dynamics', 'medium_dynamics', 'high_dynamics'][(combo + rep) % 3 + 1] AS regime, rep FROM tstd, combo, range(5) q(rep)),
    had AS (SELECT g.series_id, g.a::DOUBLE AS amplitude_std, g.d AS duration, g.s AS sign, g.regime, g.rep FROM rep g WHERE rep < 5),
    missing AS (SELECT * FROM wanted EXCEPT SELECT * FROM had),
    m AS (SELECT series_id, count(*) AS n, count(DISTINCT (amplitude_std, duration, sign, regime)) AS c FROM missing GROUP BY series_id)
    SELECT tstd.series_id, coalesce(n, 0) AS missing, coalesce(c, 0) AS short_cells FROM tstd LEFT JOIN m USING (series_id)""",
)
def grid_shortfall(spark, sf_dir):
    """Scenarios per series that the stratified grid could not place; zero means a complete grid."""
    grid = stratified(spark, sf_dir)
    series = views.split_series(spark, sf_dir).filter("split = 'train'").select("series_id").distinct()
    short = injection.grid_shortfall(grid, series, AMPLITUDES, DURATIONS, SIGNS, REPEATS)
    sums = short.groupBy("series_id").agg(F.sum("missing").alias("missing"), F.count(F.lit(1)).alias("short_cells"))
    zero = F.lit(0).cast("long")
    return series.join(sums, "series_id", "left").select(
        "series_id", F.coalesce("missing", zero).alias("missing"), F.coalesce("short_cells", zero).alias("short_cells")
    )


@query(
    "family_grid",
    f"""WITH {SERIES_SQL}, {LENGTHS_SQL}, tstd AS (SELECT series_id, stddev_samp(value) AS sd FROM split WHERE split = 'train' GROUP BY series_id),
    g AS (SELECT series_id, n, sd, f, s, [0.5, 1.0, 1.5, 2.0][s % 4 + 1]::DOUBLE AS a, [1, -1][(s // 4) % 2 + 1] AS sg, [12, 24, 48][s % 3 + 1] AS d
      FROM lens JOIN tstd USING (series_id), (VALUES ('step'), ('ramp'), ('drift'), ('pulse'), ('sinusoid')) f(f), range(10) r(s))
    SELECT series_id, format('{{}}_amp{{:.1f}}_dur{{:02d}}_sign{{:+d}}_idx{{:02d}}', f, a, d, sg, s) AS scenario_id, f AS family, d AS duration,
      24 + (37 * s) % greatest(1, n - d - 48) AS onset, {sql_round('sg * a * sd')} AS amplitude FROM g""",
)
def family_grid(spark, sf_dir):
    rows = views.split_series(spark, sf_dir)
    std = rows.filter("split = 'train'").groupBy("series_id").agg(F.stddev_samp("value").alias("train_std"))
    out = injection.family_grid(lengths(rows), std)
    return rounded(out.select("series_id", "scenario_id", "family", "duration", "onset", "amplitude"), "amplitude")

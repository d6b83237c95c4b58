"""Queries on anomaly scores, thresholds and detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import metrics, scaling, scores
from tidegauge.operators.baseline_run import run_baselines, split_features
from tidegauge.operators.ordered import longest_series, reindexed
from tidegauge.plans.registry import query, rnd, rounded, sql_round
from tidegauge.session import staged
from tidegauge.sources import views
from tidegauge.sources.views import PANEL_SENSORS, PANEL_SQL, SERIES_SQL

KEY = ["series_id"]
GUARD = "CASE WHEN {s} > 2.220446049250313e-16 THEN {s} ELSE 1.0 END"

FIT_SQL = """
fit AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM split
        WHERE split = 'train' AND label = 0 GROUP BY series_id),
z AS (SELECT p.*, f.m, f.s, (p.value - f.m) / (CASE WHEN f.s > 2.220446049250313e-16 THEN f.s ELSE 1.0 END) AS z
      FROM split p JOIN fit f ON p.series_id = f.series_id)"""


def fitted(spark, sf_dir):
    """Split series with the train-normal mean and deviation of each series and ``z``."""
    rows = views.split_series(spark, sf_dir)
    train = rows.filter("split = 'train' AND label = 0")
    params = scaling.fit_in_order(train, KEY, "value", longest_series(rows))
    z = (F.col("value") - F.col("mean_value")) / scaling.guarded_scale(F.col("std_value"))
    return rows.join(params, "series_id").withColumn("z", z)


# Imputed and standardised panel, as features for the multivariate scores.
PANEL_Z_SQL = (
    PANEL_SQL
    + ", med AS (SELECT "
    + ", ".join(f"quantile_cont({s}, 0.5) AS {s}" for s in PANEL_SENSORS)
    + " FROM panel WHERE split = 'train' AND label = 0), filled AS (SELECT t, split, label, "
    + ", ".join(f"coalesce(p.{s}, m.{s}) AS {s}" for s in PANEL_SENSORS)
    + " FROM panel p, med m), pfit AS (SELECT "
    + ", ".join(f"avg({s}) AS m_{s}, stddev_pop({s}) AS s_{s}" for s in PANEL_SENSORS)
    + " FROM filled WHERE split = 'train' AND label = 0), pz AS (SELECT t, split, label, "
    + ", ".join(f"({s} - m_{s}) / ({GUARD.format(s='s_' + s)}) AS {s}" for s in PANEL_SENSORS)
    + " FROM filled, pfit)"
)


def panel_z(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    train = "split = 'train' AND label = 0"
    filled, cols = scaling.prepare_features(panel, panel.filter(train), KEY, PANEL_SENSORS)
    return scaling.apply_scaler(filled, scaling.fit_scaler(filled.filter(train), KEY, cols), KEY, cols)


@query(
    "cusum_statistic",
    f"""WITH {SERIES_SQL}, {FIT_SQL},
    c AS (SELECT series_id, t, s, sum(value - m - 0.5 * s) OVER (PARTITION BY series_id ORDER BY t) AS c FROM z)
    SELECT series_id, t, {sql_round('stat', 4)} AS s, stat > 5 * s AS alarm FROM (
      SELECT series_id, t, s, c - least(0, min(c) OVER (PARTITION BY series_id ORDER BY t)) AS stat FROM c)""",
)
def cusum_statistic(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    std = F.col("std_value")
    out = scores.cusum(rows, KEY, F.col("value"), F.col("mean_value"), 0.5 * std, 5 * std)
    return rounded(out.select("series_id", "t", "s", "alarm"), "s", digits=4)


_RESET = """r AS (
      SELECT series_id, t, greatest(0, d) AS before, h FROM d WHERE t = 0
      UNION ALL
      SELECT d.series_id, d.t, greatest(0, (CASE WHEN r.before > r.h THEN 0 ELSE r.before END) + d.d), d.h
      FROM r JOIN d ON d.series_id = r.series_id AND d.t = r.t + 1)"""


@query(
    "cusum_with_reset",
    f"""WITH RECURSIVE {SERIES_SQL}, {FIT_SQL},
    d AS (SELECT series_id, t, value - m - 0.5 * s AS d, 2 * s AS h FROM z), {_RESET}
    SELECT series_id, t, {sql_round('before', 4)} AS stat_before,
           {sql_round('CASE WHEN before > h THEN 0 ELSE before END', 4)} AS stat_after, before > h AS alarm FROM r""",
)
def cusum_with_reset(spark, sf_dir):
    rows = fitted(spark, sf_dir).withColumns(
        {"k": 0.5 * F.col("std_value"), "h": 2 * F.col("std_value")}
    )
    out = scores.cusum_reset(rows, KEY, "value", "mean_value", "k", "h")
    return rounded(out, "stat_before", "stat_after", digits=4)


_SIDES = [(s, g) for s in PANEL_SENSORS for g in ("", "-")]


def _panel_cusum_sql(slack: float) -> str:
    sums = ", ".join(
        f"sum({g}{s} - {slack}) OVER (ORDER BY t) AS c{i}" for i, (s, g) in enumerate(_SIDES)
    )
    best = ", ".join(
        f"c{i} - least(0, min(c{i}) OVER (ORDER BY t))" for i in range(len(_SIDES))
    )
    return f"cs AS (SELECT t, {sums} FROM pz), cusum AS (SELECT t, greatest({best}) AS cusum FROM cs)"


@query(
    "cusum_score",
    f"WITH {PANEL_Z_SQL}, {_panel_cusum_sql(0.5)} SELECT t, {sql_round('cusum')} AS cusum FROM cusum",
)
def cusum_score(spark, sf_dir):
    out = scores.cusum_score(panel_z(spark, sf_dir), KEY, PANEL_SENSORS, 0.5)
    return rounded(out.select("t", "cusum"), "cusum")


_STATES = ", ".join(f"s{i}" for i in range(len(_SIDES)))
_FIRST = ", ".join(f"greatest(0.0, {g}{s} - 0.5) AS s{i}" for i, (s, g) in enumerate(_SIDES))
_NEXT = ", ".join(
    f"greatest(0.0, (CASE WHEN greatest({_STATES}) > 3.0 THEN 0.0 ELSE s{i} END) + ({g}pz.{s}) - 0.5)"
    for i, (s, g) in enumerate(_SIDES)
)


@query(
    "cusum_score_with_reset",
    f"""WITH RECURSIVE {PANEL_Z_SQL}, r AS (
      SELECT t, {_FIRST} FROM pz WHERE t = 0
      UNION ALL SELECT pz.t, {_NEXT} FROM r JOIN pz ON pz.t = r.t + 1)
      SELECT t, {sql_round(f'greatest({_STATES})')} AS cusum FROM r""",
)
def cusum_score_with_reset(spark, sf_dir):
    rows = panel_z(spark, sf_dir).withColumn("reset", F.lit(3.0))
    out = scores.cusum_score_reset(rows, KEY, PANEL_SENSORS, "reset")
    return rounded(out.select("t", "cusum"), "cusum")


@query(
    "ewma_score",
    f"WITH {PANEL_Z_SQL}, e AS (SELECT a.t, "
    + ", ".join(f"sum(0.2 * pow(0.8, a.t - b.t) * b.{s}) AS {s}" for s in PANEL_SENSORS)
    + f" FROM pz a JOIN pz b ON b.t <= a.t GROUP BY a.t) SELECT t, "
    + sql_round("greatest(" + ", ".join(f"abs({s})" for s in PANEL_SENSORS) + ")")
    + " AS ewma FROM e",
)
def ewma_score(spark, sf_dir):
    out = scores.ewma_score(panel_z(spark, sf_dir), KEY, PANEL_SENSORS, 0.2)
    return rounded(out.select("t", "ewma"), "ewma")


# The projector on the first axis is the limit of the repeatedly squared Gram
# matrix, which SQL reaches without a decomposition.
def _projector_sql(source: str, names: list[str], where: str = "TRUE", squarings: int = 45) -> str:
    gram = (
        "["
        + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in names) + "]" for a in names)
        + "]"
    )
    n = len(names)
    return f"""gram AS (SELECT {gram} AS g FROM {source} WHERE {where}),
    sq AS (SELECT 0 AS k, g FROM gram UNION ALL
      SELECT k + 1, list_transform(m, lambda row: list_transform(row, lambda v: v / list_sum([m[i][i] for i in range(1, {n + 1})])))
      FROM (SELECT k, list_transform(g, lambda a: list_transform(g, lambda b: list_dot_product(a, b))) AS m FROM sq)
      WHERE k < {squarings}),
    proj AS (SELECT list_transform(g, lambda row: list_transform(row, lambda v: v / list_sum([g[i][i] for i in range(1, {n + 1})]))) AS p
             FROM sq WHERE k = {squarings})"""


def _spe_sql(names: list[str], alias: str = "x") -> str:
    x = "[" + ", ".join(f"{alias}.{s}" for s in names) + "]"
    return (
        f"list_dot_product({x}, {x}) - list_dot_product({x}, list_transform(p, lambda row: list_dot_product(row, {x})))"
    )


@query(
    "pca_residual_energy",
    f"WITH RECURSIVE {PANEL_Z_SQL}, {_projector_sql('pz', PANEL_SENSORS, 'split = ' + repr('train') + ' AND label = 0')}"
    f" SELECT x.t, {sql_round(_spe_sql(PANEL_SENSORS), 5)} AS pca_spe FROM pz x, proj",
)
def pca_residual_energy(spark, sf_dir):
    rows = panel_z(spark, sf_dir)
    axes = scores.principal_axes(rows.filter("split = 'train' AND label = 0"), PANEL_SENSORS, 1)
    return rounded(scores.spe_score(rows, PANEL_SENSORS, axes).select("t", "pca_spe"), "pca_spe", digits=5)


@query("pca_residual_energy_vectors")
def pca_residual_energy_vectors(spark, sf_dir):
    """Ten axes of the 64-sensor series; the SQL twin would need a decomposition."""
    rows = views.vectors(spark, sf_dir)
    cols = [c for c in rows.columns if c.startswith("v")]
    half = rows.agg(F.max("t").alias("_top"))
    train = rows.join(F.broadcast(half)).filter("t * 2 <= _top").drop("_top")  # one row
    params = scaling.fit_scaler(train, KEY, cols)
    axes = scores.principal_axes(scaling.apply_scaler(train, params, KEY, cols), cols, 10)
    z = scaling.apply_scaler(rows, params, KEY, cols)
    return rounded(scores.spe_score(z, cols, axes).select("t", "pca_spe"), "pca_spe", digits=4)


@query(
    "score_pack",
    f"WITH RECURSIVE {PANEL_Z_SQL}, {_projector_sql('pz', PANEL_SENSORS, 'split = ' + repr('train') + ' AND label = 0')}"
    f", {_panel_cusum_sql(0.5)}, e AS (SELECT a.t, "
    + ", ".join(f"sum(0.2 * pow(0.8, a.t - b.t) * b.{s}) AS {s}" for s in PANEL_SENSORS)
    + f" FROM pz a JOIN pz b ON b.t <= a.t GROUP BY a.t) SELECT x.t, {sql_round('c.cusum')} AS cusum, "
    + sql_round("greatest(" + ", ".join(f"abs(e.{s})" for s in PANEL_SENSORS) + ")")
    + f" AS ewma, {sql_round(_spe_sql(PANEL_SENSORS), 5)} AS pca_spe"
    " FROM pz x JOIN cusum c ON c.t = x.t JOIN e ON e.t = x.t, proj",
)
def score_pack(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    train = "split = 'train' AND label = 0"
    filled, cols = scaling.prepare_features(panel, panel.filter(train), KEY, PANEL_SENSORS)
    out = scores.baseline_scores(filled.filter(train), filled, KEY, cols)
    return rounded(rounded(out.select("t", "cusum", "ewma", "pca_spe"), "cusum", "ewma"), "pca_spe", digits=5)


_DIFFS = ", ".join(f"{s} - coalesce(lag({s}) OVER (ORDER BY t), {s}) AS {s}" for s in PANEL_SENSORS)


@query(
    "residual_score_pack",
    f"WITH RECURSIVE {PANEL_Z_SQL}, diff AS (SELECT t, split, {_DIFFS} FROM filled), dfit AS (SELECT "
    + ", ".join(f"avg({s}) AS m_{s}, stddev_pop({s}) AS s_{s}" for s in PANEL_SENSORS)
    + " FROM diff WHERE split = 'train'), dz AS (SELECT t, split, "
    + ", ".join(f"({s} - m_{s}) / ({GUARD.format(s='s_' + s)}) AS {s}" for s in PANEL_SENSORS)
    + " FROM diff, dfit)"
    + f", {_projector_sql('dz', PANEL_SENSORS, 'split = ' + repr('train'))}, "
    + _panel_cusum_sql(0.5).replace("FROM pz", "FROM dz")
    + ", e AS (SELECT a.t, "
    + ", ".join(f"sum(0.2 * pow(0.8, a.t - b.t) * b.{s}) AS {s}" for s in PANEL_SENSORS)
    + f" FROM dz a JOIN dz b ON b.t <= a.t GROUP BY a.t) SELECT x.t, {sql_round('c.cusum')} AS residual_cusum, "
    + sql_round("greatest(" + ", ".join(f"abs(e.{s})" for s in PANEL_SENSORS) + ")")
    + f" AS residual_ewma, {sql_round(_spe_sql(PANEL_SENSORS), 5)} AS residual_pca_spe"
    " FROM dz x JOIN cusum c ON c.t = x.t JOIN e ON e.t = x.t, proj",
)
def residual_score_pack(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    filled, cols = scaling.prepare_features(
        panel, panel.filter("split = 'train' AND label = 0"), KEY, PANEL_SENSORS
    )
    out = scores.residual_baseline_scores(filled.filter("split = 'train'"), filled, KEY, cols)
    out = rounded(out, "residual_cusum", "residual_ewma")
    return rounded(
        out.select("t", "residual_cusum", "residual_ewma", "residual_pca_spe"), "residual_pca_spe", digits=5
    )


@query(
    "adaptive_cusum",
    f"""WITH RECURSIVE {SERIES_SQL}, {FIT_SQL},
    cfg AS (SELECT * FROM (VALUES (1.6), (2.0)) a(gate), (VALUES (0.01), (0.05)) b(alpha)),
    d AS (SELECT series_id, t, value AS y, m, s, gate::DOUBLE AS gate, alpha::DOUBLE AS alpha FROM z, cfg),
    r AS (
      SELECT series_id, gate, alpha, t, s, mu, greatest(0.0, y - mu - 0.5 * s) AS before FROM (
        SELECT *, CASE WHEN abs(y - m) <= gate * s THEN m + alpha * (y - m) ELSE m END AS mu FROM d WHERE t = 0)
      UNION ALL
      SELECT series_id, gate, alpha, t, s, mu, greatest(0.0, (CASE WHEN before > 5 * s THEN 0 ELSE before END) + y - mu - 0.5 * s) FROM (
        SELECT d.series_id, d.gate, d.alpha, d.t, d.s, d.y, r.before,
               CASE WHEN abs(d.y - r.mu) <= d.gate * d.s THEN r.mu + d.alpha * (d.y - r.mu) ELSE r.mu END AS mu
        FROM r JOIN d ON d.series_id = r.series_id AND d.gate = r.gate AND d.alpha = r.alpha AND d.t = r.t + 1))
    SELECT series_id, gate, alpha, t, {sql_round('mu', 8)} AS mu, {sql_round('before', 8)} AS stat_before, before > 5 * s AS alarm FROM r""",
)
def adaptive_cusum(spark, sf_dir):
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(g).alias("gate"), F.lit(a).alias("alpha"))
                for g in (1.6, 2.0) for a in (0.01, 0.05)
            ]
        )
    )
    rows = fitted(spark, sf_dir).withColumn("_cfg", grid).select("*", "_cfg.*").drop("_cfg")
    out = scores.adaptive_cusum(
        rows, ["series_id", "gate", "alpha"], "value", "mean_value", "std_value", "gate", "alpha"
    )
    return rounded(out, "mu", "stat_before", digits=8)


_SENSOR_EVENTS_SQL = f"""
long AS ({' UNION ALL '.join(f"SELECT '{s}' AS series_id, t, {s} - 0.25 AS d, 1.5 AS h FROM pz" for s in PANEL_SENSORS)}),
d AS (SELECT * FROM long), {_RESET},
ev AS (SELECT series_id AS sensor, t FROM r WHERE before > h)"""


def panel_events(spark, sf_dir):
    """Alarm events ``(series_id, sensor, t)`` of one reset CUSUM per panel sensor."""
    long = panel_z(spark, sf_dir).unpivot(["series_id", "t"], PANEL_SENSORS, "sensor", "z")
    long = long.withColumns({"mu0": F.lit(0.0), "k": F.lit(0.25), "h": F.lit(1.5)})
    out = scores.cusum_reset(long, ["series_id", "sensor"], "z", "mu0", "k", "h")
    return out.filter("alarm").select("series_id", "sensor", "t")


@query(
    "consensus_alarm",
    f"""WITH RECURSIVE {PANEL_Z_SQL}, {_SENSOR_EVENTS_SQL},
    act AS (SELECT p.t, count(DISTINCT ev.sensor) AS k FROM pz p LEFT JOIN ev ON p.t >= ev.t AND p.t < ev.t + 5 GROUP BY p.t)
    SELECT t, CASE WHEN k >= 2 THEN 1 ELSE 0 END AS alarm FROM act""",
)
def consensus_alarm(spark, sf_dir):
    index = views.hour_panel(spark, sf_dir).select("series_id", "t")
    return scores.consensus_alarm(panel_events(spark, sf_dir), index, KEY, 2, 5).select("t", "alarm")


@query(
    "consensus_config_pick",
    f"""WITH RECURSIVE {PANEL_Z_SQL}, {_SENSOR_EVENTS_SQL},
    cfg AS (SELECT * FROM (VALUES (1), (2), (3)) a(k), (VALUES (3), (5), (10)) b(c)),
    act AS (SELECT p.t, p.label, k, c, count(DISTINCT ev.sensor) AS on_ FROM pz p CROSS JOIN cfg
            LEFT JOIN ev ON p.t >= ev.t AND p.t < ev.t + c GROUP BY ALL),
    rates AS (SELECT k AS min_sensors, c AS cooldown,
       count(*) FILTER (WHERE label = 0 AND on_ >= k) / count(*) FILTER (WHERE label = 0) AS fpr,
       count(*) FILTER (WHERE label = 1 AND on_ >= k) / count(*) FILTER (WHERE label = 1) AS tpr FROM act GROUP BY k, c)
    SELECT min_sensors, cooldown, {sql_round('fpr')} AS fpr, {sql_round('tpr')} AS tpr FROM (
      SELECT *, fpr <= 0.01 AND tpr >= 0.9 AS ok,
        sqrt(pow(greatest(fpr - 0.01, 0) / 0.01, 2) + pow(greatest(0.9 - tpr, 0) / 0.9, 2)) AS dist FROM rates)
    ORDER BY ok DESC, CASE WHEN ok THEN fpr ELSE dist END, min_sensors, cooldown LIMIT 1""",
)
def consensus_config_pick(spark, sf_dir):
    events, index = panel_events(spark, sf_dir), views.hour_panel(spark, sf_dir).select("series_id", "t", "label")
    configs = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("min_sensors"), F.lit(c).alias("cooldown"))
                for k in (1, 2, 3) for c in (3, 5, 10)
            ]
        )
    )
    active = (
        events.withColumn("_c", configs).select("*", "_c.*")
        .withColumn("t", F.explode(F.sequence("t", F.col("t") + F.col("cooldown") - 1)))
        .groupBy("series_id", "min_sensors", "cooldown", "t")
        .agg(F.count_distinct("sensor").alias("_sensors"))
    )
    rows = index.withColumn("_c", configs).select("*", "_c.*").drop("_c")
    judged = rows.join(active, ["series_id", "min_sensors", "cooldown", "t"], "left").withColumn(
        "pred", (F.coalesce("_sensors", F.lit(0)) >= F.col("min_sensors")).cast("int")
    )
    rates = metrics.point_rates(judged, ["min_sensors", "cooldown"]).withColumnsRenamed(
        {"point_fpr": "fpr", "point_tpr": "tpr"}
    )
    best = metrics.pick_config(rates, ["min_sensors", "cooldown"])
    return rounded(best.select("min_sensors", "cooldown", "fpr", "tpr"), "fpr", "tpr")


@query(
    "forecast_residual_score",
    f"WITH {PANEL_Z_SQL} SELECT t, "
    + sql_round(
        "greatest(" + ", ".join(f"abs(({s} - coalesce(lag({s}) OVER (ORDER BY t), {s})) / s_{s})" for s in PANEL_SENSORS) + ")"
    )
    + " AS score FROM filled, pfit",
)
def forecast_residual_score(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    train = "split = 'train' AND label = 0"
    filled, cols = scaling.prepare_features(panel, panel.filter(train), KEY, PANEL_SENSORS)
    long = filled.unpivot(["series_id", "t", "split", "label"], cols, "sensor", "value")
    fit = long.filter(train).groupBy("series_id", "sensor").agg(F.stddev_pop("value").alias("scale"))
    diffs = scaling.persistence_residual(long, ["series_id", "sensor"], ["value"], prefix="d_")
    predicted = diffs.withColumn("prediction", F.col("value") - F.col("d_value"))
    out = scores.residual_score(
        predicted.join(fit, ["series_id", "sensor"]), KEY, "value", "prediction", "scale"
    )
    return rounded(out.select("t", "score"), "score")


@query(
    "shift_estimate",
    f"""WITH {SERIES_SQL}, {FIT_SQL} SELECT series_id, {sql_round('avg(value - m)')} AS shift FROM z
    WHERE t >= n // 2 AND t < n // 2 + 10 GROUP BY series_id""",
)
def shift_estimate(spark, sf_dir):
    out = scores.shift_estimate(
        fitted(spark, sf_dir), KEY, "value", F.col("mean_value"), F.floor(F.col("n") / 2), 10
    )
    return rounded(out, "shift")


@query(
    "shift_fraction",
    f"""WITH {SERIES_SQL}, {FIT_SQL}, x AS (SELECT series_id, avg(z) AS x FROM z WHERE split = 'test' AND label = 0 AND s > 1e-12 GROUP BY series_id)
    SELECT count(*) AS valid_sensors, {sql_round('avg(CASE WHEN abs(x) > 0.5 THEN 1.0 ELSE 0.0 END)')} AS shift_fraction FROM x""",
)
def shift_fraction(spark, sf_dir):
    rows = views.split_series(spark, sf_dir).withColumn("dataset", F.lit("events"))
    normal = rows.filter("label = 0")
    out = scores.shift_fraction(
        normal.filter("split = 'train'"), normal.filter("split = 'test'"), ["dataset"], "series_id", "value"
    )
    return rounded(out.select("valid_sensors", "shift_fraction"), "shift_fraction")


_SUPPORT_SQL = """
act AS (SELECT *, abs(z) >= 0.5 AS on_ FROM z),
st AS (SELECT *, CASE WHEN on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY series_id ORDER BY t), FALSE) THEN 1 ELSE 0 END AS st FROM act),
run AS (SELECT *, sum(st) OVER (PARTITION BY series_id ORDER BY t) AS run FROM st),
kept AS (SELECT series_id, run FROM run WHERE on_ GROUP BY series_id, run HAVING count(*) >= 2 AND max(abs(z)) >= 1.5),
sup AS (SELECT r.*, r.on_ AND k.run IS NOT NULL AS support FROM run r LEFT JOIN kept k ON k.series_id = r.series_id AND k.run = r.run)"""


@query(
    "hysteresis_support",
    f"WITH {SERIES_SQL}, {FIT_SQL}, {_SUPPORT_SQL} SELECT series_id, t, support,"
    f" {sql_round('CASE WHEN support THEN value - m ELSE 0 END')} AS delta_hat FROM sup",
)
def hysteresis_support(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    out = scores.temporal_support(rows, KEY, F.col("z"), F.lit(1.5), F.lit(0.5), 2)
    delta = F.when(F.col("support"), F.col("value") - F.col("mean_value")).otherwise(0.0)
    return out.select("series_id", "t", "support", rnd(delta).alias("delta_hat"))


@query(
    "pointwise_threshold",
    f"WITH {SERIES_SQL}, {FIT_SQL} SELECT series_id, t,"
    f" {sql_round('CASE WHEN abs((value - m) / s) >= 1.5 THEN value - m ELSE 0 END')} AS delta_hat FROM z",
)
def pointwise_threshold(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    delta = scores.threshold_delta(F.col("value") - F.col("mean_value"), F.col("std_value"), F.lit(1.5))
    return rows.select("series_id", "t", rnd(delta).alias("delta_hat"))


# ------------------------------------------------------------------ thresholds
_BLOCKED = """
val AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS vt FROM {src} WHERE split = 'val' AND label = 0),
blk AS (SELECT *, ntile(3) OVER (PARTITION BY series_id ORDER BY vt) AS b FROM val),
thr AS (SELECT series_id, max(q) AS threshold FROM (
  SELECT series_id, b, quantile_cont({score}, 0.9) AS q FROM blk GROUP BY series_id, b) GROUP BY series_id)"""


def series_scores(spark, sf_dir):
    """Long scores of every user series: raw value and distance from the train mean."""
    rows = fitted(spark, sf_dir).filter("split = 'test' OR (split = 'val' AND label = 0)")
    rows = reindexed(rows, ["series_id", "split"])
    return rows.withColumn("distance", F.abs("z")).unpivot(
        ["series_id", "split", "t", "label"], ["value", "distance"], "baseline", "score"
    )


@query(
    "blocked_threshold",
    f"WITH {SERIES_SQL}, {_BLOCKED.format(src='split', score='value')} SELECT series_id, {sql_round('threshold')} AS threshold FROM thr",
)
def blocked_threshold(spark, sf_dir):
    val = reindexed(views.split_series(spark, sf_dir).filter("split = 'val' AND label = 0"), KEY)
    return rounded(metrics.blocked_threshold(val, KEY, 0.9, 3, "value"), "threshold")


@query(
    "sensor_thresholds",
    f"WITH {SERIES_SQL}, {FIT_SQL} SELECT series_id, {sql_round('quantile_cont(abs(value - m) / s, 0.95)')} AS threshold FROM z WHERE t < 20 GROUP BY series_id",
)
def sensor_thresholds(spark, sf_dir):
    out = metrics.sensor_thresholds(
        fitted(spark, sf_dir), KEY, F.col("value") - F.col("mean_value"), F.col("std_value"), 20, 0.95
    )
    return rounded(out, "threshold")


_PRED = "CASE WHEN value > 80 THEN 1 ELSE 0 END"


def predicted_series(spark, sf_dir):
    return views.user_series(spark, sf_dir).withColumn("pred", (F.col("value") > 80).cast("int"))


_RATES = f"""coalesce(count(*) FILTER (WHERE label = 0 AND pred = 1) / nullif(count(*) FILTER (WHERE label = 0), 0), 0) AS point_fpr,
 coalesce(count(*) FILTER (WHERE label = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 0) AS point_tpr"""


@query(
    "point_rates",
    f"""WITH {SERIES_SQL}, p AS (SELECT *, {_PRED} AS pred FROM series), r AS (SELECT series_id, {_RATES} FROM p GROUP BY series_id)
    SELECT series_id, {sql_round('point_fpr')} AS point_fpr, {sql_round('point_tpr')} AS point_tpr FROM r""",
)
def point_rates(spark, sf_dir):
    return rounded(metrics.point_rates(predicted_series(spark, sf_dir), KEY), "point_fpr", "point_tpr")


@query(
    "estimation_error",
    f"""WITH {SERIES_SQL}, {FIT_SQL}, hit AS (SELECT series_id, n // 2 AS attacked, min(t) FILTER (WHERE z > 1.5) AS detected FROM z GROUP BY series_id, n)
    SELECT z.series_id, {sql_round('avg((m - value) * (m - value))', 4)} AS mse, {sql_round('avg(m - value)', 4)} AS bias, max(detected - attacked) AS delay
    FROM z JOIN hit h ON h.series_id = z.series_id GROUP BY z.series_id""",
)
def estimation_error(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    error = metrics.estimation_error(rows, KEY, "mean_value", "value")
    attacked = F.floor(F.col("n") / 2)
    hits = rows.groupBy("series_id", "n").agg(F.min(F.when(F.col("z") > 1.5, F.col("t"))).alias("first"))
    delays = hits.select("series_id", metrics.detection_delay(F.col("first"), attacked).alias("delay"))
    return rounded(error.join(delays, "series_id"), "mse", "bias", digits=4)


_EVENTS = """
st AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY {k} ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS st FROM {src}),
run AS (SELECT *, sum(st) OVER (PARTITION BY {k} ORDER BY t) AS run FROM st),
ev AS (SELECT {k}, run, min(t) FILTER (WHERE pred = 1) - min(t) AS delay FROM run WHERE label = 1 GROUP BY {k}, run),
evm AS (SELECT {k}, count(*) AS n_events, count(delay) AS detected_events, count(delay) / count(*) AS event_recall,
        quantile_cont(delay, 0.5) AS median_detection_delay FROM ev GROUP BY {k})"""


@query(
    "event_metrics",
    f"""WITH {SERIES_SQL}, p AS (SELECT *, {_PRED} AS pred FROM series), {_EVENTS.format(k='series_id', src='p')}
    SELECT s.series_id, coalesce(n_events, 0) AS n_events, coalesce(detected_events, 0) AS detected_events,
      {sql_round('coalesce(event_recall, 0)')} AS event_recall, {sql_round('median_detection_delay')} AS median_detection_delay
    FROM (SELECT DISTINCT series_id FROM series) s LEFT JOIN evm ON evm.series_id = s.series_id""",
)
def event_metrics(spark, sf_dir):
    out = metrics.event_metrics(predicted_series(spark, sf_dir), KEY)
    return rounded(out, "event_recall", "median_detection_delay")


_SUMMARY_SQL = f"""
scored AS (SELECT series_id, split, t, label, value AS score, 'value' AS baseline FROM z WHERE split = 'test' OR (split = 'val' AND label = 0)
  UNION ALL SELECT series_id, split, t, label, abs(z), 'distance' FROM z WHERE split = 'test' OR (split = 'val' AND label = 0)),
blk AS (SELECT *, ntile(3) OVER (PARTITION BY series_id, baseline ORDER BY t) AS b FROM scored WHERE split = 'val'),
thr AS (SELECT series_id, baseline, max(q) AS threshold FROM (
  SELECT series_id, baseline, b, quantile_cont(score, 0.9) AS q FROM blk GROUP BY ALL) GROUP BY ALL),
p AS (SELECT s.*, threshold, CASE WHEN score > threshold THEN 1 ELSE 0 END AS pred FROM scored s JOIN thr USING (series_id, baseline) WHERE split = 'test'),
r AS (SELECT series_id, baseline, max(threshold) AS threshold, {_RATES} FROM p GROUP BY series_id, baseline),
{_EVENTS.format(k='series_id, baseline', src='p')}"""


@query(
    "score_summary",
    f"""WITH {SERIES_SQL}, {FIT_SQL}, {_SUMMARY_SQL}, dist AS (
      SELECT series_id, baseline, quantile_cont(score, 0.5) FILTER (WHERE split = 'val') AS validation_median,
        quantile_cont(score, 0.5) FILTER (WHERE split = 'test' AND label = 0) AS test_normal_median,
        quantile_cont(score, 0.99) FILTER (WHERE split = 'test' AND label = 0) AS test_normal_q99 FROM scored GROUP BY ALL)
    SELECT r.series_id, r.baseline, {sql_round('threshold', 5)} AS threshold, {sql_round('point_fpr')} AS point_fpr, {sql_round('point_tpr')} AS point_tpr,
      coalesce(n_events, 0) AS n_events, coalesce(detected_events, 0) AS detected_events,
      {sql_round('coalesce(event_recall, 0)')} AS event_recall, {sql_round('median_detection_delay')} AS median_detection_delay,
      {sql_round('validation_median', 5)} AS validation_median, {sql_round('test_normal_median', 5)} AS test_normal_median,
      {sql_round('test_normal_q99', 5)} AS test_normal_q99
    FROM r LEFT JOIN evm ON evm.series_id = r.series_id AND evm.baseline = r.baseline
      LEFT JOIN dist ON dist.series_id = r.series_id AND dist.baseline = r.baseline""",
)
def score_summary(spark, sf_dir):
    out = metrics.summarize_scores(series_scores(spark, sf_dir), ["series_id", "baseline"], 0.9, 3)
    out = rounded(out, "point_fpr", "point_tpr", "event_recall", "median_detection_delay")
    return rounded(out, "threshold", "validation_median", "test_normal_median", "test_normal_q99", digits=5)


@query(
    "score_distribution",
    f"""WITH {PANEL_Z_SQL}, long AS ({' UNION ALL '.join(f"SELECT '{s}' AS sensor, split, label, {s} AS score FROM pz" for s in PANEL_SENSORS)})
    SELECT sensor, {sql_round("quantile_cont(score, 0.5) FILTER (WHERE split = 'val')")} AS validation_median,
      {sql_round("quantile_cont(score, 0.5) FILTER (WHERE split = 'test' AND label = 0)")} AS test_normal_median,
      {sql_round("quantile_cont(score, 0.99) FILTER (WHERE split = 'test' AND label = 0)")} AS test_normal_q99 FROM long GROUP BY sensor""",
)
def score_distribution(spark, sf_dir):
    long = panel_z(spark, sf_dir).unpivot(["split", "label"], PANEL_SENSORS, "sensor", "score")
    out = metrics.score_distribution(long.filter("split = 'val'"), long.filter("split = 'test'"), ["sensor"])
    return rounded(out, "validation_median", "test_normal_median", "test_normal_q99")


# Flagship: one sensor per series, CUSUM and EWMA scores on raw values and differences.
_SCAN = """
parts AS (SELECT *, row_number() OVER (PARTITION BY series_id, split ORDER BY t) - 1 AS pt FROM split WHERE label = 0 OR split = 'test'),
lasts AS (SELECT series_id, split, max_by(value, pt) AS v FROM parts GROUP BY ALL),
dif AS (SELECT p.series_id, p.split, p.pt AS t, p.label, p.value,
   p.value - coalesce(lag(p.value) OVER (PARTITION BY p.series_id, p.split ORDER BY p.pt), l.v, p.value) AS d
   FROM parts p LEFT JOIN lasts l ON l.series_id = p.series_id
    AND l.split = CASE p.split WHEN 'val' THEN 'train' WHEN 'test' THEN 'val' END),
pf AS (SELECT series_id, avg(value) AS mv, stddev_pop(value) AS sv, avg(d) AS md, stddev_pop(d) AS sd FROM dif WHERE split = 'train' GROUP BY series_id),
zz AS (SELECT x.series_id, x.split, x.t, x.label, (x.value - mv) / sv AS z, (x.d - md) / sd AS r
       FROM dif x JOIN pf ON pf.series_id = x.series_id WHERE split <> 'train'),
cc AS (SELECT *, sum(z - 0.5) OVER w AS a, sum(-z - 0.5) OVER w AS b, sum(r - 0.5) OVER w AS c, sum(-r - 0.5) OVER w AS e
       FROM zz WINDOW w AS (PARTITION BY series_id, split ORDER BY t)),
cu AS (SELECT series_id, split, t, label,
         greatest(a - least(0, min(a) OVER w), b - least(0, min(b) OVER w)) AS cusum,
         greatest(c - least(0, min(c) OVER w), e - least(0, min(e) OVER w)) AS residual_cusum
       FROM cc WINDOW w AS (PARTITION BY series_id, split ORDER BY t)),
ew AS (SELECT x.series_id, x.split, x.t, abs(sum(0.2 * pow(0.8, x.t - y.t) * y.z)) AS ewma, abs(sum(0.2 * pow(0.8, x.t - y.t) * y.r)) AS residual_ewma
       FROM zz x JOIN zz y ON x.series_id = y.series_id AND x.split = y.split AND y.t <= x.t GROUP BY ALL),
sc AS (SELECT cu.*, ew.ewma, ew.residual_ewma FROM cu JOIN ew USING (series_id, split, t)),
scored AS (UNPIVOT sc ON cusum, residual_cusum, ewma, residual_ewma INTO NAME baseline VALUE score),
blk AS (SELECT *, ntile(3) OVER (PARTITION BY series_id, baseline ORDER BY t) AS b FROM scored WHERE split = 'val'),
thr AS (SELECT series_id, baseline, max(q) AS threshold FROM (
  SELECT series_id, baseline, b, quantile_cont(score, 0.9) AS q FROM blk GROUP BY ALL) GROUP BY ALL)"""


@query(
    "series_score_summary",
    f"""WITH {SERIES_SQL}, {_SCAN},
    p AS (SELECT s.*, threshold, CASE WHEN score > threshold THEN 1 ELSE 0 END AS pred FROM scored s JOIN thr USING (series_id, baseline) WHERE split = 'test'),
    r AS (SELECT series_id, baseline, max(threshold) AS threshold, {_RATES} FROM p GROUP BY series_id, baseline),
    {_EVENTS.format(k='series_id, baseline', src='p')}
    SELECT r.series_id, r.baseline, {sql_round('threshold', 5)} AS threshold, {sql_round('point_fpr')} AS point_fpr, {sql_round('point_tpr')} AS point_tpr,
      coalesce(n_events, 0) AS n_events, coalesce(detected_events, 0) AS detected_events,
      {sql_round('coalesce(event_recall, 0)')} AS event_recall, {sql_round('median_detection_delay')} AS median_detection_delay
    FROM r LEFT JOIN evm ON evm.series_id = r.series_id AND evm.baseline = r.baseline""",
)
def series_score_summary(spark, sf_dir):
    rows, cols = split_features(views.split_series(spark, sf_dir), KEY, ["value"])
    rows = staged(rows, "features")
    both = [*cols, "r_value"]
    params = scaling.fit_scaler(rows.filter("split = 'train'"), KEY, both)
    rows = scaling.apply_scaler(rows.filter("split <> 'train'"), params, KEY, both)
    part = ["series_id", "split"]
    n = longest_series(rows)
    rows = scores.cusum_score(rows, part, ["value"], out="cusum", longest=n)
    rows = scores.cusum_score(rows, part, ["r_value"], out="residual_cusum", longest=n)
    rows = scores.ewma_score(rows, part, ["value"], out="ewma", longest=n)
    rows = scores.ewma_score(rows, part, ["r_value"], out="residual_ewma", longest=n)
    names = ["cusum", "residual_cusum", "ewma", "residual_ewma"]
    long = staged(rows.unpivot([*part, "t", "label"], names, "baseline", "score"), "scores")
    out = metrics.summarize_scores(long, ["series_id", "baseline"], 0.9, 3, distribution=False)
    out = rounded(out, "point_fpr", "point_tpr", "event_recall", "median_detection_delay")
    return rounded(out, "threshold", digits=5)


@query("baseline_run")
def baseline_run(spark, sf_dir):
    """Six baselines on the panel with resetting CUSUM; checked against NumPy in the tests."""
    panel = views.hour_panel(spark, sf_dir)
    _, summary = run_baselines(panel, KEY, PANEL_SENSORS, components=3)
    names = [c for c in summary.columns if c not in ("series_id", "baseline", "n_events", "detected_events")]
    return rounded(summary, *names, digits=5)

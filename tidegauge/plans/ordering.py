"""Queries on order, scaling and feature windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import ordered, scaling
from tidegauge.plans.registry import query, rnd, rounded, sql_round
from tidegauge.sources import views
from tidegauge.sources.views import PANEL_SENSORS, PANEL_SQL, SERIES_SQL

KEY = ["series_id"]


@query(
    "row_index",
    f"WITH {SERIES_SQL} SELECT series_id, t, value, label FROM series",
)
def row_index(spark, sf_dir):
    return views.user_series(spark, sf_dir).select("series_id", "t", "value", "label")


@query(
    "row_rank",
    "SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey,"
    " l_linenumber, l_partkey, l_extendedprice) - 1 AS t, l_quantity FROM lineitem",
)
def row_rank(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    ranked = ordered.with_rank(
        lines, ["l_suppkey"], ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    )
    return ranked.select("l_suppkey", "t", "l_quantity")


_FILL = ", ".join(
    f"""{{}} coalesce(last_value("{s}" IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value("{s}" IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""".replace("{}", "")
    + f" AS \"{s}\""
    for s in PANEL_SENSORS
)


@query(
    "fill_both_ways",
    f"WITH {PANEL_SQL}, filled AS (SELECT t, {_FILL} FROM panel) SELECT t, "
    + ", ".join(f"{sql_round(s)} AS {s}" for s in PANEL_SENSORS)
    + " FROM filled",
)
def fill_both_ways(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    return rounded(
        scaling.fill_both_ways(panel, KEY, PANEL_SENSORS).select("t", *PANEL_SENSORS), *PANEL_SENSORS
    )


_EDGE = """
  last_value({s} IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
  last_value(CASE WHEN {s} IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lt,
  first_value({s} IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r,
  first_value(CASE WHEN {s} IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rt"""


@query(
    "interpolate_linear",
    f"WITH {PANEL_SQL}"
    + "".join(
        f""", edge_{s} AS (SELECT t, "{s}" AS v, {_EDGE.format(s='"' + s + '"')} FROM panel)"""
        for s in ("click", "error")
    )
    + " SELECT c.t, "
    + ", ".join(
        sql_round(f"coalesce({a}.v, {a}.l + ({a}.r - {a}.l) * (c.t - {a}.lt) / ({a}.rt - {a}.lt), {a}.l, {a}.r)")
        + f" AS {s}"
        for a, s in (("c", "click"), ("e", "error"))
    )
    + " FROM edge_click c JOIN edge_error e ON c.t = e.t",
)
def interpolate_linear(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir).select("series_id", "t", "click", "error")
    out = scaling.interpolate_linear(panel, KEY, ["click", "error"])
    return rounded(out.select("t", "click", "error"), "click", "error")


@query(
    "scaler_fit",
    f"WITH {SERIES_SQL} SELECT series_id, {sql_round('avg(value)')} AS mean_value,"
    f" {sql_round('stddev_pop(value)')} AS std_value FROM split"
    " WHERE split = 'train' AND label = 0 GROUP BY series_id",
)
def scaler_fit(spark, sf_dir):
    train = views.split_series(spark, sf_dir).filter("split = 'train' AND label = 0")
    return rounded(scaling.fit_scaler(train, KEY, ["value"]), "mean_value", "std_value")


_Z = "(s.value - f.m) / (CASE WHEN f.s > 2.220446049250313e-16 THEN f.s ELSE 1.0 END)"
_FIT = "fit AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM split WHERE split = 'train' AND label = 0 GROUP BY series_id)"


@query(
    "scaler_apply",
    f"WITH {SERIES_SQL}, {_FIT} SELECT s.series_id, s.t, {sql_round(_Z)} AS value"
    " FROM split s JOIN fit f ON s.series_id = f.series_id",
)
def scaler_apply(spark, sf_dir):
    rows = views.split_series(spark, sf_dir)
    params = scaling.fit_scaler(rows.filter("split = 'train' AND label = 0"), KEY, ["value"])
    out = scaling.apply_scaler(rows, params, KEY, ["value"])
    return rounded(out.select("series_id", "t", "value"), "value")


@query(
    "scaler_clipped",
    f"WITH {SERIES_SQL}, {_FIT} SELECT s.series_id, s.t, {sql_round(f'greatest(least({_Z}, 2.0), -2.0)')} AS value"
    " FROM split s JOIN fit f ON s.series_id = f.series_id",
)
def scaler_clipped(spark, sf_dir):
    rows = views.split_series(spark, sf_dir)
    params = scaling.fit_scaler(rows.filter("split = 'train' AND label = 0"), KEY, ["value"])
    out = scaling.apply_scaler(rows, params, KEY, ["value"], clip=2.0)
    return rounded(out.select("series_id", "t", "value"), "value")


@query(
    "scaler_inverse",
    f"WITH {SERIES_SQL} SELECT series_id, t, {sql_round('value', 4)} AS value FROM split",
)
def scaler_inverse(spark, sf_dir):
    rows = views.split_series(spark, sf_dir)
    params = scaling.fit_scaler(rows.filter("split = 'train'"), KEY, ["value"])
    z = scaling.apply_scaler(rows, params, KEY, ["value"])
    return rounded(
        scaling.invert_scaler(z, params, KEY, ["value"]).select("series_id", "t", "value"),
        "value", digits=4,
    )


@query(
    "median_imputed_features",
    f"WITH {PANEL_SQL}, med AS (SELECT "
    + ", ".join(f"""quantile_cont("{s}", 0.5) AS m_{s}""" for s in PANEL_SENSORS)
    + " FROM panel WHERE split = 'train' AND label = 0) SELECT t, split, "
    + ", ".join(f"{sql_round(f'coalesce({s}, m_{s})')} AS {s}" for s in PANEL_SENSORS)
    + " FROM panel, med",
)
def median_imputed_features(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    filled, keep = scaling.prepare_features(
        panel, panel.filter("split = 'train' AND label = 0"), KEY, PANEL_SENSORS
    )
    return rounded(filled.select("t", "split", *keep), *keep)


@query(
    "persistence_residual",
    f"WITH {SERIES_SQL} SELECT series_id, t, {sql_round('value - coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY t), value)')} AS value FROM series",
)
def persistence_residual(spark, sf_dir):
    rows = views.user_series(spark, sf_dir)
    out = scaling.persistence_residual(rows, KEY, ["value"])
    return rounded(out.select("series_id", "t", "value"), "value")


@query(
    "context_windows",
    f"""WITH {SERIES_SQL}, w AS (SELECT series_id, t, value AS target,
      list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x FROM series)
      SELECT series_id, t, target, x[1] AS oldest, x[12] AS newest, {sql_round('list_sum(x)', 4)} AS total FROM w WHERE len(x) = 12""",
)
def context_windows(spark, sf_dir):
    rows = views.user_series(spark, sf_dir).withColumn("target", F.col("value"))
    w = scaling.context_windows(rows, KEY, ["value"], ["target"], 12, mode="next")
    total = F.aggregate("x_value", F.lit(0.0), lambda a, v: a + v)
    return w.select(
        "series_id", "t", "target", F.col("x_value")[0].alias("oldest"),
        F.col("x_value")[11].alias("newest"), rnd(total, 4).alias("total"),
    )


@query(
    "context_windows_padded",
    f"""WITH {SERIES_SQL}, w AS (SELECT series_id, t, label AS target,
      list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS x FROM series)
      SELECT series_id, t, target, x[1] AS oldest, x[len(x)] AS newest,
      {sql_round('list_sum(x) + (8 - len(x)) * x[1]', 4)} AS total FROM w""",
)
def context_windows_padded(spark, sf_dir):
    rows = views.user_series(spark, sf_dir).withColumnRenamed("label", "target")
    w = scaling.context_windows(rows, KEY, ["value"], ["target"], 8, pad_initial=True)
    total = F.aggregate("x_value", F.lit(0.0), lambda a, v: a + v)
    return w.select(
        "series_id", "t", "target", F.col("x_value")[0].alias("oldest"),
        F.col("x_value")[7].alias("newest"), rnd(total, 4).alias("total"),
    )


@query(
    "centred_crop",
    f"""WITH {SERIES_SQL}, scen AS (
      SELECT DISTINCT series_id, n, n // 3 AS onset, 6 AS duration FROM series),
      win AS (SELECT *, greatest(0, least((2 * onset + duration) // 2 - 10, n - 20)) AS w0 FROM scen)
      SELECT s.series_id, s.t, s.t - w.w0 AS local_t, w.onset - w.w0 AS onset_local,
             w.onset + w.duration - w.w0 AS offset_local, s.value
      FROM win w JOIN series s ON s.series_id = w.series_id AND s.t >= w.w0 AND s.t < least(w.w0 + 20, w.n)""",
)
def centred_crop(spark, sf_dir):
    rows = views.user_series(spark, sf_dir)
    scenarios = rows.groupBy("series_id").agg(F.max("n").alias("n")).select(
        "series_id", "n", F.floor(F.col("n") / 3).alias("onset"), F.lit(6).cast("long").alias("duration")
    )
    out = scaling.centre_window(rows.select("series_id", "t", "value"), scenarios, KEY, 10)
    return out.select("series_id", "t", "local_t", "onset_local", "offset_local", "value")


@query("first_rows", f"WITH {SERIES_SQL} SELECT series_id, t, value FROM series WHERE t < 10")
def first_rows(spark, sf_dir):
    return scaling.limit_rows(views.user_series(spark, sf_dir), 10).select("series_id", "t", "value")


@query(
    "trace_downsample",
    f"""WITH {SERIES_SQL}, tot AS (
      SELECT series_id, max(n) AS n, sum(1 - label) AS normals,
             max(n) - sum(1 - label) + max(CASE WHEN t = 0 THEN 1 - label END)
             + max(CASE WHEN t = n - 1 AND n > 1 THEN 1 - label ELSE 0 END) AS forced
      FROM series GROUP BY series_id),
    places AS (
      SELECT series_id, floor(CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN normals - 1
                              ELSE i * ((normals - 1) / (k - 1)) END) AS place
      FROM (SELECT series_id, normals, greatest(0, 40 - forced) AS k,
                   unnest(range(greatest(0, 40 - forced)::BIGINT)) AS i FROM tot WHERE n > 40)),
    ranked AS (SELECT s.*, sum(1 - label) OVER (PARTITION BY s.series_id ORDER BY t) - 1 AS place FROM series s)
    SELECT r.series_id, r.t, r.label, r.value FROM ranked r
    WHERE r.n <= 40 OR r.t = 0 OR r.t = r.n - 1 OR r.label = 1
       OR (r.series_id, r.place) IN (SELECT (series_id, place) FROM places)""",
)
def trace_downsample(spark, sf_dir):
    out = scaling.downsample_trace(views.user_series(spark, sf_dir), KEY, 40)
    return out.select("series_id", "t", "label", "value")

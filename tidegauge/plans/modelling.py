"""Queries on error distributions and operating thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.special import sql_normal_cdf
from tidegauge.operators import modelling
from tidegauge.plans.recovering import SUITE_SQL, suite
from tidegauge.plans.registry import query, rounded, sql_round
from tidegauge.plans.scoring import FIT_SQL, fitted
from tidegauge.session import staged
from tidegauge.sources import views
from tidegauge.sources.views import SERIES_SQL

FIT_COLUMNS = ["loc", "scale", "log_likelihood", "aic", "bic"]


def gaussian_sql(source: str, by: str, x: str) -> str:
    return f"""SELECT {by}, count({x}) AS n, avg({x}) AS loc, stddev_pop({x}) AS scale,
      -0.5 * count({x}) * ln(2 * pi()) - count({x}) * ln(stddev_pop({x})) - 0.5 * count({x}) AS log_likelihood FROM {source} GROUP BY {by}"""


_CRITERIA = (
    ", ".join(f"{sql_round(c, 4)} AS {c}" for c in ("loc", "scale", "log_likelihood"))
    + f", {sql_round('4 - 2 * log_likelihood', 4)} AS aic, {sql_round('2 * ln(n) - 2 * log_likelihood', 4)} AS bic"
)


@query(
    "gaussian_fit",
    f"WITH g AS ({gaussian_sql('events', 'event_type', 'value')}) SELECT event_type, n, {_CRITERIA} FROM g",
)
def gaussian_fit(spark, sf_dir):
    out = modelling.fit_gaussian(views.table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded(out, *FIT_COLUMNS, digits=4)


@query(
    "gaussian_fit_by_tier",
    f"""WITH {SERIES_SQL}, {SUITE_SQL}, t AS (SELECT estimator, 'overall' AS tier, signed_amplitude_error AS e FROM sm
      UNION ALL SELECT estimator, amplitude_std::VARCHAR, signed_amplitude_error FROM sm), g AS ({gaussian_sql('t', 'estimator, tier', 'e')})
    SELECT estimator, tier, n, {_CRITERIA} FROM g""",
)
def gaussian_fit_by_tier(spark, sf_dir):
    """Amplitude errors of the benchmark, per estimator overall and per amplitude."""
    out = modelling.fit_by_amplitude(suite(spark, sf_dir), ["estimator"], "amplitude_std", "signed_amplitude_error")
    return rounded(out, *FIT_COLUMNS, digits=4)




@query("shape_fits")
def shape_fits(spark, sf_dir):
    """Gaussian, Student-t and generalised error fits per event type; a likelihood search has no SQL twin."""
    events = views.table(spark, sf_dir, "events").select("event_type", F.log1p("value").alias("x"))
    fits = modelling.rank_models(modelling.fit_all(events, ["event_type"], "x"), ["event_type"])
    return rounded(fits, "loc", "scale", "shape", "log_likelihood", "aic", "bic", digits=3)


@query(
    "ks_statistic",
    f"""WITH f AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type),
    r AS (SELECT e.event_type, n, {sql_normal_cdf('(value - m) / s')} AS c, row_number() OVER (PARTITION BY e.event_type ORDER BY value) AS i
      FROM events e JOIN f ON f.event_type = e.event_type)
    SELECT event_type, any_value(n) AS n, {sql_round('max(greatest(i / n - c, c - (i - 1) / n))')} AS ks_stat FROM r GROUP BY event_type""",
)
def ks_statistic(spark, sf_dir):
    out = modelling.ks_gaussian(views.table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded(out.select("event_type", "n", "ks_stat"), "ks_stat")


# Moment fits with shapes whose distribution functions are elementary: five degrees, and Laplace.
@query(
    "ks_families",
    f"""WITH f AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type),
    r AS (SELECT e.event_type, n, (value - m) / s AS z, row_number() OVER (PARTITION BY e.event_type ORDER BY value) AS i FROM events e JOIN f USING (event_type)),
    q AS (SELECT *, z / sqrt(3.0 / 5) / sqrt(5.0) AS u, z * sqrt(2.0) AS w FROM r),
    c AS (SELECT event_type, n, i, unnest(['gaussian', 'student_t', 'ged']) AS family,
      unnest([{sql_normal_cdf('z')}, 0.5 + (u / (1 + u * u) * (1 + 2 / (3 * (1 + u * u))) + atan(u)) / pi(), 0.5 + 0.5 * sign(w) * (1 - exp(-abs(w)))]) AS c FROM q),
    k AS (SELECT event_type, family, any_value(n) AS n, max(greatest(i / n - c, c - (i - 1) / n)) AS ks_stat FROM c GROUP BY event_type, family)
    SELECT event_type, family, n, {sql_round('ks_stat')} AS ks_stat,
      {sql_round('greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * n * ks_stat * ks_stat)))))')} AS ks_pvalue FROM k""",
)
def ks_families(spark, sf_dir):
    """Goodness of fit of all three families, per event type."""
    events = views.table(spark, sf_dir, "events")
    moments = events.groupBy("event_type").agg(F.avg("value").alias("loc"), F.stddev_pop("value").alias("s"))
    shapes = {"gaussian": (1.0, None), "student_t": ((3 / 5) ** 0.5, 5.0), "ged": (0.5**0.5, 1.0)}
    family = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(c).alias("c"), F.lit(v).cast("double").alias("shape")) for f, (c, v) in shapes.items())))
    fits = moments.withColumn("f", family).select("event_type", "f.family", "loc", (F.col("s") * F.col("f.c")).alias("scale"), "f.shape")
    out = modelling.ks_fitted(events, staged(fits, "fits"), ["event_type"], "value")
    return rounded(out.select("event_type", "family", "n", "ks_stat", "ks_pvalue"), "ks_stat", "ks_pvalue")


_NULL_COLUMNS = ["sparsity_rate", "mean_abs_nonzero", "max_abs", "std_null", *modelling.PERCENTS]
_DELTA_SQL = """dl AS (SELECT series_id, label, CASE WHEN abs(z) >= 0.5 THEN value - m ELSE 0 END AS d FROM z)"""


def thresholded(spark, sf_dir):
    rows = fitted(spark, sf_dir)
    d = F.when(F.abs("z") >= 0.5, F.col("value") - F.col("mean_value")).otherwise(0.0)
    return staged(rows.select("series_id", "label", d.alias("d")), "deltas")


@query(
    "null_summary",
    f"""WITH {SERIES_SQL}, {FIT_SQL}, {_DELTA_SQL}, s AS (SELECT series_id, count(*) AS n_points, count(*) FILTER (WHERE abs(d) <= 1e-4) AS n_zero,
      count(*) FILTER (WHERE abs(d) <= 1e-4) / count(*) AS sparsity_rate, coalesce(avg(abs(d)) FILTER (WHERE abs(d) > 1e-4), 0) AS mean_abs_nonzero,
      max(abs(d)) AS max_abs, stddev_pop(d) AS std_null, """
    + ", ".join(f"quantile_cont(abs(d), {v}) AS {k}" for k, v in modelling.PERCENTS.items())
    + " FROM dl GROUP BY series_id) SELECT series_id, n_points, n_zero, "
    + ", ".join(f"{sql_round(c)} AS {c}" for c in _NULL_COLUMNS)
    + " FROM s",
)
def null_summary(spark, sf_dir):
    return rounded(modelling.null_summary(thresholded(spark, sf_dir), ["series_id"], "d"), *_NULL_COLUMNS)


@query(
    "exceedance",
    f"""WITH {SERIES_SQL}, {FIT_SQL}, {_DELTA_SQL} SELECT label, lv AS threshold, {sql_round('avg(CASE WHEN abs(d) >= lv THEN 1.0 ELSE 0 END)')} AS far
    FROM dl, (VALUES {', '.join(f'({float(v * 200)}::DOUBLE)' for v in modelling.LEVELS)}) l(lv) GROUP BY label, lv""",
)
def exceedance(spark, sf_dir):
    levels = [v * 200 for v in modelling.LEVELS]
    return rounded(modelling.exceedance(thresholded(spark, sf_dir), ["label"], "d", levels), "far")


_ROC_SQL = f"""{FIT_SQL}, {_DELTA_SQL}, st AS (SELECT greatest(max(abs(d)), 0.01) * 1.05 / 199 AS step FROM dl),
th AS (SELECT k, k * step AS tau FROM st, range(200) r(k)),
roc AS (SELECT k, tau AS threshold, count(*) FILTER (WHERE label = 0 AND abs(d) >= tau) / count(*) FILTER (WHERE label = 0) AS fpr,
  count(*) FILTER (WHERE label = 1 AND abs(d) >= tau) / count(*) FILTER (WHERE label = 1) AS tpr FROM dl, th GROUP BY k, tau)"""


@query(
    "roc_curve",
    f"WITH {SERIES_SQL}, {_ROC_SQL} SELECT k, {sql_round('threshold')} AS threshold, {sql_round('fpr')} AS fpr, {sql_round('tpr')} AS tpr FROM roc",
)
def roc_curve(spark, sf_dir):
    return rounded(modelling.roc_curve(thresholded(spark, sf_dir), "d", "label"), "threshold", "fpr", "tpr")


@query(
    "roc_auc",
    f"""WITH {SERIES_SQL}, {_ROC_SQL}, p AS (SELECT fpr, tpr FROM roc UNION ALL VALUES (0.0, 0.0), (1.0, 1.0)),
    a AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM p WINDOW w AS (ORDER BY fpr, tpr))
    SELECT {sql_round('greatest(least(sum(a), 1), 0)')} AS auc FROM a""",
)
def roc_auc(spark, sf_dir):
    curve = staged(modelling.roc_curve(thresholded(spark, sf_dir), "d", "label"), "roc")
    return rounded(modelling.roc_auc(curve), "auc")


@query(
    "operating_threshold",
    f"""WITH {SERIES_SQL}, {FIT_SQL}, {_DELTA_SQL}, n0 AS (SELECT abs(d) AS a FROM dl WHERE label = 0),
    q AS (SELECT 0.001::DOUBLE AS far, quantile_cont(a, 0.999) AS q FROM n0 UNION ALL SELECT 0.01::DOUBLE, quantile_cont(a, 0.99) FROM n0
      UNION ALL SELECT 0.05::DOUBLE, quantile_cont(a, 0.95) FROM n0),
    x AS (SELECT far, q, avg(CASE WHEN a >= q THEN 1.0 ELSE 0 END) AS share, min(a) FILTER (WHERE a > q) AS nxt FROM q, n0 GROUP BY far, q)
    SELECT far, {sql_round('CASE WHEN share > far + 1e-15 THEN coalesce(nxt, q) ELSE q END')} AS tau FROM x""",
)
def operating_threshold(spark, sf_dir):
    clean = thresholded(spark, sf_dir).filter("label = 0")
    return rounded(modelling.tau_for_far(clean, [], "d", [0.001, 0.01, 0.05]), "tau")


@query(
    "error_ledger",
    f"""WITH {SERIES_SQL}, {SUITE_SQL}, e AS (SELECT sm.estimator, sm.series_id, sm.scenario_id, signed_amplitude_error * tstd.sd AS e, s.amp
        FROM sm JOIN tstd ON tstd.series_id = sm.series_id JOIN scored s ON s.estimator = sm.estimator AND s.series_id = sm.series_id AND s.scenario_id = sm.scenario_id),
      g AS ({gaussian_sql('e', 'estimator', 'e')})
    SELECT e.estimator, series_id, scenario_id, {sql_round('e', 5)} AS error_units, {sql_round('amp + e', 5)} AS reconstructed_amplitude,
      {sql_round('-0.5 * ln(2 * pi()) - ln(scale) - 0.5 * pow((e - loc) / scale, 2)', 5)} AS logpdf_gaussian FROM e JOIN g ON g.estimator = e.estimator""",
)
def error_ledger(spark, sf_dir):
    results = suite(spark, sf_dir)
    std = views.split_series(spark, sf_dir).filter("split = 'train'").groupBy("series_id").agg(
        F.stddev_samp("value").alias("train_std")
    )
    parts = F.regexp_extract("scenario_id", r"amp([0-9.]+)_dur[0-9]+_sign([+-]1)", 1).cast("double")
    sign = F.regexp_extract("scenario_id", r"sign([+-]1)", 1).cast("double")
    ledger = staged(
        results.join(std, "series_id").withColumn("amplitude", sign * parts * F.col("train_std")), "ledger"
    )
    errors = ledger.withColumn("e", F.col("signed_amplitude_error") * F.col("train_std"))
    fits = modelling.fit_gaussian(errors, ["estimator"], "e").withColumns(
        {"family": F.lit("gaussian"), "shape": F.lit(None).cast("double")}
    )
    out = modelling.enrich_ledger(ledger, staged(fits, "fits"), ["estimator"], F.col("train_std"))
    columns = ["error_units", "reconstructed_amplitude", "logpdf_gaussian"]
    return rounded(out.select("estimator", "series_id", "scenario_id", *columns), *columns, digits=5)

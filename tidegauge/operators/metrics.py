"""Calibrated thresholds, detection metrics and grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordered import with_rank, with_runs
from tidegauge.operators.quantiles import exact_quantiles
from tidegauge.session import staged

Z90 = 1.645


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def block_number(t: Column, n: Column, blocks: int) -> Column:
    """Block of index ``t`` when ``n`` rows are split into near-equal blocks, larger ones first."""
    base, extra = F.floor(n / blocks), F.pmod(n, F.lit(blocks))
    wide = extra * (base + 1)
    return F.when(t < wide, F.floor(t / (base + 1))).otherwise(extra + F.floor((t - wide) / base)).cast("int")


def blocked_threshold(
    scores: DataFrame, by: Sequence[str], quantile: float, blocks: int, score: str = "score", t: str = "t"
) -> DataFrame:
    """Largest block quantile per group; ``t`` must be dense per group."""
    if not 0.0 < quantile < 1.0 or blocks < 1:
        raise ValueError("quantile must be in (0, 1) and blocks positive")
    sizes = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = scores.join(sizes, list(by)).withColumn("_block", block_number(F.col(t), F.col("_n"), blocks))
    quantiles = exact_quantiles(placed, [*by, "_block"], score, [quantile], "threshold")
    return quantiles.groupBy(*by).agg(F.max("threshold").alias("threshold"))


def sensor_thresholds(
    df: DataFrame, by: Sequence[str], residual: Column, scale: Column, prefix: int, quantile: float, t: str = "t"
) -> DataFrame:
    """Quantile of ``|residual| / scale`` over the clean prefix ``t < prefix``."""
    clean = df.filter(F.col(t) < prefix).withColumn("_z", F.abs(residual) / scale)
    return exact_quantiles(clean, by, "_z", [quantile], "threshold").drop("q")


def point_rates(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    fp, tn = count_if((y == 0) & (p == 1)), count_if((y == 0) & (p == 0))
    tp, fn = count_if((y == 1) & (p == 1)), count_if((y == 1) & (p == 0))
    return df.groupBy(*by).agg(
        ratio(fp, fp + tn).alias("point_fpr"), ratio(tp, tp + fn).alias("point_tpr")
    )


def estimation_error(df: DataFrame, by: Sequence[str], estimated: str, true: str) -> DataFrame:
    error = F.col(estimated) - F.col(true)
    return df.groupBy(*by).agg(F.avg(error * error).alias("mse"), F.avg(error).alias("bias"))


def detection_delay(detected: Column, attacked: Column) -> Column:
    """Signed delay; negative when the alarm came first."""
    return detected - attacked


def detected_events(
    df: DataFrame, key: Sequence[str], label: str = "label", pred: str = "pred", t: str = "t"
) -> DataFrame:
    """One row per maximal run of label 1 with the delay of its first hit, null if missed."""
    runs = with_runs(df.select(*key, t, label, pred), key, F.col(label) == 1, t)
    first_hit = F.min(F.when(F.col(pred) == 1, F.col(t)))
    return (
        runs.filter(F.col("run_start").isNotNull())
        .groupBy(*key, "run_start")
        .agg((first_hit - F.col("run_start")).alias("delay"))
    )


def event_metrics(
    df: DataFrame, key: Sequence[str], label: str = "label", pred: str = "pred", t: str = "t"
) -> DataFrame:
    """Event counts, recall and median delay per series; recall 0 and no delay without events."""
    events = staged(detected_events(df, key, label, pred, t), "events")
    counts = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"), F.count("delay").alias("detected_events")
    )
    medians = exact_quantiles(events, key, "delay", [0.5], "median_detection_delay").drop("q")
    zero = F.lit(0).cast("long")
    return (
        df.select(*key)
        .distinct()
        .join(counts, list(key), "left")
        .join(medians, list(key), "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("n_events", "detected_events")})
        .withColumn("event_recall", ratio(F.col("detected_events"), F.col("n_events")))
    )


def score_distribution(val: DataFrame, test: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Validation median, and median and 99th percentile of normal test scores."""
    both = val.select(*by, score, F.lit("val").alias("_part")).unionByName(
        test.filter("label = 0").select(*by, score, F.lit("test").alias("_part"))
    )
    q = exact_quantiles(both, [*by, "_part"], score, [0.5, 0.99], "_q")

    def pick(part: str, level: float) -> Column:
        return F.max(F.when((F.col("_part") == part) & (F.col("q") == level), F.col("_q")))

    return q.groupBy(*by).agg(
        pick("val", 0.5).alias("validation_median"),
        pick("test", 0.5).alias("test_normal_median"),
        pick("test", 0.99).alias("test_normal_q99"),
    )


def summarize_scores(
    scores: DataFrame, by: Sequence[str], quantile: float, blocks: int = 1, score: str = "score",
    distribution: bool = True,
) -> DataFrame:
    """Calibrate on ``split = 'val'`` rows, judge ``split = 'test'`` rows, per group.

    Without ``distribution`` the columns of ``score_distribution`` are left out; its exact
    quantiles run jobs of their own, which dropping the columns later would not save.
    """
    val, test = scores.filter("split = 'val'"), scores.filter("split = 'test'")
    thresholds = staged(blocked_threshold(val, by, quantile, blocks, score), "thresholds")
    judged = staged(
        test.join(thresholds, list(by)).withColumn(
            "pred", (F.col(score) > F.col("threshold")).cast("int")
        ),
        "judged",
    )
    rates = thresholds.join(point_rates(judged, by), list(by)).join(event_metrics(judged, by), list(by))
    return rates.join(score_distribution(val, test, by, score), list(by), "left") if distribution else rates


# ------------------------------------------------------------ recovery metrics
def recovery_metrics(
    df: DataFrame, by: Sequence[str], estimate: str = "delta_hat", truth: str = "delta",
    support: str | None = None,
) -> DataFrame:
    """Support, magnitude and sign of an estimated disturbance (one row per cell)."""
    true_on = F.col(support) if support else F.col(truth) != 0
    est_on = F.col(estimate) != 0
    tp, fp, fn = count_if(true_on & est_on), count_if(~true_on & est_on), count_if(true_on & ~est_on)
    same_sign = (F.signum(estimate) == F.signum(truth)).cast("int")
    sums = df.groupBy(*by).agg(
        tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"),
        F.avg(F.when(true_on, F.abs(F.col(estimate) - F.col(truth)))).alias("_mae"),
        F.avg(F.when(true_on, same_sign)).alias("_sign"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return sums.select(
        *by,
        precision.alias("support_precision"),
        recall.alias("support_recall"),
        ratio(2.0 * precision * recall, precision + recall).alias("support_f1"),
        ratio(tp, tp + fp + fn).alias("support_iou"),
        F.coalesce("_mae", F.lit(0.0)).alias("magnitude_mae_on_support"),
        F.coalesce("_sign", F.lit(1.0)).alias("sign_accuracy_on_support"),
    )


def timing_metrics(
    df: DataFrame, by: Sequence[str], estimate: str, start: Column, end: Column, t: str = "t"
) -> DataFrame:
    """Onset and duration error of the active span; infinite when nothing is active."""
    on = F.col(estimate) != 0
    first, last = F.min(F.when(on, F.col(t))), F.max(F.when(on, F.col(t)))
    true_start, true_end = F.max(start), F.max(end)
    far = F.lit(float("inf"))
    return df.groupBy(*by).agg(
        F.coalesce(F.abs(first - true_start).cast("double"), far).alias("onset_error_samples"),
        F.coalesce(
            F.abs((last + 1 - first) - (true_end - true_start)).cast("double"), far
        ).alias("duration_error_samples"),
    )


def window_activation(
    df: DataFrame, by: Sequence[str], length: int, boundary: int, t: str = "t", active: str = "active"
) -> DataFrame:
    """Active share of cells and timesteps per window of ``length`` rows.

    Rows are ``(t, sensor, active)``; windows start at ``t0`` of the group and again at ``boundary``.
    """
    if length < 1:
        raise ValueError("length must be positive")
    steps = df.groupBy(*by, t).agg(
        F.count(F.lit(1)).alias("_cells"), F.sum(F.col(active).cast("int")).alias("_on")
    )
    start = df.groupBy(*by).agg(F.min(t).alias("_t0"))
    late = F.col(t) >= boundary
    base = F.when(late, F.greatest(F.lit(boundary), F.col("_t0"))).otherwise(F.col("_t0"))
    return (
        steps.join(start, list(by))
        .withColumn("window_role", F.when(late, "assessment").otherwise("calibration"))
        .withColumn("_window", F.floor((F.col(t) - base) / length))
        .groupBy(*by, "window_role", "_window")
        .agg(
            F.min(t).alias("window_start"),
            (F.max(t) + 1).alias("window_end"),
            (F.sum("_on") / F.sum("_cells")).alias("active_sensor_fraction"),
            F.avg((F.col("_on") > 0).cast("int")).alias("active_timestep_fraction"),
        )
        .drop("_window")
    )


def phase_activation(
    df: DataFrame, by: Sequence[str], start: Column, end: Column, t: str = "t", active: str = "active"
) -> DataFrame:
    """The same shares on attacked sensors before, during and after the event; NaN if empty."""
    phase = F.when(F.col(t) < start, "pre_attack").when(F.col(t) < end, "attack").otherwise("post_attack")
    steps = (
        df.withColumn("phase", phase)
        .groupBy(*by, "phase", t)
        .agg(F.count(F.lit(1)).alias("_cells"), F.sum(F.col(active).cast("int")).alias("_on"))
    )
    shares = steps.groupBy(*by, "phase").agg(
        F.count(F.lit(1)).alias("sample_count"),
        (F.sum("_on") / F.sum("_cells")).alias("active_sensor_fraction"),
        F.avg((F.col("_on") > 0).cast("int")).alias("active_timestep_fraction"),
    )
    phases = F.explode(F.array(*[F.lit(p) for p in ("pre_attack", "attack", "post_attack")]))
    every = df.select(*by).distinct().withColumn("phase", phases)
    nan = F.lit(float("nan"))
    return every.join(shares, [*by, "phase"], "left").withColumns(
        {
            "sample_count": F.coalesce("sample_count", F.lit(0).cast("long")),
            "active_sensor_fraction": F.coalesce("active_sensor_fraction", nan),
            "active_timestep_fraction": F.coalesce("active_timestep_fraction", nan),
        }
    )


def sensor_trace(
    df: DataFrame, by: Sequence[str], residual: Column, delta: Column, scale: Column, t: str = "t"
) -> DataFrame:
    """Mean scaled residual and true disturbance of the attacked sensors by ``t``."""
    return df.groupBy(*by, t).agg(
        F.avg(residual / scale).alias("mean_signed_residual"),
        F.avg(delta / scale).alias("mean_signed_true_delta"),
    )


def regression_metrics(df: DataFrame, by: Sequence[str], y: str, prediction: str) -> DataFrame:
    """RMSE, MAE and R² per group; R² 0 when the target hardly varies."""
    error = F.col(y) - F.col(prediction)
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("mae"),
        F.coalesce(
            F.when(spread > 1e-12, 1.0 - F.sum(error * error) / spread), F.lit(0.0)
        ).alias("r2"),
    )


# ----------------------------------------------------------- scenario metrics
def scenario_metrics(
    df: DataFrame, by: Sequence[str], train_std: Column, peak: bool | Column = False, t: str = "t"
) -> DataFrame:
    """Score recovered scenarios; one row per (scenario, estimator, t) comes in.

    Needs ``delta_hat, delta, x_hat, x, unc, onset, offset, amplitude``. With ``peak``
    the denominator is the largest true disturbance and the true support is
    where it exceeds a tenth of it, for waveforms that are not constant. A column as
    ``peak`` is that denominator, known beforehand, which saves a join. With a
    column ``n`` (rows of the series) only supported rows need to come in; the
    absent ones count as recovered exactly.
    """
    sparse = "n" in df.columns
    inside = (F.col(t) >= F.col("onset")) & (F.col(t) < F.col("offset"))
    varies = isinstance(peak, Column) or peak
    if isinstance(peak, Column):
        df = df.withColumn("_peak", peak)
    elif peak:
        peaks = df.groupBy(*by).agg(
            F.greatest(
                F.max(F.abs("amplitude")), F.max(F.when(inside, F.abs("delta"))), F.lit(1e-6)
            ).alias("_peak")
        )
        df = df.join(peaks, list(by))
    else:
        df = df.withColumn("_peak", F.abs("amplitude"))
    tenth = 0.1 * F.col("_peak")
    found = F.abs("delta_hat") > tenth
    true_on = F.abs("delta") > tenth if varies else inside
    err = F.col("delta_hat") - F.col("delta")
    xerr = F.col("x_hat") - F.col("x")
    covered = (F.abs(xerr) <= Z90 * F.col("unc")).cast("int")
    sums = df.groupBy(*by).agg(
        F.max("_peak").alias("_peak"),
        F.max("amplitude").alias("_amp"),
        F.max(train_std).alias("_std"),
        F.avg(F.when(inside, err * err)).alias("_mse"),
        F.avg(F.when(inside, xerr * xerr)).alias("_xmse"),
        # the interval of one scenario, at most its declared duration
        F.percentile(F.when(inside, F.col("delta_hat")), F.lit(0.5)).alias("_median"),
        count_if(found & true_on).alias("_tp"),
        count_if(found & ~true_on).alias("_fp"),
        count_if(~found & true_on).alias("_fn"),
        F.max("unc").alias("_unc"),
        (
            (F.sum(covered) + F.max("n") - F.count(F.lit(1))) / F.max("n") if sparse else F.avg(covered)
        ).alias("_cover"),
        F.avg(F.when(inside, covered)).alias("_cover_in"),
        F.avg(2.0 * Z90 * F.col("unc")).alias("_sharp"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    known = F.col("_unc") > 0
    return sums.select(
        *by,
        (F.sqrt("_mse") / F.col("_peak")).alias("delta_nrmse"),
        ratio(2.0 * precision * recall, precision + recall).alias("support_f1"),
        precision.alias("support_precision"),
        recall.alias("support_recall"),
        ((F.col("_median") - F.col("_amp")) / F.col("_std")).alias("signed_amplitude_error"),
        (F.sqrt("_xmse") / F.col("_std")).alias("clean_x_nrmse"),
        (F.signum("_median") == F.signum("_amp")).cast("double").alias("sign_accuracy"),
        F.when(known, F.col("_cover")).otherwise(0.0).alias("coverage_90"),
        F.when(known, F.col("_sharp")).otherwise(0.0).alias("interval_sharpness"),
        F.when(known, F.col("_cover_in")).otherwise(0.0).alias("interval_coverage_90"),
    )


def trajectory_metrics(df: DataFrame, by: Sequence[str], t: str = "t") -> DataFrame:
    """Full-length and interval errors, norms, and support rates against the peak."""
    inside = (F.col(t) >= F.col("onset")) & (F.col(t) < F.col("offset"))
    peaks = df.groupBy(*by).agg(
        F.greatest(
            F.max(F.abs("amplitude")), F.max(F.when(inside, F.abs("delta"))), F.lit(1e-6)
        ).alias("_peak")
    )
    df = df.join(peaks, list(by))
    err = F.col("delta_hat") - F.col("delta")
    found, true_on = F.abs("delta_hat") > 0.1 * F.col("_peak"), F.abs("delta") > 0.1 * F.col("_peak")
    tp, fp = count_if(found & true_on), count_if(found & ~true_on)
    fn, tn = count_if(~found & true_on), count_if(~found & ~true_on)
    one = F.lit(1.0)
    return df.groupBy(*by).agg(
        F.avg(F.when(inside, err * err)).alias("mse"),
        (F.sqrt(F.avg(F.when(inside, err * err))) / F.max("_peak")).alias("nrmse"),
        F.avg(F.when(inside, F.abs(err))).alias("mae"),
        F.max(F.when(inside, F.abs(err))).alias("max_error"),
        F.avg(err * err).alias("full_mse"),
        F.sqrt(F.avg(err * err)).alias("full_rmse"),
        F.avg(F.abs(err)).alias("full_mae"),
        F.max(F.abs(err)).alias("full_max_error"),
        F.sqrt(F.sum(F.col("delta_hat") * F.col("delta_hat"))).alias("delta_l2_norm"),
        F.max(F.abs("delta_hat")).alias("delta_linf_norm"),
        F.sqrt(F.sum(F.col("x_hat") * F.col("x_hat"))).alias("x_hat_l2_norm"),
        F.max(F.abs("x_hat")).alias("x_hat_linf_norm"),
        F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), one).alias("tpr"),
        ratio(fp, fp + tn).alias("far"),
        F.coalesce(
            F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double")), one
        ).alias("f1_score"),
    )


def bound_violations(
    df: DataFrame, by: Sequence[str], value: str, low: Column, high: Column, slack: float = 1e-4
) -> DataFrame:
    out = (F.col(value) < low - slack) | (F.col(value) > high + slack)
    return df.groupBy(*by).agg(count_if(out).alias("violations"))


_SUMMARY_LEVELS = {0: "overall", 1: "amplitude", 2: "duration", 3: "regime"}


def benchmark_summary(
    results: DataFrame, amplitude: str = "amplitude_std", duration: str = "duration", regime: str = "regime"
) -> DataFrame:
    """Medians and means per estimator, overall and by amplitude, duration and regime.

    One row per scenario and estimator comes in; each is repeated once per
    grouping, then a single aggregate serves all four.
    """
    level = F.explode(
        F.array(
            F.struct(F.lit("overall").alias("grouping"), F.lit("all").alias("bucket")),
            F.struct(F.lit("amplitude").alias("grouping"), F.col(amplitude).cast("string").alias("bucket")),
            F.struct(F.lit("duration").alias("grouping"), F.col(duration).cast("string").alias("bucket")),
            F.struct(F.lit("regime").alias("grouping"), F.col(regime).cast("string").alias("bucket")),
        )
    )
    rows = results.withColumn("_level", level).select("*", "_level.*").drop("_level")
    by = ["estimator", "grouping", "bucket"]
    long = rows.withColumn("_amp_error", F.abs("signed_amplitude_error")).unpivot(
        by, ["delta_nrmse", "support_f1", "_amp_error"], "_metric", "_value"
    )
    medians = exact_quantiles(long, [*by, "_metric"], "_value", [0.5], "_median").groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_metric") == m, F.col("_median"))).alias(name)
            for m, name in (
                ("delta_nrmse", "median_delta_nrmse"),
                ("support_f1", "median_support_f1"),
                ("_amp_error", "median_abs_amplitude_error"),
            )
        ]
    )
    strong = F.col(amplitude) >= 1.0
    means = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_scenarios"),
        F.avg("delta_nrmse").alias("mean_delta_nrmse"),
        F.avg("support_f1").alias("mean_support_f1"),
        F.avg("clean_x_nrmse").alias("mean_clean_x_nrmse"),
        count_if(strong).alias("n_eligible"),
        F.coalesce(F.avg(F.when(strong, F.col("sign_accuracy"))), F.lit(1.0)).alias("sign_accuracy_ge_1std"),
        F.avg("coverage_90").alias("mean_coverage_90"),
        F.avg("interval_sharpness").alias("mean_interval_sharpness"),
    )
    return means.join(medians, by)


def improvements(summary: DataFrame, causal: Sequence[str]) -> DataFrame:
    """Relative median error reduction of every estimator over the best causal baseline."""
    overall = summary.filter("grouping = 'overall'")
    best = overall.filter(F.col("estimator").isin(*causal)).agg(
        F.min_by("estimator", F.struct("median_delta_nrmse", "estimator")).alias("best_causal"),
        F.min("median_delta_nrmse").alias("_base"),
    )
    base = F.col("_base")
    gain = F.when(base > 0, (base - F.col("median_delta_nrmse")) / base).otherwise(0.0)
    return overall.join(F.broadcast(best)).withColumn("improvement", gain).drop("_base")  # one row


def acceptance(
    summary: DataFrame, causal: Sequence[str], judged: Sequence[str], violations: DataFrame | None = None
) -> DataFrame:
    """The six gates over the judged estimators, one row per gate and one for all."""
    rows = improvements(summary, causal).filter(F.col("estimator").isin(*judged))
    if violations is None:
        rows = rows.withColumn("violations", F.lit(0))
    else:
        rows = rows.join(violations.groupBy("estimator").agg(F.sum("violations").alias("violations")), "estimator")
    # Gate names and limits.
    gates = {
        "improvement_ge_20pct": F.col("improvement") >= 0.20,
        "amplitude_error_le_0_25std": F.col("median_abs_amplitude_error") <= 0.25,
        "sign_accuracy_ge_95pct": F.col("sign_accuracy_ge_1std") >= 0.95,
        "coverage_ge_85pct": F.col("mean_coverage_90") >= 0.85,
        "sharpness_lt_0_25": F.col("mean_interval_sharpness") < 0.25,
        "zero_violations": F.col("violations") == 0,
    }
    passed = rows.agg(*[F.bool_and(test).alias(g) for g, test in gates.items()])
    passed = passed.withColumn("all_gates", F.expr(" AND ".join(gates)))
    return passed.unpivot([], [*gates, "all_gates"], "gate", "passed")


def compare_runs(first: DataFrame, second: DataFrame, metrics: Sequence[str], names=("declared", "undeclared")) -> DataFrame:
    """Metrics of two summaries side by side, by estimator of the second."""
    a = first.select("estimator", *[F.col(m).alias(f"{m}_{names[0]}") for m in metrics])
    b = second.select("estimator", *[F.col(m).alias(f"{m}_{names[1]}") for m in metrics])
    return b.join(a, "estimator", "left")


def family_reduction(results: DataFrame, base: str, better: str) -> DataFrame:
    """Median error reduction in percent of one estimator over another, per family."""
    both = results.filter(F.col("estimator").isin(base, better))
    medians = exact_quantiles(both, ["family", "estimator"], "delta_nrmse", [0.5], "_m")
    pick = lambda e: F.max(F.when(F.col("estimator") == e, F.col("_m")))
    rows = medians.groupBy("family").agg(pick(base).alias("base_nrmse"), pick(better).alias("better_nrmse"))
    cut = (F.col("base_nrmse") - F.col("better_nrmse")) / F.col("base_nrmse") * 100.0
    return rows.withColumn("reduction_percent", F.when(F.col("base_nrmse") > 0, cut).otherwise(0.0))


def pivot_metric(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], metric: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(metric))


def rank_runs(
    runs: DataFrame, order: Sequence[Column], metrics: Sequence[str], name: str = "run_name", position: str = "position"
) -> DataFrame:
    """Stable multi-key ranking of a table of runs; nulls and duplicate names are refused.

    ``order`` are ascending values (negate a column for the other way); the rows are ranked
    in sorted range partitions, not in one task.
    """
    broken = runs.groupBy(name).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.expr(" OR ".join(f"{m} IS NULL" for m in metrics))).alias("_null"),
    ).filter("_n > 1 OR _null")
    if not broken.isEmpty():
        raise ValueError("runs need complete metrics and unique names")
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    ranked = with_rank(runs.withColumns(keys), [], [*keys, position], "selection_rank")
    return ranked.withColumn("selection_rank", F.col("selection_rank") + 1).drop(*keys)


def pick_config(configs: DataFrame, tie: Sequence[str], fpr: str = "fpr", tpr: str = "tpr") -> DataFrame:
    """Lowest FPR inside the acceptance corner, else the nearest configuration to it."""
    ok = (F.col(fpr) <= 0.01) & (F.col(tpr) >= 0.90)
    over = F.greatest(F.col(fpr) - 0.01, F.lit(0.0)) / 0.01
    short = F.greatest(0.90 - F.col(tpr), F.lit(0.0)) / 0.90
    rows = configs.withColumn("in_corner", ok).withColumn("distance", F.hypot(over, short))
    order = F.when(F.col("in_corner"), F.col(fpr)).otherwise(F.col("distance"))
    return rows.orderBy(F.col("in_corner").desc(), order, *tie).limit(1)


def sweep_summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Delay, miss, false alarm and level error statistics per grid cell, 3 digits."""
    out = results.groupBy(*by).agg(
        F.avg("delay").alias("delay_mean"),
        F.stddev_samp("delay").alias("delay_std"),
        F.count("delay").alias("delay_n"),
        F.sum("missed").alias("missed"),
        F.avg("fpr").alias("fpr_mean"),
        F.max("fpr").alias("fpr_max"),
        F.avg("error_pct").alias("err_mean_pct"),
        F.max("error_pct").alias("err_max_pct"),
    )
    digits = ["delay_mean", "delay_std", "fpr_mean", "fpr_max", "err_mean_pct", "err_max_pct"]
    return out.withColumns({c: F.round(c, 3) for c in digits})


def run_divergence(runs: DataFrame, by: Sequence[str], value: str, limit: float = 1e-12) -> DataFrame:
    """Largest difference between repeated runs per key (the range equals the largest pair)."""
    return runs.groupBy(*by).agg((F.max(value) - F.min(value)).alias("max_difference")).withColumn(
        "verified", F.col("max_difference") <= limit
    )

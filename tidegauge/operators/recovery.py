"""Estimates of the clean signal and the disturbance, and the benchmark around them.

An estimator takes attacked rows and returns ``(series_id, scenario_id, t, x_hat,
delta_hat, unc)``. With a declared interval only its rows are returned: all
others are the observation itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.metrics import count_if, scenario_metrics
from tidegauge.operators.ordered import CHUNK, chunked, with_lag
from tidegauge.operators.quantiles import exact_quantiles
from tidegauge.operators.scores import cusum_reset
from tidegauge.operators.solver import delta_bounds, recover_rolling, recover_whole
from tidegauge.session import staged

SCENARIO = ["series_id", "scenario_id"]
MAX_CANDIDATES = 1_000  # of a case, up to which all pairs are summed; more are searched best first
ONSETS = 1_024  # of a series whose intervals take their rows from one list
SOURCES = 64  # candidates of a case whose distances to all others one round sums


def lag_variance(normal: DataFrame, key: Sequence[str], value: str, lag: int, t: str = "t") -> DataFrame:
    """Population variance of the lag differences on normal rows, ``variance`` per key."""
    rows = with_lag(normal, key, {"_lag": (value, lag)}, t)
    return rows.groupBy(*key).agg(
        F.coalesce(F.var_pop(F.col(value) - F.col("_lag")), F.lit(0.0)).alias("variance")
    )


def persistence_declared(attacked: DataFrame, clean: DataFrame, lag: int) -> DataFrame:
    """Repeat the ``lag`` rows before the declared interval through it.

    ``attacked`` holds the interval's rows ``(series_id, scenario_id, t, y, onset)``;
    ``clean`` holds ``(series_id, t, value)`` with prior history at negative ``t``. The
    recursion through estimates ends at row ``onset - lag + (t - onset) mod lag``,
    which is one equi-join. Missing history falls back to the row before the
    interval, then to the last history row, then to the first row.
    """
    source = F.col("onset") - lag + F.pmod(F.col("t") - F.col("onset"), F.lit(lag))
    rows = attacked.withColumn("_at", source.cast("long"))

    def looked_up(name: str) -> DataFrame:
        return clean.select("series_id", F.col("t").alias("_at"), F.col("value").alias(name))

    rows = rows.join(looked_up("_base"), ["series_id", "_at"], "left")
    edge = F.when(F.col("onset") > 0, F.col("onset") - 1).otherwise(F.lit(-1)).cast("long")
    rows = rows.withColumn("_at", edge).join(looked_up("_edge"), ["series_id", "_at"], "left")
    first = attacked.groupBy(*SCENARIO).agg(F.min_by("y", "t").alias("_first"))
    rows = rows.join(first, SCENARIO)
    x_hat = F.coalesce("_base", "_edge", "_first")
    return rows.withColumn("x_hat", x_hat).withColumn("delta_hat", F.col("y") - F.col("x_hat")).drop(
        "_at", "_base", "_edge", "_first"
    )


def interval_rows(
    scenarios: DataFrame, clean: DataFrame, reach: int, longest: int, facts: DataFrame | None = None
) -> DataFrame:
    """Rows of every declared interval, with the clean ones before it: adds ``t, x, past, first``.

    ``clean`` holds ``(series_id, t, value)`` without gaps, history at negative ``t``; ``past`` has its
    ``reach`` rows before the onset, null where there are none, and ``first`` is the row of the
    onset. A scenario meets one list of rows, of at least its ``longest`` duration, so its
    cells are not shuffled. ``facts`` has one row per series whose columns go along.
    """
    size = max(ONSETS, reach + longest)
    shifted = clean.select("series_id", (F.col("t") + reach).alias("_s"), "value")
    rows = chunked(shifted, "_s", ahead=reach + longest - 1, size=size)
    lists = rows.groupBy("series_id", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_s", "value"))).alias("_c"))
    lists = lists.select("series_id", "_chunk", F.col("_c.value").alias("_x"), F.col("_c._s")[0].alias("_from"))
    if facts is not None:
        lists = lists.join(facts, "series_id")
    met = scenarios.withColumn("_chunk", F.floor(F.col("onset") / size).cast("long")).join(lists, ["series_id", "_chunk"])
    at = (F.col("onset") + reach - F.col("_from")).cast("int")  # place of the onset in the list
    past = F.array(*[F.get("_x", at - k) for k in range(reach, 0, -1)])
    own = F.when(at < F.size("_x"), F.slice("_x", at + 1, F.col("duration").cast("int")))
    met = met.withColumns({"past": past, "_x": own, "first": F.get("_x", at)}).drop("_chunk", "_from")
    cells = met.select("*", F.posexplode("_x").alias("_i", "x")).drop("_x")
    return cells.withColumn("t", (F.col("onset") + F.col("_i")).cast("long")).drop("_i")


def persistence_past(attacked: DataFrame, lag: int, first: Column) -> DataFrame:
    """``persistence_declared`` for ``interval_rows``, whose ``past`` holds ``lag`` rows or more.

    ``first`` is the observation at the onset, which stands in where no history is known.
    """
    back = F.pmod(F.col("t") - F.col("onset"), F.lit(lag)) - lag  # the last place is -1
    base = F.get("past", (F.size("past") + back).cast("int"))
    x_hat = F.coalesce(base, F.get("past", F.size("past") - 1), first)
    return attacked.withColumn("x_hat", x_hat).withColumn("delta_hat", F.col("y") - F.col("x_hat"))


def persistence_undeclared(attacked: DataFrame, key: Sequence[str], lag: int, t: str = "t") -> DataFrame:
    """``x_hat`` is the attacked value ``lag`` rows earlier; rows with ``t < 0`` serve as history."""
    rows = with_lag(attacked, key, {"_lag": ("y", lag)}, t).filter(F.col(t) >= 0)
    return rows.withColumn("x_hat", F.coalesce("_lag", "y")).withColumn(
        "delta_hat", F.col("y") - F.col("x_hat")
    ).drop("_lag")


def recover_from_prediction(rows: DataFrame, prediction: str = "prediction", inside: Column | None = None) -> DataFrame:
    """Residual against any clean prediction, zero outside the declared interval."""
    inside = F.lit(True) if inside is None else inside
    delta = F.when(inside, F.col("y") - F.col(prediction)).otherwise(0.0)
    return rows.withColumn("delta_hat", delta).withColumn("x_hat", F.col("y") - F.col("delta_hat"))


def solver_rows(rows: DataFrame, prediction: str, x_min: Column, x_max: Column, inside: Column | None = None) -> DataFrame:
    """Residual and box columns ``r, low, high`` for the sparse-change solvers."""
    low, high = delta_bounds(F.col("y"), x_min, x_max, inside)
    return rows.withColumns({"r": F.col("y") - F.col(prediction), "low": low, "high": high})


def recover_sparse(
    rows: DataFrame, key: Sequence[str], terms: Sequence[tuple], window: int | None = None, weight: float = 1.0, **options
) -> DataFrame:
    """Solve ``solver_rows`` offline, or causally over trailing windows, and add ``x_hat``."""
    if window is None:
        solved = recover_whole(rows, key, terms, weight, **options)
    else:
        solved = recover_rolling(rows, key, terms, window, weight, **options)
    return rows.drop("r", "low", "high").join(solved, [*key, "t"]).withColumn(
        "x_hat", F.col("y") - F.col("delta_hat")
    )


# ------------------------------------------------------------------- constraints
def channel_profile(
    fit: DataFrame, key: Sequence[str], target: str, value: str = "value", sensor: str = "sensor", t: str = "t"
) -> DataFrame:
    """Range, largest step, role, type and unit guess per sensor (long rows)."""
    rows = with_lag(fit, [*key, sensor], {"_lag": (value, 1)}, t)
    name = F.col(sensor)
    status = name.startswith("S_")
    unit = F.when(name.startswith("L_") | name.startswith("P_"), "m").when(name.startswith("F_"), "L/s").otherwise(
        "dimensionless"
    )
    profile = rows.groupBy(*key, sensor).agg(
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.coalesce(F.max(F.abs(F.col(value) - F.col("_lag"))), F.lit(0.0)).alias("max_step"),
        F.bool_and(F.col(value).isin(0.0, 1.0)).alias("is_binary"),
    )
    is_target = name == target
    return profile.withColumns(
        {
            "role": F.when(is_target, "target_measurement").otherwise("recorded_companion"),
            "attackability": F.when(is_target, "attackable").otherwise("declared_unaffected"),
            "value_type": F.when(status, "binary").otherwise("continuous"),
            "unit": unit,
            "valid": ~status | F.col("is_binary"),
        }
    )


def companions_of(profile: DataFrame, target: str, sensor: str = "sensor") -> list[str]:
    """Names of declared-unaffected companions (one row per sensor reaches the driver)."""
    rows = profile.filter("role = 'recorded_companion' AND attackability = 'declared_unaffected'")
    return sorted(r[0] for r in rows.filter(F.col(sensor) != target).select(sensor).distinct().collect())


def constraint_summary(df: DataFrame, target: str, cols: Sequence[str], top: int) -> tuple[DataFrame, DataFrame]:
    """Target range and the companions ranked by absolute correlation.

    Everything but the exact quantiles is one aggregate over the wide rows.
    """
    others = [c for c in cols if c != target]
    sums = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(target).alias("minimum"),
        F.max(target).alias("maximum"),
        F.stddev_pop(target).alias("standard_deviation"),
        (F.count(F.lit(1)) - F.count(target)).alias("missing_count"),
        sum(((F.stddev_pop(c) == 0).cast("int") for c in cols), F.lit(0)).cast("long").alias("constant_sensor_count"),
        *[F.corr(c, target).alias(f"corr_{c}") for c in others],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in others],
    )
    sums = staged(sums, "constraints")
    q = exact_quantiles(df, [], target, [0.01, 0.5, 0.99], "_v").groupBy().agg(
        *[
            F.max(F.when(F.col("q") == level, F.col("_v"))).alias(name)
            for level, name in ((0.01, "quantile_01"), (0.5, "median"), (0.99, "quantile_99"))
        ]
    )
    target_range = sums.select(
        F.lit(target).alias("target_sensor"), "row_count", F.lit(len(cols)).cast("long").alias("sensor_count"),
        "constant_sensor_count", "minimum", "maximum", "standard_deviation", "missing_count",
    ).join(F.broadcast(q))  # one row each
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("sensor"), F.col(f"corr_{c}").alias("correlation"), F.col(f"std_{c}").alias("_std"))
                for c in others
            ]
        )
    )
    ranked = (
        sums.select(pairs.alias("_p")).select("_p.*")
        .filter((F.col("_std") > 0) & F.col("correlation").isNotNull() & ~F.isnan("correlation"))
        .withColumn("absolute_correlation", F.abs("correlation"))
        .withColumn(
            "rank", F.row_number().over(Window.orderBy(F.col("absolute_correlation").desc(), "sensor")).cast("long")
        )
        .filter(F.col("rank") <= top)
        .drop("_std")
    )
    return target_range, ranked


def candidate_separation(
    candidates: DataFrame, tau: float = 0.0, norm: str = "linf", tolerance: float = 1e-12, exhaustive: bool = False
) -> DataFrame:
    """Are the supplied recoveries of a case further apart than ``tau``?

    Rows are ``(case_id, candidate, t, y, clean, delta, support)``. The largest ``linf``
    distance is the largest spread at one ``t``, so no pairs are formed; ``l1``
    distances are summed per block of ``t`` into one matrix of candidates, or for many
    candidates searched best first.
    """
    if norm not in ("linf", "l1"):
        raise ValueError("norm must be linf or l1")
    checks = candidates.groupBy("case_id").agg(
        F.count_distinct("candidate").alias("candidate_count"),
        F.max(F.abs(F.col("y") - F.col("clean") - F.col("delta"))).alias("max_identity_error"),
        count_if(~F.col("support") & (F.col("delta") != 0)).alias("off_support"),
    )
    if norm == "linf":
        spread = candidates.groupBy("case_id", "t").agg((F.max("delta") - F.min("delta")).alias("_d"))
        distance = spread.groupBy("case_id").agg(F.max("_d").alias("max_separation"))
    else:
        most = checks.agg(F.max("candidate_count")).first()[0] or 0
        block = max(1, CHUNK // max(most, MAX_CANDIDATES))
        text = candidates.select(
            F.col("case_id").cast("string"), F.col("candidate").cast("string"), "t", "delta",
            F.floor(F.col("t") / block).alias("_block"),
        )
        distance = _all_pairs(text) if most <= MAX_CANDIDATES else _farthest_pair(text)
        checks = checks.withColumn("case_id", F.col("case_id").cast("string"))
    far = F.col("max_separation") > tau
    return (
        checks.join(distance, "case_id", "left")
        .withColumn("max_separation", F.coalesce("max_separation", F.lit(0.0)))
        .withColumn("ambiguous", F.when(far, True).otherwise(F.lit(False if exhaustive else None).cast("boolean")))
        .withColumn("certified", ~far & F.lit(exhaustive))
        .withColumn("valid", (F.col("max_identity_error") <= tolerance) & (F.col("off_support") == 0))
    )


PAIR_SUMS = "case_id string, a string, b string, s double"


def _summed(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("case_id", "a", "b").agg(F.sum("s").alias("_s"))
    return sums.groupBy("case_id").agg(F.max("_s").alias("max_separation"))


def _all_pairs(text: DataFrame) -> DataFrame:
    def pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="candidate", values="delta").sort_index(axis=1)
        names, x = list(wide.columns), wide.to_numpy()
        pairs = [
            (names[i], names[j], float(np.abs(x[:, i] - x[:, j]).sum()))
            for i, j in itertools.combinations(range(len(names)), 2)
        ]
        out = pd.DataFrame(pairs, columns=["a", "b", "s"])
        out.insert(0, "case_id", str(pdf["case_id"].iloc[0]))
        return out

    return _summed(text.groupBy("case_id", "_block").applyInPandas(pair_sums, PAIR_SUMS))


def _farthest_pair(text: DataFrame) -> DataFrame:
    """Largest ``l1`` distance of a case by branch and bound.

    Two candidates are no farther apart than the sum of their distances to the mean of all. The
    ones farthest out are measured against all others first; as soon as no two of the rest
    could beat the best pair, that pair is the answer.
    """
    middle = text.groupBy("case_id", "t").agg(F.avg("delta").alias("_m"))
    far = text.join(middle, ["case_id", "t"]).groupBy("case_id", "candidate").agg(F.sum(F.abs(F.col("delta") - F.col("_m"))).alias("r"))
    rest = staged(far, "reach")
    best = staged(rest.groupBy("case_id").agg(F.lit(0.0).alias("max_separation")), "best")
    first = Window.partitionBy("case_id").orderBy(F.desc("r"), "candidate")

    def source_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="candidate", values="delta")
        x, names = wide.to_numpy(), wide.columns.to_numpy()
        parts = []
        for a in pdf.loc[pdf["_source"], "candidate"].unique():
            away = np.abs(x - wide[a].to_numpy()[:, None]).sum(axis=0)
            parts.append(pd.DataFrame({"a": a, "b": names, "s": away}))
        out = pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "s": []}, dtype=object)
        out.insert(0, "case_id", str(pdf["case_id"].iloc[0]))
        return out

    while True:
        open_ = rest.join(best, "case_id").filter(2 * F.col("r") > F.col("max_separation"))
        sources = open_.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= SOURCES)
        sources = staged(sources.select("case_id", "candidate", F.lit(True).alias("_source")), "sources")
        if sources.isEmpty():
            return best
        marked = text.join(sources, ["case_id", "candidate"], "left").withColumn("_source", F.coalesce("_source", F.lit(False)))
        marked = marked.join(sources.select("case_id").distinct(), "case_id", "left_semi")
        found = _summed(marked.groupBy("case_id", "_block").applyInPandas(source_sums, PAIR_SUMS)).withColumnRenamed("max_separation", "_new")
        better = F.greatest("max_separation", F.coalesce("_new", F.lit(0.0))).alias("max_separation")
        best = staged(best.join(found, "case_id", "left").select("case_id", better), "best")
        rest = staged(rest.join(sources.drop("_source"), ["case_id", "candidate"], "left_anti"), "reach")


# --------------------------------------------------------------------- benchmark
Estimator = Callable[[DataFrame], DataFrame]


def run_suite(
    attacked: DataFrame, estimators: dict[str, Estimator], peak: bool = False, extra: Sequence[str] = (), written: bool = False
) -> DataFrame:
    """Score every estimator on every scenario, one row per pair.

    ``attacked`` holds ``(series_id, scenario_id, t, x, y, delta, onset, offset, amplitude,
    train_std, n)`` and is written once, unless it is ``written`` already; each estimator adds
    ``x_hat, delta_hat, unc``.
    """
    attacked = attacked if written else staged(attacked, "attacked")
    needed = [*SCENARIO, "t", "x", "delta", "onset", "offset", "amplitude", "train_std", "n", "x_hat", "delta_hat", "unc"]
    parts = [
        fn(attacked).select(*needed, *extra, F.lit(name).alias("estimator")) for name, fn in estimators.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return scenario_metrics(rows, [*SCENARIO, "estimator", *extra], F.col("train_std"), peak)


def delay_sweep(
    rows: DataFrame, shifts: Sequence[float], k: float, h: float, window: int, t: str = "t"
) -> DataFrame:
    """Detection delay of a CUSUM on known steps added to every series.

    ``rows`` holds ``(series_id, t, dev, scale, t0, n)`` with ``dev`` the deviation of the
    clean series; shifts are in units of ``scale``. Delay counts from ``t0`` to the
    first alarm after it; false alarms come from the clean run.
    """
    grid = F.explode(F.array(*[F.lit(float(c)) for c in (0.0, *shifts)]))
    runs = rows.withColumn("shift", grid).withColumns(
        {
            "level": F.col("shift") * F.col("scale"),
            "mu0": F.lit(0.0),
            "k": k * F.col("scale"),
            "h": h * F.col("scale"),
        }
    )
    runs = runs.withColumn("y", F.col("dev") + F.when(F.col(t) >= F.col("t0"), F.col("level")).otherwise(0.0))
    key = ["series_id", "shift"]
    alarms = cusum_reset(runs, key, "y", "mu0", "k", "h", t).select(*key, t, "alarm")
    joined = runs.join(alarms, [*key, t])
    late = F.col("alarm") & (F.col(t) > F.col("t0"))
    inside = (F.col(t) >= F.col("t0")) & (F.col(t) < F.col("t0") + window)
    runs = joined.groupBy(*key).agg(
        (F.min(F.when(late, F.col(t))) - F.max("t0")).alias("delay"),
        F.avg(F.col("alarm").cast("int")).alias("fpr"),
        F.avg(F.when(inside, F.col("y"))).alias("estimate"),
        F.max("level").alias("level"),
    )
    runs = staged(runs, "sweep")
    clean = runs.filter("shift = 0").select("series_id", "fpr")
    return runs.filter("shift <> 0").drop("fpr").join(clean, "series_id").select(
        "series_id", "shift", "delay",
        F.col("delay").isNull().cast("int").alias("missed"),
        "fpr",
        (F.abs(F.col("estimate") - F.col("level")) / F.abs("level") * 100.0).alias("error_pct"),
    )


def noise_floor_sweep(rows: DataFrame, key: Sequence[str], recovered: float = 0.005) -> DataFrame:
    """Error and recovered share on the support of weak disturbances (rows on the support)."""
    err = F.col("delta") - F.col("delta_hat")
    return rows.groupBy(*key).agg(
        (F.sqrt(F.avg(err * err)) / (F.max("amplitude") + 1e-8)).alias("delta_nrmse"),
        F.avg("delta_hat").alias("estimated_amplitude"),
        F.avg((F.abs("delta_hat") > recovered).cast("int")).alias("non_zero_fraction"),
    )

"""Known disturbances added to clean telemetry, and scenario grids.

A scenario row is ``(series_id, scenario_id, family, sensors, onset, duration,
amplitude, parameters)``. Its disturbance is kept sparse: one row per supported
cell, joined to the telemetry on (series, sensor, t), never an interval test.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegauge.functions.hashing import gaussian, seeded_digest, uniform, uniform_int
from tidegauge.functions.waveforms import (
    FAMILIES,
    RANDOM_FAMILIES,
    canonical_family,
    parameter,
    waveform,
)
from tidegauge.operators.metrics import count_if
from tidegauge.operators.ordered import chunked, feedback_scan, geometric, geometric_scan, prefix_sum, with_lag
from tidegauge.operators.quantiles import exact_quantiles
from tidegauge.session import spread, staged

CELL = ["series_id", "sensor", "t"]
SCENARIO_CELL = ["series_id", "scenario_id", "sensor", "t"]
SHAPE = ["family", "sensors", "onset", "duration", "amplitude", "parameters"]
# Regime names, and the id formats below, are part of the result.
REGIMES = ["low_dynamics", "medium_dynamics", "high_dynamics"]
NO_PARAMETERS = "map<string,double>"
ONSETS = 1_024  # of a series that one row holds; Arrow sends thousands of rows at once
MAX_THETAS = 100  # so many reversion rates get a plan branch each; more share one scan over arrays


def no_parameters() -> Column:
    return F.lit(None).cast(NO_PARAMETERS)


def rejected_scenarios(scenarios: DataFrame, lengths: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Scenarios that cannot be injected, with the first reason found.

    ``lengths`` is one row ``(series_id, n)`` per series.
    """
    known = F.array(*[F.lit(s) for s in sensors])
    family = canonical_family(F.col("family"))
    period = parameter(F.col("parameters"), "period", 24.0)
    reason = (
        F.when(F.coalesce(F.length("scenario_id"), F.lit(0)) == 0, "empty id")
        .when(family.isNull(), "unknown family")
        .when(F.col("n").isNull(), "unknown series")
        .when(F.col("onset") < 0, "negative onset")
        .when(F.col("duration") <= 0, "duration not positive")
        .when(F.col("onset") + F.col("duration") > F.col("n"), "interval leaves the series")
        .when(F.coalesce(F.size("sensors"), F.lit(0)) <= 0, "no sensors")
        .when(F.size(F.array_distinct("sensors")) < F.size("sensors"), "duplicate sensors")
        .when(F.size(F.array_except("sensors", known)) > 0, "unknown sensor")
        .when(F.isnan("amplitude") | (F.abs("amplitude") == float("inf")), "amplitude not finite")
        .when((family == "periodic") & (period <= 0), "period not positive")
    )
    return (
        scenarios.join(lengths, "series_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("series_id", "scenario_id", "reason")
    )


def _steps(scenarios: DataFrame) -> DataFrame:
    rows = scenarios.withColumn("family", canonical_family(F.col("family"))).filter("duration > 0")
    rows = spread(rows, "series_id", "scenario_id")  # few bytes would be few tasks, which then hold all cells
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration").cast("long") - 1)))


def _brownian(steps: DataFrame, seed: int) -> DataFrame:
    key = ["series_id", "scenario_id"]
    amp, p = F.col("amplitude"), F.col("parameters")
    usual = F.when(amp != 0, F.abs(amp) / F.sqrt("duration")).otherwise(1.0)
    noise = parameter(p, "mu", 0.0) + parameter(p, "sigma", usual) * gaussian(
        seed, F.col("scenario_id"), F.col("i").cast("string")
    )
    walk = prefix_sum(steps, key, {"delta": noise}, "i")
    scaled = parameter(p, "normalize", 0.0) > 0
    peaks = walk.filter(scaled).groupBy(*key).agg(F.max(F.abs("delta")).alias("_peak"))
    return walk.join(peaks, key, "left").withColumn(
        "delta", F.when(F.col("_peak") > 0, amp * F.col("delta") / F.col("_peak")).otherwise(F.col("delta"))
    ).drop("_peak")


_DELTA = T.StructField("delta", T.DoubleType())


def _reverting_step(columns: dict[str, np.ndarray], state: list[float] | None):
    """``s = rho * s + x`` of one scenario, whose ``rho`` is the same in every row."""
    out = geometric(columns["_x"], float(columns["_rho"][0]), state[0] if state else 0.0)
    return {"delta": out}, [float(out[-1])]


def _mean_reverting(steps: DataFrame, seed: int) -> DataFrame:
    key = ["series_id", "scenario_id"]
    amp, p = F.col("amplitude"), F.col("parameters")
    theta, dt = parameter(p, "theta", 0.1), parameter(p, "dt", 1.0)
    sigma = parameter(p, "sigma", F.when(amp != 0, 0.1 * F.abs(amp)).otherwise(0.1))
    target = parameter(p, "target", parameter(p, "mu", amp))
    kick = theta * target * dt + sigma * F.sqrt(dt) * gaussian(
        seed, F.col("scenario_id"), (F.col("i") - 1).cast("string")
    )
    steps = steps.withColumns(
        {"_rho": 1.0 - theta * dt, "_x": F.when(F.col("i") == 0, parameter(p, "delta0", 0.0)).otherwise(kick)}
    )
    ratios = [r[0] for r in steps.select("_rho").distinct().limit(MAX_THETAS + 1).collect()]
    if len(ratios) > MAX_THETAS:
        scanned = feedback_scan(steps.select(*key, "i", "_rho", "_x"), key, _reverting_step, [_DELTA], "i")
        return steps.drop("_rho", "_x").join(scanned, [*key, "i"])
    parts = [
        geometric_scan(steps.filter(F.col("_rho") == r), key, {"delta": F.col("_x")}, r, "i") for r in ratios
    ]
    out = parts[0] if parts else steps.withColumn("delta", F.lit(0.0))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_rho", "_x")


def scenario_deltas(scenarios: DataFrame, seed: int = 42, random: bool = True) -> DataFrame:
    """Sparse disturbance: ``(series_id, scenario_id, sensor, t, i, delta)`` on the support only.

    Random families are drawn from hashes of (seed, scenario, index). With
    ``random=False`` no scenario of a random family may be present. The rows ask to be
    merged: Spark takes them for as few as the scenarios' series they come from, and would
    send them whole through the driver.
    """
    steps = _steps(scenarios)
    fixed = steps.filter(~F.col("family").isin(RANDOM_FAMILIES)) if random else steps
    shape = waveform(F.col("family"), F.col("i"), F.col("duration"), F.col("amplitude"), F.col("parameters"))
    rows = fixed.withColumn("delta", shape)
    if random:
        rows = rows.unionByName(_brownian(steps.filter("family = 'brownian'"), seed))
        rows = rows.unionByName(_mean_reverting(steps.filter("family = 'ou'"), seed))
    return rows.select(
        "series_id", "scenario_id", F.explode("sensors").alias("sensor"),
        (F.col("onset") + F.col("i")).cast("long").alias("t"), "i", F.col("delta").cast("double").alias("delta"),
    ).hint("merge")


def fixed_peak(length: Column) -> Column:
    """Largest absolute disturbance of a scenario of a fixed family on the rows before ``length``."""
    family, rows = canonical_family(F.col("family")), F.least(F.col("duration"), length - F.col("onset")).cast("long")
    steps = F.when(rows > 0, F.sequence(F.lit(0).cast("long"), rows - 1))
    shape = lambda i: F.abs(waveform(family, i, F.col("duration"), F.col("amplitude"), F.col("parameters")))
    return F.array_max(F.transform(steps, shape))


def inject(clean: DataFrame, scenarios: DataFrame, seed: int = 42, random: bool = True) -> DataFrame:
    """Supported cells of every scenario: clean ``value``, ``delta`` and ``y = value + delta``.

    ``clean`` is long ``(series_id, sensor, t, value)``. Cells off the support are
    the clean ones, see ``inject_whole``.
    """
    return (
        scenario_deltas(scenarios, seed, random)
        .join(clean.select(*CELL, "value"), CELL)
        .withColumn("y", F.col("value") + F.col("delta"))
        .withColumn("support", F.lit(True))
    )


def inject_whole(
    clean: DataFrame, scenarios: DataFrame, seed: int = 42, random: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """Every cell of the scenario's series, once per scenario, with ``y, delta, support``.

    The result is scenarios x rows by definition; it is only for estimators that
    look at the whole series. Shapes are computed in the cells, which meet their scenarios on
    the series alone and are not shuffled again; only random families are joined. Columns
    ``keep`` of the scenarios go along.
    """
    ids = scenarios.select("series_id", "scenario_id", F.struct(*SHAPE).alias("_s"), *(F.col(c).alias(f"_k_{c}") for c in keep))
    cells = clean.select(*CELL, "value").join(ids.hint("merge"), "series_id")
    family, i = canonical_family(F.col("_s.family")), F.col("t") - F.col("_s.onset").cast("long")
    on = (i >= 0) & (i < F.col("_s.duration").cast("long")) & F.array_contains("_s.sensors", F.col("sensor"))
    shape = waveform(family, i, F.col("_s.duration"), F.col("_s.amplitude"), F.col("_s.parameters")).cast("double")
    cells = cells.withColumns({"support": F.coalesce(on, F.lit(False)), "delta": shape})
    if random:
        cells = cells.withColumn("support", F.col("support") & family.isNotNull())
        drawn = scenarios.filter(canonical_family(F.col("family")).isin(RANDOM_FAMILIES))
        drawn = scenario_deltas(drawn, seed).select(*SCENARIO_CELL, F.col("delta").alias("_drawn"))
        cells = cells.join(drawn, SCENARIO_CELL, "left").withColumn("delta", F.coalesce("delta", "_drawn"))
    delta = F.when(F.col("support"), F.coalesce("delta", F.lit(0.0))).otherwise(0.0)
    cells = cells.withColumn("delta", delta).withColumn("y", F.col("value") + F.col("delta"))
    return cells.select(*SCENARIO_CELL, "value", "delta", "support", "y", *(F.col(f"_k_{c}").alias(c) for c in keep))


def inject_open(
    clean: DataFrame, key: Sequence[str], family: str, t0: Column, *, c: float = 1.0, r: float = 0.01,
    amplitude: float = 1.0, frequency: float = 0.01, sensors: Sequence[str] | None = None, t: str = "t",
) -> DataFrame:
    """Disturbance from ``t0`` to the end of the series: step, ramp, periodic or coordinated."""
    since = (F.col(t) - t0).cast("double")
    shapes = {
        "none": F.lit(0.0),
        "step": F.lit(float(c)),
        "ramp": r * since,
        "periodic": amplitude * F.sin(2.0 * math.pi * frequency * since),
        "coordinated": F.when(F.col("sensor").isin(list(sensors)), float(c)).otherwise(0.0)
        if sensors is not None and "sensor" in clean.columns
        else F.lit(float(c)),
    }
    if family not in shapes:
        raise ValueError(f"unsupported family {family!r}")
    delta = F.when(F.col(t) >= t0, shapes[family]).otherwise(0.0)
    return clean.withColumn("delta", delta).withColumn("y", F.col("value") + F.col("delta"))


def inject_standardized(clean: DataFrame, scenarios: DataFrame, scales: DataFrame, random: bool = False) -> DataFrame:
    """Injection with amplitudes in train deviations; ``scales`` is ``(series_id, sensor, scale)``."""
    rows = inject(clean, scenarios, random=random).join(scales, ["series_id", "sensor"])
    return rows.withColumn("delta", F.col("delta") * F.col("scale")).withColumn(
        "y", F.col("value") + F.col("delta")
    )


def audit_injection(whole: DataFrame, by: Sequence[str], expected: str, mean: str, scale: str) -> DataFrame:
    """Ground-truth checks per scenario, and what a single-precision round trip would leak."""
    off = ~F.col("support")
    z = ((F.col("value") - F.col(mean)) / F.col(scale)).cast("float")
    standard_delta = F.col(expected) / F.col(scale)
    back = ((z.cast("double") + standard_delta).cast("float").cast("double") * F.col(scale) + F.col(mean)).cast("float")
    leak = back.cast("double") - F.col("value")
    return whole.groupBy(*by).agg(
        count_if(F.col("support")).alias("declared_support_count"),
        count_if(off & (F.col("delta") != 0)).alias("nonzero_off_support"),
        F.bool_and(F.col("y") == F.col("value") + F.col("delta")).alias("observed_is_sum"),
        F.bool_and(F.col("delta") == F.col(expected)).alias("delta_is_expected"),
        count_if(off & (leak != 0)).alias("single_precision_leaks"),
        F.coalesce(F.max(F.when(off, F.abs(leak))), F.lit(0.0)).alias("single_precision_max_leak"),
    )


# ------------------------------------------------------------------------ grids
def _pick(values: Sequence, index: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (index + 1).cast("int"))


def scenario_grid(
    spark: SparkSession, series_id: str, n: int, families: Sequence[str], channels: Sequence[str],
    durations: Sequence[int], onsets: Sequence[int], amplitudes: Sequence[float],
) -> DataFrame:
    """Full sweep in nested order, skipping intervals that leave the series.

    ``onsets`` may be a ``range``, whose members are computed and not written into the plan.
    """
    top = max(0, n - min(durations) - 1)
    if isinstance(onsets, range):
        # Onsets that fit a duration are the first ones of the range, or all if the last allowed one fits.
        fitting = [len(onsets) if top + d <= n else len(range(onsets.start, min(onsets.stop, n - d + 1), onsets.step)) for d in durations]
    else:
        spans = [(d, min(o, top)) for d, o in itertools.product(durations, onsets) if min(o, top) + d <= n]
        fitting = [len(spans)]
    a, s, c = len(amplitudes), sum(fitting), len(channels)
    at = F.col("id")
    rows = spark.range(len(families) * c * s * a)
    span = F.pmod(F.floor(at / a), F.lit(s))
    if isinstance(onsets, range):
        before = list(itertools.accumulate(fitting, initial=0))
        place = F.lit(0)
        for i in range(1, len(durations)):
            place = F.when(span >= before[i], i).otherwise(place)
        duration = _pick(durations, place, "long")
        number = span - _pick(before[:-1], place, "long")
        onset = F.least(onsets.start + number * onsets.step, F.lit(top)).cast("long")
    else:
        duration, onset = _pick([d for d, _ in spans], span, "long"), _pick([o for _, o in spans], span, "long")
    family = _pick(families, F.floor(at / (a * s * c)), "string")
    return rows.select(
        F.lit(series_id).alias("series_id"),
        F.format_string("sweep_%06d_%s", at, family).alias("scenario_id"),
        family.alias("family"),
        F.array(_pick(channels, F.pmod(F.floor(at / (a * s)), F.lit(c)), "string")).alias("sensors"),
        onset.alias("onset"),
        duration.alias("duration"),
        _pick(amplitudes, F.pmod(at, F.lit(a)), "double").alias("amplitude"),
        no_parameters().alias("parameters"),
    )


def scenario_cycle(
    spark: SparkSession, series_id: str, n: int, count: int, families: Sequence[str], channels: Sequence[str],
    durations: Sequence[int], onsets: Sequence[int], amplitudes: Sequence[float],
) -> DataFrame:
    """``count`` scenarios; the i-th takes every list at ``i mod length``."""
    top = max(0, n - min(durations) - 1)
    at = F.col("id")

    def cyc(values: Sequence, kind: str) -> Column:
        return _pick(values, F.pmod(at, F.lit(len(values))), kind)

    duration, onset = cyc(durations, "long"), cyc([min(o, top) for o in onsets], "long")
    centred = F.floor(F.greatest(F.lit(0), F.lit(n) - duration) / 2).cast("long")
    return spark.range(count).select(
        F.lit(series_id).alias("series_id"),
        F.format_string("batch_%06d_%s", at, cyc(families, "string")).alias("scenario_id"),
        cyc(families, "string").alias("family"),
        F.array(cyc(channels, "string")).alias("sensors"),
        F.when(onset + duration > n, centred).otherwise(onset).alias("onset"),
        duration.alias("duration"),
        cyc(amplitudes, "double").alias("amplitude"),
        no_parameters().alias("parameters"),
    )


def random_corpus(
    spark: SparkSession, series_id: str, n: int, channels: Sequence[str], total: int, seed: int = 42
) -> DataFrame:
    """``total`` scenarios over all families with hashed channel, duration, onset and amplitude."""
    per_family = max(1, total // len(FAMILIES))
    at = F.col("id")
    family = _pick(FAMILIES, F.floor(at / per_family), "string")
    number = F.pmod(at, F.lit(per_family))
    name = F.format_string("%s_%05d", family, number)
    duration = F.least(uniform_int(20, 100, seed, "duration", name), F.lit(n - 1)).cast("long")
    channel = uniform_int(0, len(channels), seed, "channel", name)
    return spark.range(min(total, per_family * len(FAMILIES))).select(
        F.lit(series_id).alias("series_id"),
        name.alias("scenario_id"),
        family.alias("family"),
        F.array(_pick(channels, channel, "string")).alias("sensors"),
        uniform_int(0, F.lit(n) - duration, seed, "onset", name).alias("onset"),
        duration.alias("duration"),
        (1.0 + 9.0 * uniform(seed, "amplitude", name)).alias("amplitude"),
        no_parameters().alias("parameters"),
    )


def check_envelope(
    clean: DataFrame, scenarios: DataFrame, deltas: DataFrame, bounds: DataFrame | None = None
) -> DataFrame:
    """Per scenario: cells outside ``[low, high]`` and the worst excess per channel.

    ``bounds`` is ``(sensor, low, high)``; a missing bound is open. By default the
    clean extremes per series and sensor serve, which no clean cell can break.
    With given bounds, clean cells already outside count too, unless supported.
    """
    eps = 1e-9
    key = ["series_id", "sensor"]
    if bounds is None:
        limits = clean.groupBy(*key).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    else:
        limits = clean.select(*key).distinct().join(bounds, "sensor", "left")

    def excess(rows: DataFrame, y: Column) -> DataFrame:
        low = F.coalesce("low", F.lit(float("-inf")))
        high = F.coalesce("high", F.lit(float("inf")))
        return (
            rows.join(limits, key)
            .withColumn("_under", F.greatest(F.lit(0.0), low - y))
            .withColumn("_over", F.greatest(F.lit(0.0), y - high))
            .filter((F.col("_under") > eps) | (F.col("_over") > eps))
            .drop("low", "high")
        )

    hit = excess(deltas.join(clean.select(*CELL, "value"), CELL), F.col("value") + F.col("delta"))
    columns = ["series_id", "scenario_id", "sensor", "_under", "_over"]
    cells = hit.select(*columns)
    if bounds is not None:
        already = excess(clean.select(*CELL, "value"), F.col("value"))
        outside = scenarios.select("series_id", "scenario_id").hint("merge").join(already, "series_id")
        outside = outside.join(deltas, ["series_id", "scenario_id", "sensor", "t"], "left_anti")
        cells = cells.unionByName(outside.select(*columns))
    worst = cells.groupBy("series_id", "scenario_id", "sensor").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_under").alias("_under"), F.max("_over").alias("_over")
    )

    def side(name: str) -> Column:  # at most one entry per sensor
        entry = F.when(F.col(name) > eps, F.struct("sensor", F.col(name).alias("excess")))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    found = worst.groupBy("series_id", "scenario_id").agg(
        F.sum("_n").alias("violation_count"),
        F.array_sort(F.collect_list("sensor")).alias("channels_violated"),
        side("_under").alias("min_violations"),
        side("_over").alias("max_violations"),
    )
    return (
        scenarios.select("series_id", "scenario_id")
        .join(found, ["series_id", "scenario_id"], "left")
        .withColumn("violation_count", F.coalesce("violation_count", F.lit(0).cast("long")))
        .withColumn("is_valid", F.col("violation_count") == 0)
    )


def first_valid_onset(
    clean: DataFrame, shapes: DataFrame, bounds: DataFrame, first: int, stop: Column, step: Column | None = None
) -> DataFrame:
    """Smallest onset in ``[first, stop)`` whose injection leaves no bound; null if none.

    ``shapes`` are scenarios without onset. A shape is evaluated once and slides along pieces
    of its series, which overlap by the longest shape: a task keeps the least headroom of
    every onset of a piece while it adds one step of the shape after the other, so neither
    onsets nor cells of shifted shapes become rows. Missing values leave no bound.
    """
    jump = F.lit(1).cast("long") if step is None else step.cast("long")
    longest = shapes.agg(F.max("duration")).first()[0]
    if longest is None:
        return shapes.drop("onset").withColumn("onset", F.lit(None).cast("long"))
    size = max(ONSETS, int(longest))
    still = shapes.drop("onset").withColumns({"onset": F.lit(0).cast("long"), "_stop": stop.cast("long"), "_jump": jump})
    deltas = scenario_deltas(still.drop("_stop", "_jump"), random=False).groupBy("series_id", "scenario_id", "sensor").agg(
        F.sort_array(F.collect_list(F.struct("i", "delta"))).alias("_d")
    )
    shape = still.select("series_id", "scenario_id", "_stop", "_jump").join(deltas.withColumn("_d", F.col("_d.delta")), ["series_id", "scenario_id"])
    limits = bounds.select("sensor", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    shape = shape.join(limits, "sensor", "left")
    cells = chunked(clean.select(*CELL, F.col("value").cast("double").alias("value")), ahead=int(longest) - 1, size=size)
    pieces = cells.groupBy("series_id", "sensor", "_chunk").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_x"))
    pieces = pieces.select("series_id", "sensor", "_chunk", F.col("_x.t").alias("_t"), F.col("_x.value").alias("_x"))
    met = pieces.join(shape.hint("merge"), ["series_id", "sensor"])
    # One row per shape and piece, its sensors in lists: a group of rows each would cost more than its work.
    low, high = (F.coalesce(c, F.lit(end)) for c, end in (("low", float("-inf")), ("high", float("inf"))))
    lists = {"_t": F.col("_t"), "_x": F.col("_x"), "_d": F.col("_d"), "_low": low, "_high": high}
    rows = met.groupBy("series_id", "scenario_id", "_chunk").agg(
        F.first("_stop").alias("_stop"), F.first("_jump").alias("_jump"), *[F.collect_list(c).alias(name) for name, c in lists.items()]
    )

    names = ["_chunk", "_stop", "_jump", *lists]

    def earliest(chunk: int, stop: int, jump: int, sensors: Iterable[tuple]) -> int:
        start = chunk * size
        onsets = np.arange(first + max(0, -(-(start - first) // jump)) * jump, min(stop, start + size), jump)
        fine, cells = np.ones(len(onsets), dtype=bool), np.zeros(len(onsets), dtype=np.int64)
        for times, values, deltas, low, high in sensors:
            times, deltas = np.asarray(times, dtype=np.int64) - start, np.asarray(deltas, dtype=float)
            last = max(int(onsets[-1]) - start if len(onsets) else 0, int(times[-1]))
            x = np.full(last + len(deltas) + 1, np.nan)
            x[times] = np.asarray(values, dtype=float)
            for i, delta in enumerate(deltas):
                at = x[onsets - start + i]
                y = at + delta
                fine &= ~((y < low - 1e-9) | (y > high + 1e-9))
                cells += ~np.isnan(at)
        found = onsets[fine & (cells > 0)]
        return int(found[0]) if len(found) else -1

    def slide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [
                earliest(int(chunk), int(stop), int(jump), zip(*sensors))
                for chunk, stop, jump, *sensors in zip(*(part[c] for c in names))
            ]
            out = part[["series_id", "scenario_id"]].assign(onset=np.array(found, dtype=np.int64))
            yield out[out["onset"] >= 0]

    fields = T.StructType([shapes.schema["series_id"], shapes.schema["scenario_id"], T.StructField("onset", T.LongType())])
    found = rows.mapInPandas(slide, fields)
    best = found.groupBy("series_id", "scenario_id").agg(F.min("onset").alias("onset"))
    return shapes.drop("onset").join(best, ["series_id", "scenario_id"], "left")


def scenario_ledger(scenarios: DataFrame, deltas: DataFrame, lengths: DataFrame, channel_count: int) -> DataFrame:
    """One descriptive row per scenario with norms of its disturbance."""
    norms = deltas.groupBy("series_id", "scenario_id").agg(
        F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("l2_norm"),
        F.max(F.abs("delta")).alias("max_abs_delta"),
        F.count(F.lit(1)).alias("_cells"),
    )
    return (
        scenarios.join(norms, ["series_id", "scenario_id"])
        .join(lengths, "series_id")
        .select(
            "series_id", "scenario_id", canonical_family(F.col("family")).alias("family"),
            F.concat_ws(",", "sensors").alias("target_channels"),
            F.size("sensors").cast("long").alias("target_channel_count"),
            "onset", "duration", "amplitude",
            F.coalesce(F.to_json("parameters"), F.lit("{}")).alias("parameters"),
            "l2_norm", "max_abs_delta",
            (F.col("_cells") / (F.col("n") * channel_count)).alias("support_fraction"),
        )
    )


def regime_cutoffs(df: DataFrame, key: Sequence[str], value: str, t: str = "t", quantiles=(1 / 3, 2 / 3)) -> DataFrame:
    """The two quantiles of the absolute first difference, ``q1`` and ``q2`` per key."""
    rows = with_lag(df, key, {"_lag": (value, 1)}, t).withColumn("_d", F.abs(F.col(value) - F.col("_lag")))
    q = exact_quantiles(rows, key, "_d", list(quantiles), "_q")
    return q.groupBy(*key).agg(F.min("_q").alias("q1"), F.max("_q").alias("q2"))


def regimes(df: DataFrame, cutoffs: DataFrame, key: Sequence[str], value: str, previous: str | None = None, t: str = "t") -> DataFrame:
    """Add ``regime`` from the absolute first difference; row 0 uses ``previous`` or counts as 0."""
    rows = with_lag(df, key, {"_lag": (value, 1)}, t).join(cutoffs, list(key))
    options = [F.col("_lag")] + ([F.col(previous)] if previous else [])
    step = F.abs(F.col(value) - F.coalesce(*options, F.col(value)))
    name = F.when(step < F.col("q1"), REGIMES[0]).when(step < F.col("q2"), REGIMES[1]).otherwise(REGIMES[2])
    return rows.withColumn("regime", name).drop("_lag", "q1", "q2")


def hash_rank(df: DataFrame, by: Sequence[str], seed: int, context: Column, candidate: str, top: int) -> DataFrame:
    """The first ``top`` candidates per group in seeded hash order, 0-based ``rank``.

    A bounded rank lets Spark keep ``top`` rows per task before the shuffle.
    """
    rows = df.withColumn("_digest", seeded_digest(seed, context, F.col(candidate)))
    w = Window.partitionBy(*by).orderBy("_digest", candidate)
    return (
        rows.withColumn("_place", F.row_number().over(w))
        .filter(F.col("_place") <= top)
        .withColumn("rank", F.col("_place") - 1)
        .drop("_digest", "_place")
    )


def stratified_grid(
    classified: DataFrame, lengths: DataFrame, seed: int, amplitudes: Sequence[float], durations: Sequence[int],
    signs: Sequence[int], repeats: int, train_std: DataFrame, name: str = "dev",
) -> DataFrame:
    """Step scenarios balanced over regimes, onsets in seeded hash order without repetition.

    ``classified`` is ``(series_id, t, regime)`` of the block, ``t`` from 0. Repetition r of
    combination c takes regime ``(c + r) mod 3`` and therein the candidate of
    rank ``r div 3``, so onsets are one join and no loop.
    """
    combos = list(itertools.product(amplitudes, durations, signs))
    combo = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("combo"), F.lit(float(a)).alias("amplitude_std"),
                    F.lit(int(d)).cast("long").alias("duration"), F.lit(int(s)).alias("sign"),
                )
                for i, (a, d, s) in enumerate(combos)
            ]
        )
    )
    candidates = (
        classified.join(lengths, "series_id")
        .withColumn("_combo", combo)
        .select("*", "_combo.*")
        .filter(F.col("t") + F.col("duration") <= F.col("n"))
    )
    context = F.format_string("%.2f_%d_%d_%s", "amplitude_std", "duration", "sign", "regime")
    by = ["series_id", "combo", "regime"]
    ranked = hash_rank(candidates, by, seed, context, "t", -(-repeats // len(REGIMES)))
    index = F.array_position(F.array(*[F.lit(r) for r in REGIMES]), F.col("regime")).cast("int") - 1
    rep = F.pmod(index - F.col("combo"), F.lit(len(REGIMES))) + F.col("rank") * len(REGIMES)
    text = f"{name}_amp%.2f_dur%02d_sign%+d_%s_rep%d"
    return (
        ranked.withColumn("rep", rep)
        .filter(F.col("rep") < repeats)
        .join(train_std, "series_id")
        .select(
            "series_id",
            F.format_string(text, "amplitude_std", "duration", "sign", "regime", "rep").alias("scenario_id"),
            "amplitude_std", "sign", "duration", F.col("t").alias("onset"),
            (F.col("t") + F.col("duration")).alias("offset"), "regime",
            (F.col("sign") * F.col("amplitude_std") * F.col("train_std")).alias("amplitude"),
        )
    )


def grid_shortfall(
    grid: DataFrame, series: DataFrame, amplitudes: Sequence[float], durations: Sequence[int],
    signs: Sequence[int], repeats: int,
) -> DataFrame:
    """Scenarios that ``stratified_grid`` had no onset left for, counted per cell.

    Repetition r of combination c belongs to regime ``(c + r) mod 3``; the grid is complete
    if nothing is returned.
    """
    cells = [
        (float(a), int(d), int(s), REGIMES[regime], sum((i + r) % len(REGIMES) == regime for r in range(repeats)))
        for i, (a, d, s) in enumerate(itertools.product(amplitudes, durations, signs))
        for regime in range(len(REGIMES))
    ]
    names = ["amplitude_std", "duration", "sign", "regime", "wanted"]
    kinds = ["double", "long", "int", "string", "long"]
    wanted = F.explode(F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(c, kinds, names)]) for c in cells]))
    every = series.withColumn("_c", wanted).select("series_id", "_c.*")
    by = ["series_id", "amplitude_std", "duration", "sign", "regime"]
    had = grid.groupBy(*by).agg(F.count(F.lit(1)).alias("had"))
    missing = F.col("wanted") - F.coalesce("had", F.lit(0))
    return every.join(had, by, "left").select(*by, missing.alias("missing")).filter("missing > 0")


def require_full_grid(grid: DataFrame, expected: int) -> DataFrame:
    """Fail when a regime ran out of candidate onsets (one count per series)."""
    short = grid.groupBy("series_id").count().filter(F.col("count") < expected)
    if not short.isEmpty():
        raise ValueError("a regime has fewer candidate onsets than the grid needs")
    return grid


def family_grid(lengths: DataFrame, train_std: DataFrame, per_family: int = 10) -> DataFrame:
    """Ten scenarios per family for every series, all choices by modulo."""
    # The grid's families, amplitudes, signs and durations.
    families = ["step", "ramp", "drift", "pulse", "sinusoid"]
    amplitudes, signs, durations = [0.5, 1.0, 1.5, 2.0], [1, -1], [12, 24, 48]
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(family).alias("family"), F.lit(s).alias("s"),
                    F.lit(amplitudes[s % 4]).alias("amplitude_std"),
                    F.lit(signs[s // 4 % 2]).alias("sign"),
                    F.lit(durations[s % 3]).cast("long").alias("duration"),
                )
                for family in families for s in range(per_family)
            ]
        )
    )
    room = F.greatest(F.lit(1), F.col("n") - F.col("duration") - 48)
    onset = (24 + F.pmod(F.col("s") * 37, room)).cast("long")
    parameters = F.when(F.col("family") == "pulse", F.create_map(F.lit("pulse_width"), F.lit(3.0))).when(
        F.col("family") == "sinusoid", F.create_map(F.lit("period"), F.lit(12.0))
    ).when(
        F.col("family") == "drift",
        F.create_map(
            F.lit("rate"),
            F.col("sign") * F.col("amplitude_std") * F.col("train_std") / F.greatest(F.lit(1), F.col("duration")),
        ),
    )
    every = lengths.join(train_std, "series_id").withColumn("_cell", cells).select("*", "_cell.*")
    return every.withColumn("onset", onset).select(
        "series_id",
        F.format_string(
            "%s_amp%.1f_dur%02d_sign%+d_idx%02d", "family", "amplitude_std", "duration", "sign", "s"
        ).alias("scenario_id"),
        "family", "amplitude_std", "sign", "duration", "onset",
        (F.col("onset") + F.col("duration")).alias("offset"),
        (F.col("sign") * F.col("amplitude_std") * F.col("train_std")).alias("amplitude"),
        parameters.alias("parameters"),
    )

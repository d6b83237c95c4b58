"""Anomaly scores on ordered series and their supports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.linear import column_moments
from tidegauge.operators.ordered import (
    Step,
    feedback_scan,
    geometric_scan,
    longest_series,
    reflected_sum,
    with_runs,
)
from tidegauge.operators.scaling import apply_scaler, fit_scaler, persistence_residual
from tidegauge.session import staged


HELD_GRAMS = 256  # Gram matrices of different keys that a task holds
MAX_SENT_KEYS = 10_000  # axes of more keys are joined by a shuffle and not sent to every task
EXPRESSION_TERMS = 64  # larger projections leave the generated code


def _greatest(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def cusum(
    df: DataFrame, key: Sequence[str], y: Column, mu0: Column, k: Column, h: Column, t: str = "t"
) -> DataFrame:
    """One-sided upper CUSUM without reset: adds ``s`` and ``alarm``."""
    rows = reflected_sum(df, key, {"s": y - mu0 - k}, t)
    return rows.withColumn("alarm", F.col("s") > h)


def reset_scan(drift: np.ndarray, limit: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``S = max(0, S + x)`` per column, all columns to zero after a row whose largest is over its limit.

    Rows are added one by one, as the recurrence says: running sums less their minimum round
    otherwise, and on short decimals a statistic often equals its limit.
    Returns the statistics before the reset, their largest, and the state at the end.
    """
    before, largest = [], []
    if drift.shape[1] == 1:
        s = float(state[0])
        for x, h in zip(drift[:, 0].tolist(), limit.tolist()):
            s += x
            if s <= 0.0:
                s = 0.0
            before.append(s)
            if s > h:
                s = 0.0
        found = np.array(before, dtype=float).reshape(-1, 1)
        return found, found[:, 0].copy(), np.array([s])
    now, zero = state.tolist(), [0.0] * drift.shape[1]
    for row, h in zip(drift.tolist(), limit.tolist()):
        now = [0.0 if s + x <= 0.0 else s + x for s, x in zip(now, row)]
        before.append(now)
        largest.append(max(now))
        if largest[-1] > h:
            now = zero
    return np.array(before, dtype=float).reshape(drift.shape), np.array(largest, dtype=float), np.array(now)


def reset_step(y: str, mu0: str, k: str, h: str) -> Step:
    """One ordered piece of a CUSUM with reset; state ``[s]``."""

    def step(columns: dict[str, np.ndarray], state: list[float] | None):
        drift = (columns[y] - columns[mu0] - columns[k]).astype(float)
        limit = columns[h].astype(float)
        _, before, state = reset_scan(drift[:, None], limit, np.array(state or [0.0]))
        alarms = before > limit
        return {"stat_before": before, "stat_after": np.where(alarms, 0.0, before), "alarm": alarms}, state.tolist()

    return step


RESET_FIELDS = [
    T.StructField("stat_before", T.DoubleType()),
    T.StructField("stat_after", T.DoubleType()),
    T.StructField("alarm", T.BooleanType()),
]


def adaptive_step(y: str, mean: str, std: str, gate: str, alpha: str, slack: float, limit: float) -> Step:
    """One ordered piece of the gated adaptive CUSUM; state ``[s, mu]``."""

    def step(columns: dict[str, np.ndarray], state: list[float] | None):
        scale = float(columns[std][0])
        width, rate = float(columns[gate][0]) * scale, float(columns[alpha][0])
        s, mu = state if state else (0.0, float(columns[mean][0]))
        values = columns[y].astype(float)
        before, levels = np.empty(len(values)), np.empty(len(values))
        for i, x in enumerate(values.tolist()):
            if abs(x - mu) <= width:
                mu += rate * (x - mu)
            s = max(0.0, s + x - mu - slack * scale)
            before[i], levels[i] = s, mu
            if s > limit * scale:
                s = 0.0
        return {"mu": levels, "stat_before": before, "alarm": before > limit * scale}, [s, mu]

    return step


ADAPTIVE_FIELDS = [
    T.StructField("mu", T.DoubleType()),
    T.StructField("stat_before", T.DoubleType()),
    T.StructField("alarm", T.BooleanType()),
]


def cusum_reset(
    df: DataFrame, key: Sequence[str], y: str, mu0: str, k: str, h: str, t: str = "t", **options
) -> DataFrame:
    """One-sided CUSUM that restarts at zero after an alarm.

    Returns key, t, ``stat_before`` (tested against h), ``stat_after`` and ``alarm``.
    """
    columns = df.select(*dict.fromkeys([*key, t, y, mu0, k, h]))
    return feedback_scan(columns, key, reset_step(y, mu0, k, h), RESET_FIELDS, t, **options)


def adaptive_cusum(
    df: DataFrame, key: Sequence[str], y: str, mean: str, std: str, gate: str, alpha: str,
    t: str = "t", slack: float = 0.5, limit: float = 5.0, **options,
) -> DataFrame:
    """CUSUM with reset around a baseline that only follows samples inside the gate.

    ``mean``, ``std``, ``gate`` and ``alpha`` are columns, so one call runs a grid of
    settings crossed into the key. Returns key, t, ``mu``, ``stat_before``, ``alarm``.
    """
    columns = df.select(*dict.fromkeys([*key, t, y, mean, std, gate, alpha]))
    step = adaptive_step(y, mean, std, gate, alpha, slack, limit)
    return feedback_scan(columns, key, step, ADAPTIVE_FIELDS, t, **options)


def cusum_score(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], slack: float = 0.5, t: str = "t",
    out: str = "cusum", longest: int | None = None,
) -> DataFrame:
    """Two-sided multivariate CUSUM score: the largest side over all sensors."""
    steps = {}
    for c in cols:
        steps[f"_up_{c}"] = F.col(c) - slack
        steps[f"_dn_{c}"] = -F.col(c) - slack
    rows = reflected_sum(df, key, steps, t, longest=longest)
    return rows.withColumn(out, _greatest([F.col(c) for c in steps])).drop(*steps)


def cusum_score_reset(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], reset: str, slack: float = 0.5,
    t: str = "t", out: str = "cusum", **options,
) -> DataFrame:
    """As ``cusum_score``, but a score above the ``reset`` column zeroes every sensor's state.

    The returned score is the one before the reset.
    """
    cols = list(cols)

    def step(columns: dict[str, np.ndarray], state: list[float] | None):
        z = np.column_stack([columns[c] for c in cols]).astype(float)
        both = np.concatenate([z, -z], axis=1) - slack
        start = np.array(state) if state else np.zeros(both.shape[1])
        _, score, end = reset_scan(both, columns[reset].astype(float), start)
        return {out: score}, end.tolist()

    fields = [T.StructField(out, T.DoubleType())]
    return feedback_scan(df.select(*key, t, *cols, reset), key, step, fields, t, **options)


def ewma_score(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], alpha: float = 0.2, t: str = "t",
    out: str = "ewma", longest: int | None = None,
) -> DataFrame:
    """Largest absolute exponentially weighted mean over the sensors."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    rows = geometric_scan(df, key, {f"_e_{c}": alpha * F.col(c) for c in cols}, 1.0 - alpha, t, longest)
    states = [f"_e_{c}" for c in cols]
    return rows.withColumn(out, _greatest([F.abs(F.col(c)) for c in states])).drop(*states)


def principal_axes(train: DataFrame, cols: Sequence[str], components: int) -> list[list[float]]:
    """Top right singular vectors of the (already standardised) train matrix.

    The Gram matrix is summed on the executors; only sensors x sensors reach the driver.
    """
    if not 1 <= components <= len(cols):
        raise ValueError("components must be between 1 and the sensor count")
    gram = column_moments(train, cols)[1:, 1:]
    values, axes = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:components]
    return axes[:, order].T.tolist()


def keyed_axes(train: DataFrame, key: Sequence[str], cols: Sequence[str], components: int) -> DataFrame:
    """``principal_axes`` of every key by itself: the key and ``axes``, one array per component.

    A task sums the products of its Arrow batches key by key, up to ``HELD_GRAMS`` keys at a
    time; cells of the Gram matrices are summed on, and one matrix a key gives the axes.
    """
    key, cols = list(key), list(cols)
    if not 1 <= components <= len(cols):
        raise ValueError("components must be between 1 and the sensor count")
    width = len(cols)
    fields = [train.schema[k] for k in key]
    grams = T.StructType([*fields, T.StructField("gram", T.ArrayType(T.DoubleType()))])
    found = T.StructType([*fields, T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def told() -> pa.RecordBatch:
            names = [pd.Series(list(part), dtype=object) for part in zip(*sums)]
            columns = [pa.array(n, kind, from_pandas=True) for n, kind in zip(names, kinds)]
            matrices = pa.array([gram.ravel() for gram in sums.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*columns, matrices], names=[*key, "gram"])

        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(key))]
            for name, part in batch.to_pandas().groupby(key, dropna=False):
                x = part[cols].to_numpy(float)
                sums[name] = sums.get(name, 0.0) + x.T @ x
            if len(sums) > HELD_GRAMS:
                yield told()
                sums.clear()
        if sums:
            yield told()

    def axes(part: pd.DataFrame) -> pd.DataFrame:
        gram = np.array(part["gram"].iloc[0]).reshape(width, width)
        values, vectors = np.linalg.eigh(gram)
        top = np.argsort(values)[::-1][:components]
        return part[key].head(1).assign(axes=[vectors[:, top].T.tolist()])

    values = train.select(*key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    cells = values.mapInArrow(partial, grams).select(*key, F.posexplode("gram").alias("cell", "part"))
    sums = cells.groupBy(*key, "cell").agg(F.sum("part").alias("part"))
    whole = sums.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("cell", "part"))).alias("cells"))
    return whole.select(*key, F.col("cells.part").alias("gram")).groupBy(*key).applyInPandas(axes, found)


def keyed_spe_score(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], axes: DataFrame, out: str = "pca_spe"
) -> DataFrame:
    """``spe_score`` with every key's own axes from ``keyed_axes``."""
    cols = list(cols)
    total = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    x = F.array(*cols)
    dots = F.transform(
        "_axes", lambda axis: F.aggregate(F.zip_with(axis, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    )
    kept = F.aggregate(dots, F.lit(0.0), lambda s, v: s + v * v)
    small = axes.withColumnRenamed("axes", "_axes")
    if small.limit(MAX_SENT_KEYS + 1).count() <= MAX_SENT_KEYS:
        small = F.broadcast(small)
    return df.join(small, list(key), "left").withColumn(out, total - kept).drop("_axes")


def spe_score(
    df: DataFrame, cols: Sequence[str], axes: Sequence[Sequence[float]], out: str = "pca_spe"
) -> DataFrame:
    """Squared residual after projection on the principal axes.

    A few terms stay one column expression; a wide projection is one matrix
    product per Arrow batch, without a shuffle either way.
    """
    cols = list(cols)
    if len(cols) * len(axes) <= EXPRESSION_TERMS:
        total = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
        kept = F.lit(0.0)
        for axis in axes:
            dot = sum((F.col(c) * F.lit(float(a)) for c, a in zip(cols, axis)), F.lit(0.0))
            kept = kept + dot * dot
        return df.withColumn(out, total - kept)
    basis = np.array(axes).T
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {name: i for i, name in enumerate(batch.schema.names)}
            x = np.column_stack([batch.column(place[c]).to_numpy(zero_copy_only=False) for c in cols])
            score = pa.array((x * x).sum(axis=1) - ((x @ basis) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, out])

    return df.mapInArrow(project, schema)


def standardised(
    df: DataFrame, train: DataFrame, key: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    return apply_scaler(df, fit_scaler(train, key, cols), key, cols)


def baseline_scores(
    train: DataFrame, df: DataFrame, key: Sequence[str], cols: Sequence[str], alpha: float = 0.2,
    components: int = 1, slack: float = 0.5, reset: str | None = None, prefix: str = "", t: str = "t",
) -> DataFrame:
    """CUSUM, EWMA and PCA residual scores of ``df`` standardised from ``train``."""
    params = fit_scaler(train, key, cols)
    axes = staged(keyed_axes(apply_scaler(train, params, key, cols), key, cols, components), "axes")
    rows = keyed_spe_score(apply_scaler(df, params, key, cols), key, cols, axes, f"{prefix}pca_spe")
    longest = longest_series(df, t)
    rows = ewma_score(rows, key, cols, alpha, t, f"{prefix}ewma", longest)
    if reset is None:
        return cusum_score(rows, key, cols, slack, t, f"{prefix}cusum", longest).drop(*cols)
    reset_scores = cusum_score_reset(rows, key, cols, reset, slack, t, f"{prefix}cusum")
    return rows.drop(*cols, reset).join(reset_scores, [*key, t])


def residual_baseline_scores(
    train: DataFrame, df: DataFrame, key: Sequence[str], cols: Sequence[str],
    preceding: dict[str, str] | None = None, t: str = "t", **options,
) -> DataFrame:
    """The score pack on one-step differences, names prefixed ``residual_``."""
    train_diff = persistence_residual(train, key, cols, t)
    rows = persistence_residual(df, key, cols, t, preceding)
    if preceding:
        rows = rows.drop(*preceding.values())
    return baseline_scores(train_diff, rows, key, cols, prefix="residual_", t=t, **options)


def consensus_alarm(
    events: DataFrame, index: DataFrame, key: Sequence[str], min_sensors: int, cooldown: int, t: str = "t"
) -> DataFrame:
    """1 where at least ``min_sensors`` distinct sensors had an event in the last ``cooldown`` rows."""
    active = (
        events.withColumn(t, F.explode(F.sequence(F.col(t), F.col(t) + cooldown - 1)))
        .groupBy(*key, t)
        .agg(F.count_distinct("sensor").alias("_sensors"))
    )
    return (
        index.join(active, [*key, t], "left")
        .withColumn("alarm", (F.coalesce("_sensors", F.lit(0)) >= min_sensors).cast("int"))
        .drop("_sensors")
    )


def residual_score(df: DataFrame, key: Sequence[str], observed: str, predicted: str, scale: str, t: str = "t") -> DataFrame:
    """Largest scaled absolute forecast error over the sensors of each timestep (long rows)."""
    error = F.abs((F.col(observed) - F.col(predicted)) / F.col(scale))
    return df.groupBy(*key, t).agg(F.max(error).alias("score"))


def shift_estimate(df: DataFrame, key: Sequence[str], y: str, mu0: Column, t0: Column, width: int, t: str = "t") -> DataFrame:
    """Mean of the window ``[t0, t0+width)`` relative to ``mu0``."""
    inside = df.filter((F.col(t) >= t0) & (F.col(t) < t0 + width))
    return inside.groupBy(*key).agg((F.avg(F.col(y) - mu0)).alias("shift"))


def shift_fraction(
    train: DataFrame, test_normal: DataFrame, key: Sequence[str], sensor: str, value: str, limit: float = 0.5
) -> DataFrame:
    """Share of varying sensors whose test-normal mean left the train mean by over ``limit`` sigma.

    Long rows; the two-level aggregate never holds more than one row per sensor.
    """
    fit = (
        train.groupBy(*key, sensor)
        .agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        .filter(F.col("_s") > 1e-12)
    )
    test = test_normal.groupBy(*key, sensor).agg(F.avg(value).alias("_x"))
    moved = (F.abs((F.col("_x") - F.col("_m")) / F.col("_s")) > limit).cast("int")
    return (
        fit.join(test, [*key, sensor])
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("valid_sensors"), F.avg(moved).alias("shift_fraction"))
    )


def temporal_support(
    df: DataFrame, key: Sequence[str], residual: Column, start: Column, proceed: Column,
    min_duration: int, t: str = "t",
) -> DataFrame:
    """Hysteresis support: runs at or above ``proceed`` with a seed at or above ``start``.

    ``residual`` is already divided by the sensor scale. Adds ``support``.
    """
    if min_duration < 1:
        raise ValueError("min_duration must be positive")
    size = F.abs(residual)
    rows = with_runs(df.withColumn("_size", size), key, size >= proceed, t)
    runs = (
        rows.filter(F.col("run_start").isNotNull())
        .groupBy(*key, "run_start")
        .agg(F.max((F.col("_size") >= start).cast("int")).alias("_seed"), F.count(F.lit(1)).alias("_len"))
        .filter((F.col("_seed") == 1) & (F.col("_len") >= min_duration))
        .select(*key, "run_start", F.lit(True).alias("_kept"))
    )
    return (
        rows.join(runs, [*key, "run_start"], "left")
        .withColumn("support", F.coalesce("_kept", F.lit(False)))
        .drop("_kept", "_size", "run_start")
    )


def threshold_delta(delta: Column, scale: Column, threshold: Column) -> Column:
    """Zero estimates whose scaled size is below the sensor's threshold."""
    return F.when(F.abs(delta / scale) >= threshold, delta).otherwise(F.lit(0.0))

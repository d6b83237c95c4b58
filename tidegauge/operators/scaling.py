"""Scaling, imputation, differences and feature windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegauge.operators.ordered import CHUNK, chunk_window, chunked, fill, own_rows, with_lag
from tidegauge.operators.quantiles import exact_quantiles
from tidegauge.session import staged

EPS64 = 2.220446049250313e-16
EPS32 = 1.1920928955078125e-07


def fit_scaler(train: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key with ``mean_<c>`` and population ``std_<c>`` of the train rows."""
    return train.groupBy(*key).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in cols],
    )


@F.pandas_udf(T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())]))
def _moments(values: pd.Series) -> pd.DataFrame:
    means, stds = [], []
    for xs in values:
        total = mean = squares = 0.0
        n = 0
        for x in xs.tolist():
            n += 1
            total += x
            gap = x - mean
            mean += gap / n
            squares += (x - mean) * gap
        means.append(total / n if n else None)
        stds.append(math.sqrt(squares / n) if n else None)
    return pd.DataFrame({"mean": means, "std": stds}, dtype="float64")


def fit_in_order(train: DataFrame, key: Sequence[str], col: str, longest: int, t: str = "t") -> DataFrame:
    """``fit_scaler`` of one column whose last bits do not depend on how rows were split.

    Values are added in the order of ``t``, the squares by Welford's recurrence, as the twins
    do: where a value equals a threshold up to rounding, that decides. Keys are read whole
    by a task, so with more than a chunk of rows in one (``longest``) sums by parts serve.
    """
    if longest > CHUNK:
        return fit_scaler(train, key, [col])
    value = F.when(F.col(col).isNotNull(), F.struct(t, F.col(col).cast("double").alias("_v")))
    rows = train.groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias("_x"))
    rows = rows.withColumn("_m", _moments(F.col("_x._v")))
    return rows.select(*key, F.col("_m.mean").alias(f"mean_{col}"), F.col("_m.std").alias(f"std_{col}"))


def guarded_scale(std: Column, floor: float = EPS64, strict: bool = True) -> Column:
    """``std`` if it is above ``floor`` (or not below it when not strict), else 1."""
    usable = std > floor if strict else std >= floor
    return F.when(usable, std).otherwise(F.lit(1.0))


def apply_scaler(
    df: DataFrame,
    params: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    floor: float = EPS64,
    clip: float | None = None,
    prefix: str = "",
    strict: bool = True,
) -> DataFrame:
    """z-score ``cols`` with fitted parameters; ``clip`` bounds the result to ±clip."""
    joined = df.join(params, list(key))
    drop = [f"{p}_{c}" for p in ("mean", "std") for c in cols]
    out = {}
    for c in cols:
        z = (F.col(c) - F.col(f"mean_{c}")) / guarded_scale(F.col(f"std_{c}"), floor, strict)
        if clip is not None:
            z = F.greatest(F.least(z, F.lit(float(clip))), F.lit(-float(clip)))
        out[f"{prefix}{c}"] = z
    return joined.withColumns(out).drop(*drop)


def invert_scaler(
    df: DataFrame, params: DataFrame, key: Sequence[str], cols: Sequence[str], floor: float = EPS64
) -> DataFrame:
    joined = df.join(params, list(key))
    out = {
        c: F.col(c) * guarded_scale(F.col(f"std_{c}"), floor) + F.col(f"mean_{c}") for c in cols
    }
    return joined.withColumns(out).drop(*[f"{p}_{c}" for p in ("mean", "std") for c in cols])


def usable_sensors(train: DataFrame, cols: Sequence[str]) -> list[str]:
    """Sensors with at least one train value (one aggregate row reaches the driver)."""
    counts = train.agg(*[F.count(c).alias(c) for c in cols]).first()
    keep = [c for c in cols if counts[c]]
    if not keep:
        raise ValueError("every sensor is null in the train rows")
    return keep


def train_medians(train: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact medians per key as one row with ``median_<c>`` columns."""
    long = train.unpivot(list(key), list(cols), "sensor", "_value")
    medians = exact_quantiles(long, [*key, "sensor"], "_value", [0.5], "_median")
    return medians.groupBy(*key).agg(
        *[F.max(F.when(F.col("sensor") == c, F.col("_median"))).alias(f"median_{c}") for c in cols]
    )


def prepare_features(
    df: DataFrame, train: DataFrame, key: Sequence[str], cols: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Drop sensors without any train value and fill the rest with train medians.

    The filled rows are written once; every later fit and score reads them.
    """
    keep = usable_sensors(train, cols)
    dropped = [c for c in cols if c not in keep]
    joined = df.drop(*dropped).join(train_medians(train, key, keep), list(key))
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"median_{c}")) for c in keep})
    return staged(filled.drop(*[f"median_{c}" for c in keep]), "filled"), keep


def persistence_residual(
    df: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    t: str = "t",
    preceding: dict[str, str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """First difference; the first row uses its ``preceding`` column, else itself (zero)."""
    rows = with_lag(df, key, {f"_lag_{c}": (c, 1) for c in cols}, t)
    out = {}
    for c in cols:
        options = [F.col(f"_lag_{c}")]
        if preceding:
            options.append(F.col(preceding[c]))
        out[f"{prefix}{c}"] = F.col(c) - F.coalesce(*options, F.col(c))
    return rows.withColumns(out).drop(*[f"_lag_{c}" for c in cols])


def context_windows(
    df: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    target: Sequence[str],
    length: int,
    mode: str = "same",
    pad_initial: bool = False,
    t: str = "t",
) -> DataFrame:
    """Feature windows of ``length`` rows with their target.

    ``same``: rows ``t-length+1..t`` predict ``t``; ``next``: rows ``t-length..t-1``
    predict ``t``. Incomplete windows are dropped, or filled on the left with
    the first row when ``pad_initial``. One ``x_<c>`` array per feature.
    """
    if length < 1 or mode not in ("same", "next"):
        raise ValueError("length must be positive and mode 'same' or 'next'")
    if set(features) & set(target) and mode == "same":
        raise ValueError("a target cannot be its own feature")
    shift = 0 if mode == "same" else 1
    rows = chunked(df, t, back=length - 1 + shift)
    w = chunk_window(key, t).rowsBetween(-(length - 1) - shift, -shift)
    rows = own_rows(
        rows.select("*", *[F.collect_list(F.struct(t, c)).over(w).alias(f"_w_{c}") for c in features])
    )
    full = F.col(f"_w_{features[0]}")
    rows = rows.withColumns({f"x_{c}": F.col(f"_w_{c}")[c] for c in features})
    if pad_initial:
        rows = rows.filter(F.size(full) > 0)
        rows = rows.withColumns(
            {
                f"x_{c}": F.concat(
                    F.array_repeat(F.col(f"x_{c}")[0], F.lit(length) - F.size(f"x_{c}")),
                    F.col(f"x_{c}"),
                )
                for c in features
            }
        )
    else:
        rows = rows.filter(F.size(full) == length)
    return rows.select(*key, t, *[f"x_{c}" for c in features], *target)


def centre_window(df: DataFrame, scenarios: DataFrame, key: Sequence[str], half: int, t: str = "t") -> DataFrame:
    """Rows of the ``2*half`` window around each scenario's midpoint, onset re-based.

    ``scenarios`` holds ``(*key, scenario_id, onset, duration, n)`` with the series
    length ``n``. Windows become ``(key, t)`` pairs, so the join is an equi-join.
    """
    middle = F.floor((2 * F.col("onset") + F.col("duration")) / 2)
    start = F.greatest(F.lit(0), F.least(middle - half, F.col("n") - 2 * half)).cast("long")
    windows = scenarios.withColumn("win_start", start).withColumn(
        "win_end", F.least(F.col("win_start") + 2 * half, F.col("n")).cast("long")
    )
    cells = windows.withColumn(t, F.explode(F.sequence("win_start", F.col("win_end") - 1))).withColumns(
        {
            "local_t": F.col(t) - F.col("win_start"),
            "onset_local": F.col("onset") - F.col("win_start"),
            "offset_local": F.col("onset") + F.col("duration") - F.col("win_start"),
        }
    )
    return cells.drop("n").join(df, [*key, t])


def downsample_trace(
    df: DataFrame, key: Sequence[str], max_points: int, t: str = "t", label: str = "label"
) -> DataFrame:
    """Keep first, last and attack rows, and evenly spaced normal rows up to the budget."""
    from tidegauge.operators.ordered import prefix_sum

    if max_points <= 0:
        raise ValueError("max_points must be positive")
    normal = F.when(F.col(label) == 0, 1).otherwise(0)
    totals = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(normal).alias("_normals"),
        F.max(F.when(F.col(t) == 0, F.col(label))).alias("_first"),
        F.max_by(label, t).alias("_last"),
    )
    forced = F.col("_n") - F.col("_normals") + (F.col("_first") == 0).cast("int") + F.when(
        F.col("_n") > 1, (F.col("_last") == 0).cast("int")
    ).otherwise(0)
    budget = totals.withColumn("_budget", F.greatest(F.lit(0), F.lit(max_points) - forced))
    rows = prefix_sum(df, key, {"_seen": normal}, t).join(budget, list(key))
    place = F.col("_seen") - 1
    top, count = F.col("_normals") - 1, F.col("_budget")
    # A normal row at place p is picked when floor(i * top / (count - 1)) = p for some i < count.
    step = F.when(count > 1, top / (count - 1))
    nearest = F.ceil(place / step)
    picked = F.when(count <= 0, False).when(count == 1, place == 0).when(top == 0, place == 0).otherwise(
        F.exists(
            F.array(nearest - 1, nearest, nearest + 1),
            lambda i: (i >= 0) & (i < count)
            & (F.when(i == count - 1, top).otherwise(F.floor(i * step)) == place),
        )
    )
    keep = (
        (F.col("_n") <= max_points)
        | (F.col(t) == 0)
        | (F.col(t) == F.col("_n") - 1)
        | (F.col(label) == 1)
        | ((F.col(label) == 0) & picked)
    )
    return rows.filter(keep).drop("_n", "_normals", "_first", "_last", "_budget", "_seen")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project to ``names``, failing with the sorted list of missing ones."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*names)


def limit_rows(df: DataFrame, limit: int, t: str = "t") -> DataFrame:
    """The first ``limit`` rows of every series by index."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return df.filter(F.col(t) < limit)


def fill_both_ways(df: DataFrame, key: Sequence[str], cols: Sequence[str], t: str = "t") -> DataFrame:
    """Forward fill, then backward fill what is left at the start."""
    rows = fill(df, key, {f"_f_{c}": c for c in cols}, t)
    rows = fill(rows, key, {f"_b_{c}": f"_f_{c}" for c in cols}, t, backward=True)
    return rows.withColumns({c: F.col(f"_b_{c}") for c in cols}).drop(
        *[f"_{p}_{c}" for p in "fb" for c in cols]
    )


def interpolate_linear(df: DataFrame, key: Sequence[str], cols: Sequence[str], t: str = "t") -> DataFrame:
    """Linear interpolation by row position inside gaps, nearest value at the edges."""
    points = {f"_p_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(t).alias("t"), F.col(c).cast("double").alias("v"))) for c in cols}
    rows = df.withColumns(points)
    rows = fill(rows, key, {f"_l_{c}": f"_p_{c}" for c in cols}, t)
    rows = fill(rows, key, {f"_r_{c}": f"_p_{c}" for c in cols}, t, backward=True)
    out = {}
    for c in cols:
        left, right = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        share = (F.col(t) - left["t"]) / (right["t"] - left["t"])
        out[c] = F.coalesce(
            F.col(c).cast("double"),
            left["v"] + (right["v"] - left["v"]) * share,
            left["v"],
            right["v"],
        )
    return rows.withColumns(out).drop(*[f"_{p}_{c}" for p in "plr" for c in cols])

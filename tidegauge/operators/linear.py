"""Second moments of sensor columns and least squares from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 2_048


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()


def column_moments(df: DataFrame, cols: Sequence[str], shift: Sequence[float] | None = None) -> np.ndarray:
    """``[1, cols - shift]^T [1, cols - shift]`` summed over all complete rows.

    Each task multiplies its Arrow batches and emits one upper triangle; the
    driver receives columns x columns numbers, whatever the row count. A ``shift``
    near the means keeps the digits of columns that lie far from zero.
    """
    cols = list(cols)
    origin = np.zeros(len(cols)) if shift is None else np.array(shift, dtype=float)
    if len(cols) > MAX_COLUMNS:
        raise ValueError(f"at most {MAX_COLUMNS} columns fit one moment matrix")
    width = len(cols) + 1
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.ones((batch.num_rows, width))
            for i in range(width - 1):
                x[:, i + 1] = batch.column(i).to_numpy(zero_copy_only=False) - origin[i]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(upper[0].astype(np.int32)),
                pa.array(upper[1].astype(np.int32)),
                pa.array(total[upper]),
            ],
            names=["i", "j", "s"],
        )

    parts = complete_rows(df, cols).mapInArrow(partial, "i int, j int, s double")
    sums = parts.groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    for i, j, s in sums.collect():  # width * (width + 1) / 2 rows
        out[i, j] = out[j, i] = s
    return out


def ridge_fit(
    df: DataFrame, target: str, companions: Sequence[str], alpha: float = 1.0, standardize: bool = True
) -> dict:
    """Ridge regression of ``target`` on ``companions`` from the moments about the means.

    With ``standardize`` the penalty acts on unit-variance companions and a
    centred target; without it the intercept stays unpenalised. Rows with a null are
    left out, ``dropped`` of them.
    """
    companions = list(companions)
    if target in companions:
        raise ValueError("the target cannot be a companion sensor")
    cols = [*companions, target]
    first = complete_rows(df, cols).agg(F.count(F.lit(1)), *[F.avg(c) for c in cols]).first()
    if not first[0]:
        raise ValueError("no complete rows to fit")
    moments = column_moments(df, cols, first[1:])
    n = moments[0, 0]
    p = len(companions)
    rest = moments[0, 1:] / n
    mean = np.array(first[1:]) + rest
    centred = moments[1:, 1:] - n * np.outer(rest, rest)
    xx, xy, yy = centred[:p, :p], centred[:p, p], centred[p, p]
    scale = np.ones(p)
    if standardize:
        scale = np.sqrt(np.clip(np.diag(xx), 0, None) / n)
        scale[scale == 0.0] = 1.0
    system = xx / np.outer(scale, scale) + alpha * np.eye(p)
    weights = np.linalg.solve(system, xy / scale) / scale
    variance = float(max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0) / n)
    return {
        "target": target,
        "companions": companions,
        "weights": weights.tolist(),
        "intercept": float(mean[p] - mean[:p] @ weights),
        "residual_variance": variance,
        "dropped": df.count() - int(n),
        "r2": float(1.0 - variance / (yy / n)) if yy > 0 else 0.0,
    }


def ridge_predict(df: DataFrame, model: dict, out: str = "prediction") -> DataFrame:
    """Linear prediction as a plain column expression."""
    value = F.lit(model["intercept"])
    for c, w in zip(model["companions"], model["weights"]):
        value = value + F.col(c) * F.lit(w)
    return df.withColumn(out, value)

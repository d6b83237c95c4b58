"""All statistical baselines on a split store: scores, thresholds, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import metrics, scores
from tidegauge.operators.ordered import longest_series, reindexed
from tidegauge.operators.scaling import (
    apply_scaler,
    fit_scaler,
    persistence_residual,
    prepare_features,
)
from tidegauge.session import staged

BASELINES = ["cusum", "ewma", "pca_spe"]


def split_features(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Normal train and val rows and all test rows, imputed, re-indexed, with residuals.

    The residual of a split's first row uses the last row of the split before it.
    """
    key = list(key)
    kept = df.filter("label = 0 OR split = 'test'").select(*key, "split", "t", "label", *cols)
    filled, cols = prepare_features(kept, kept.filter("split = 'train'"), key, cols)
    rows = reindexed(filled, [*key, "split"])
    following = F.when(F.col("split") == "train", "val").when(F.col("split") == "val", "test")
    last = (
        rows.groupBy(*key, "split")
        .agg(*[F.max_by(c, "t").alias(f"_p_{c}") for c in cols])
        .withColumn("split", following)
    )
    rows = rows.join(last, [*key, "split"], "left")
    rows = persistence_residual(
        rows, [*key, "split"], cols, preceding={c: f"_p_{c}" for c in cols}, prefix="r_"
    )
    return rows.drop(*[f"_p_{c}" for c in cols]), cols


def run_baselines(
    df: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    quantile: float = 0.99,
    blocks: int = 5,
    alpha: float = 0.2,
    components: int = 5,
    slack: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """Long scores ``(*key, split, t, label, baseline, score)`` and one summary row per baseline.

    CUSUM runs without reset on validation rows; their blocked threshold is the
    reset level for the test rows. The standardised features and the finished
    scores are written once, since every threshold and metric reads them again.
    """
    key = list(key)
    features, cols = split_features(df, key, cols)
    residuals = [f"r_{c}" for c in cols]
    features = staged(features, "features")
    longest = longest_series(features)
    train = features.filter("split = 'train'")
    params = fit_scaler(train, key, [*cols, *residuals])
    parts = apply_scaler(features, params, key, [*cols, *residuals])
    components = min(components, len(cols))
    part_key = [*key, "split"]

    rows = parts.filter("split <> 'train'")
    train_z = parts.filter("split = 'train'")
    for names, prefix in ((cols, ""), (residuals, "residual_")):
        axes = staged(scores.keyed_axes(train_z, key, names, components), "axes")
        rows = scores.keyed_spe_score(rows, key, names, axes, f"{prefix}pca_spe")
        rows = scores.ewma_score(rows, part_key, names, alpha, out=f"{prefix}ewma", longest=longest)
    rows = scores.cusum_score(rows, part_key, cols, slack, out="cusum", longest=longest)
    rows = scores.cusum_score(rows, part_key, residuals, slack, out="residual_cusum", longest=longest)
    rows = staged(rows, "scored")

    val = rows.filter("split = 'val'")
    cusums = ["cusum", "residual_cusum"]
    long_val = val.unpivot([*key, "t"], cusums, "baseline", "score")
    levels = (
        metrics.blocked_threshold(long_val, [*key, "baseline"], quantile, blocks)
        .groupBy(*key)
        .agg(*[F.max(F.when(F.col("baseline") == c, F.col("threshold"))).alias(f"_reset_{c}") for c in cusums])
    )
    test = rows.filter("split = 'test'").join(levels, key)
    rerun = test.drop(*cusums)
    for names, out in ((cols, "cusum"), (residuals, "residual_cusum")):
        again = scores.cusum_score_reset(test, key, names, f"_reset_{out}", slack, out=out)
        rerun = rerun.join(again, [*key, "t"])
    every = [f"{p}{b}" for p in ("", "residual_") for b in BASELINES]
    columns = [*part_key, "t", "label", *every]
    wide = val.select(*columns).unionByName(rerun.select(*columns))
    long = staged(wide.unpivot([*part_key, "t", "label"], every, "baseline", "score"), "scores")
    return long, metrics.summarize_scores(long, [*key, "baseline"], quantile, blocks)

"""Error distributions, null summaries and operating thresholds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegauge.functions.special import generalised_error_cdf, lgamma, normal_cdf, student_t_cdf
from tidegauge.operators.ordered import prefix_sum, with_rank
from tidegauge.operators.quantiles import exact_quantiles
from tidegauge.session import staged

MIN_SAMPLES = 10
MAX_GROUPS = 10_000  # groups searched together; more are searched in slices
SHAPE_RANGE = (0.05, 1e4)
SHAPES = {"student_t": "df", "ged": "beta"}


def fit_gaussian(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Closed-form fit with log-likelihood, AIC and BIC; groups under ten rows give none."""
    fit = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("loc"), F.stddev_pop(x).alias("_s")
    ).filter(F.col("n") >= MIN_SAMPLES)
    scale = F.greatest("_s", F.lit(1e-12))
    squares = F.col("n") * F.col("_s") * F.col("_s") / (scale * scale)
    ll = -0.5 * F.col("n") * math.log(2 * math.pi) - F.col("n") * F.ln(scale) - 0.5 * squares
    return fit.select(
        *by, "n", "loc", scale.alias("scale"), ll.alias("log_likelihood"),
        (4.0 - 2.0 * ll).alias("aic"), (2.0 * F.ln("n") - 2.0 * ll).alias("bic"),
    )


def fit_by_amplitude(df: DataFrame, by: Sequence[str], amplitude: str, x: str) -> DataFrame:
    """Gaussian fits per group, overall and per amplitude, in one aggregate."""
    level = F.explode(F.array(F.lit("overall"), F.col(amplitude).cast("string")))
    return fit_gaussian(df.withColumn("tier", level), [*by, "tier"], x)


def log_density(family: str, x: Column, loc: Column, scale: Column, shape: Column | None = None) -> Column:
    z = (x - loc) / scale
    if family == "gaussian":
        return -0.5 * math.log(2 * math.pi) - F.ln(scale) - 0.5 * z * z
    if family == "student_t":
        return (
            lgamma((shape + 1) / 2) - lgamma(shape / 2) - 0.5 * F.ln(shape * math.pi) - F.ln(scale)
            - (shape + 1) / 2 * F.log1p(z * z / shape)
        )
    if family == "ged":
        return F.ln(shape) - math.log(2.0) - F.ln(scale) - lgamma(1.0 / shape) - F.pow(F.abs(z), shape)
    raise ValueError(f"unknown family {family!r}")


def _group_likelihood(family: str, n: float, scale: float, shape: float, total: float) -> float:
    """Log-likelihood of a group from the sum of its row terms."""
    if family == "student_t":
        level = math.lgamma((shape + 1) / 2) - math.lgamma(shape / 2) - 0.5 * math.log(shape * math.pi)
        return n * (level - math.log(scale)) - (shape + 1) / 2 * total
    return n * (math.log(shape) - math.log(2.0 * scale) - math.lgamma(1.0 / shape)) - total


def fit_shape(
    df: DataFrame, by: Sequence[str], x: str, family: str, rounds: int = 60, tolerance: float = 1e-3
) -> DataFrame:
    """Likelihood search for Student-t or generalised error parameters per group.

    Equal values of a group are counted once; each round is one aggregate over them with the
    27 neighbours of every group's current point as 27 sums. A group whose centre wins halves its steps. Only one row
    per group reaches the driver, at most ``MAX_GROUPS`` at a time. ``converged`` tells
    whether a group's steps got below the tolerance within the rounds.
    """
    if family not in SHAPES:
        raise ValueError(f"unknown family {family!r}")
    by = list(by)
    if not by:
        raise ValueError("give at least one group column")
    spark = df.sparkSession
    known = df.select(*by, F.col(x).alias("_x")).dropna()
    data = staged(known.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n")), "errors")
    start = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("loc"), F.stddev_pop("_x").alias("scale")
    )
    start = staged(start.filter(F.col("n") >= MIN_SAMPLES), "groups")
    count = start.count()
    if count > MAX_GROUPS:
        slices = -(-2 * count // MAX_GROUPS)
        place = F.pmod(F.xxhash64(*by), F.lit(slices))
        parts = [fit_shape(df.filter(place == i), by, x, family, rounds, tolerance) for i in range(slices)]
        return reduce(DataFrame.unionByName, parts)
    groups = start.collect()
    key_fields = [data.schema[c] for c in by]
    schema = T.StructType([*key_fields, T.StructField("q", T.ArrayType(T.DoubleType()))])
    spread = 1.0 if family == "student_t" else math.sqrt(2.0)
    first_shape = 5.0 if family == "student_t" else 2.0
    state = {
        tuple(g[c] for c in by): [g["loc"], max(g["scale"], 1e-12) * spread, first_shape, 1.0] for g in groups
    }
    sizes = {tuple(g[c] for c in by): g["n"] for g in groups}
    fitted = dict.fromkeys(state, float("-inf"))
    moves = list(itertools.product((0, -1, 1), repeat=3))

    def moved(point: list[float], move: tuple[int, int, int]) -> tuple[float, float, float]:
        loc, scale, shape, step = point
        bounded = min(max(shape * math.exp(move[2] * step), SHAPE_RANGE[0]), SHAPE_RANGE[1])
        return loc + move[0] * step * scale, scale * math.exp(move[1] * step), bounded

    sums = []
    for i in range(len(moves)):
        z, shape = f"((_x - q[{3 * i}]) * q[{3 * i + 1}])", f"q[{3 * i + 2}]"
        term = f"log1p({z} * {z} / {shape})" if family == "student_t" else f"pow(abs({z}), {shape})"
        sums.append(F.expr(f"sum(_n * {term}) AS s{i}"))
    for _ in range(rounds):
        open_groups = [k for k, p in state.items() if p[3] > tolerance]
        if not open_groups:
            break
        tried = {k: [moved(state[k], move) for move in moves] for k in open_groups}
        points = spark.createDataFrame(
            [(*k, [v for loc, scale, shape in tried[k] for v in (loc, 1.0 / scale, shape)]) for k in open_groups],
            schema,
        )
        joined = data.join(F.broadcast(points), by)  # size checked above
        for row in joined.groupBy(*by).agg(*sums).collect():
            k = tuple(row[c] for c in by)
            ll, i, loc, scale, shape = max(
                (_group_likelihood(family, sizes[k], scale, shape, row[f"s{i}"]), -i, loc, scale, shape)
                for i, (loc, scale, shape) in enumerate(tried[k])
            )
            fitted[k] = ll
            state[k] = [loc, scale, shape, state[k][3] / 2 if i == 0 else state[k][3]]
    result = T.StructType(
        key_fields
        + [T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("loc", "scale", "shape", "log_likelihood")]
        + [T.StructField("converged", T.BooleanType())]
    )
    rows = [(*k, sizes[k], *p[:3], fitted[k], p[3] <= tolerance) for k, p in state.items()]
    ll = F.col("log_likelihood")
    return spark.createDataFrame(rows, result).select(
        *by, F.lit(family).alias("family"), "n", "loc", "scale", "shape", "log_likelihood",
        (6.0 - 2.0 * ll).alias("aic"), (3.0 * F.ln("n") - 2.0 * ll).alias("bic"), "converged",
    )


def rank_models(fits: DataFrame, by: Sequence[str], criterion: str = "aic") -> DataFrame:
    """Order families per group by an information criterion, best first."""
    if criterion not in ("aic", "bic"):
        raise ValueError("criterion must be aic or bic")
    w = Window.partitionBy(*by).orderBy(criterion, "family")  # one row per family
    return fits.withColumn("model_rank", F.row_number().over(w))


def fit_all(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Gaussian, Student-t and generalised error fits of every group in one table."""
    gaussian = fit_gaussian(df, by, x).withColumns({"family": F.lit("gaussian"), "shape": F.lit(None).cast("double"), "converged": F.lit(True)})
    out = gaussian
    for family in SHAPES:
        out = out.unionByName(fit_shape(df, by, x, family))
    return out


def distribution(family: Column, x: Column, loc: Column, scale: Column, shape: Column) -> Column:
    """Distribution function of the fitted family of a row."""
    z = (x - loc) / scale
    return (
        F.when(family == "gaussian", normal_cdf(z))
        .when(family == "student_t", student_t_cdf(z, shape))
        .when(family == "ged", generalised_error_cdf(z, shape))
    )


def ks_fitted(df: DataFrame, fits: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic and asymptotic p-value of every fit of every group.

    ``fits`` holds ``(*by, family, loc, scale, shape)``. Equal values are counted before
    ranking, and ranks come from range partitions and chunked sums, so a large group is never
    in one task.
    """
    by = list(by)
    known = df.filter(F.col(x).isNotNull())
    counts = known.groupBy(*by, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sum(with_rank(counts, by, ["_x"], "_r"), by, {"_upto": F.col("_c")}, "_r")
    wanted = fits.select(*by, "family", F.col("loc").alias("_loc"), F.col("scale").alias("_scale"), F.col("shape").alias("_shape"))
    gaps = ranked.join(sizes, by).join(wanted, by)
    gaps = gaps.withColumn("_cdf", distribution(F.col("family"), F.col("_x"), F.col("_loc"), F.col("_scale"), F.col("_shape")))
    gap = F.greatest(F.col("_upto") / F.col("n") - F.col("_cdf"), F.col("_cdf") - (F.col("_upto") - F.col("_c")) / F.col("n"))
    stats = gaps.groupBy(*by, "family").agg(F.max(gap).alias("ks_stat"), F.max("n").alias("n"))
    lam = F.col("n") * F.col("ks_stat") * F.col("ks_stat")
    tail = F.lit(0.0)
    for k in range(1, 101):
        tail = tail + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam)
    return stats.withColumn("ks_pvalue", F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))


def ks_gaussian(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``ks_fitted`` for the Gaussian of each group's own mean and deviation."""
    fit = df.groupBy(*by).agg(F.avg(x).alias("loc"), F.greatest(F.stddev_pop(x), F.lit(1e-12)).alias("scale"))
    fit = fit.withColumns({"family": F.lit("gaussian"), "shape": F.lit(None).cast("double")})
    return ks_fitted(df, fit, by, x).drop("family")


# Reported levels and percentiles.
LEVELS = [0.01, 0.02, 0.05, 0.10, 0.125, 0.15, 0.20, 0.25]
PERCENTS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}


def null_summary(df: DataFrame, by: Sequence[str], x: str, tolerance: float = 1e-4) -> DataFrame:
    """Size and sparsity of estimates on clean data with exact percentiles of ``|x|``."""
    by = list(by)
    rows = df.withColumn("_a", F.abs(x))
    zero = F.col("_a") <= tolerance
    sums = rows.groupBy(*by).agg(
        F.count(x).alias("n_points"),
        F.count(F.when(zero, 1)).alias("n_zero"),
        F.avg(zero.cast("int")).alias("sparsity_rate"),
        F.coalesce(F.avg(F.when(~zero, F.col("_a"))), F.lit(0.0)).alias("mean_abs_nonzero"),
        F.max("_a").alias("max_abs"),
        F.stddev_pop(x).alias("std_null"),
    )
    q = exact_quantiles(rows, by, "_a", list(PERCENTS.values()), "_v").groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == level, F.col("_v"))).alias(name) for name, level in PERCENTS.items()]
    )
    return sums.join(q, by)


def exceedance(df: DataFrame, by: Sequence[str], x: str, levels: Sequence[float] = tuple(LEVELS)) -> DataFrame:
    """Share of ``|x|`` at or above each level, one row per group and level."""
    shares = df.groupBy(*by).agg(
        *[F.avg((F.abs(x) >= level).cast("int")).alias(f"_l{i}") for i, level in enumerate(levels)]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(float(v)).alias("threshold"), F.col(f"_l{i}").alias("far")) for i, v in enumerate(levels)])
    )
    return shares.select(*by, pairs.alias("_p")).select(*by, "_p.*")


def roc_curve(df: DataFrame, x: str, attacked: str, points: int = 200) -> DataFrame:
    """False and true alarm rates of ``|x| >= tau`` over evenly spaced thresholds.

    Every value falls into the bucket of the last threshold it reaches; reverse
    running counts over the buckets are the rates, without a row per threshold
    and value.
    """
    rows = df.select(F.abs(x).alias("_a"), F.col(attacked).cast("int").alias("_y"))
    peak = rows.agg(F.max("_a")).first()[0] or 0.0
    step = max(peak, 0.01) * 1.05 / (points - 1)
    guess = F.floor(F.col("_a") / step)
    bucket = F.when(F.col("_a") < guess * step, guess - 1).when(F.col("_a") >= (guess + 1) * step, guess + 1).otherwise(guess)
    counts = rows.groupBy(bucket.cast("long").alias("k")).agg(
        F.count(F.when(F.col("_y") == 0, 1)).alias("n0"), F.count(F.when(F.col("_y") == 1, 1)).alias("n1")
    )
    spark = df.sparkSession
    every = spark.range(points).withColumnRenamed("id", "k").join(counts, "k", "left")
    after = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row per threshold
    whole = Window.partitionBy()
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    return every.select(
        "k", (F.col("k") * step).alias("threshold"),
        (F.sum(n0).over(after) / F.sum(n0).over(whole)).alias("fpr"),
        (F.sum(n1).over(after) / F.sum(n1).over(whole)).alias("tpr"),
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area by trapezoids with (0,0) and (1,1) added, in order of (fpr, tpr)."""
    spark = curve.sparkSession
    ends = spark.range(2).select(F.col("id").cast("double").alias("fpr"), F.col("id").cast("double").alias("tpr"))
    points = curve.select("fpr", "tpr").unionByName(ends)
    w = Window.orderBy("fpr", "tpr")
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2.0
    return points.select(area.alias("_a")).agg(F.greatest(F.least(F.sum("_a"), F.lit(1.0)), F.lit(0.0)).alias("auc"))


def tau_for_far(df: DataFrame, by: Sequence[str], x: str, rates: Sequence[float]) -> DataFrame:
    """Smallest usual threshold whose exceedance stays within each false-alarm rate."""
    by = list(by)
    if any(not 0.0 < r < 1.0 for r in rates):
        raise ValueError("rates must be in (0, 1)")
    rows = df.select(*by, F.abs(x).alias("_a"))
    levels = [1.0 - r for r in rates]
    found = exact_quantiles(rows, by, "_a", levels, "_q").groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == level, F.col("_q"))).alias(f"_q{i}") for i, level in enumerate(levels)]
    )
    joined = rows.join(found, by) if by else rows.join(F.broadcast(found))  # one row
    sums = []
    for i in range(len(rates)):
        level = F.col(f"_q{i}")
        sums += [
            F.max(level).alias(f"_q{i}"),
            F.avg((F.col("_a") >= level).cast("int")).alias(f"_share{i}"),
            F.min(F.when(F.col("_a") > level, F.col("_a"))).alias(f"_next{i}"),
        ]
    pairs = [
        F.struct(
            F.lit(float(rate)).alias("far"),
            F.when(F.col(f"_share{i}") > rate + 1e-15, F.coalesce(f"_next{i}", f"_q{i}"))
            .otherwise(F.col(f"_q{i}")).alias("tau"),
        )
        for i, rate in enumerate(rates)
    ]
    per = joined.groupBy(*by).agg(*sums)
    return per.select(*by, F.explode(F.array(*pairs)).alias("_p")).select(*by, "_p.*")


def enrich_ledger(ledger: DataFrame, fits: DataFrame, by: Sequence[str], train_std: Column) -> DataFrame:
    """Error in units, reconstructed amplitude, log-density per fitted family and the best family."""
    rows = ledger.withColumn("error_units", F.col("signed_amplitude_error") * train_std).withColumn(
        "reconstructed_amplitude", F.col("amplitude") + F.col("error_units")
    )
    out = rows
    for family in ("gaussian", *SHAPES):
        mine = fits.filter(F.col("family") == family).select(
            *by, F.col("loc").alias("_loc"), F.col("scale").alias("_scale"), F.col("shape").alias("_shape")
        )
        density = log_density(family, F.col("error_units"), F.col("_loc"), F.col("_scale"), F.col("_shape"))
        out = out.join(mine, list(by), "left").withColumn(f"logpdf_{family}", density).drop("_loc", "_scale", "_shape")
    best = fits.groupBy(*by).agg(F.min_by("family", F.struct("aic", "family")).alias("best_model"))
    return out.join(best, list(by), "left")

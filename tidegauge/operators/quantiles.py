"""Exact linear-interpolated quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.session import staged

SMALL_GROUP = 1_000_000
SORTED_GROUP = 100_000  # values of a group that one task sorts in an array
CELLS = 16_384
PER_OCTAVE = 1_024
OFFSET = 1_100 * PER_OCTAVE  # keeps every positive double above bucket 0


def _bucket(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + OFFSET
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def _blended(low: Column, high: Column, share: Column) -> Column:
    """``low * (1 - share) + high * share``, the first product not rounded on its own.

    That is how the twins' engine computes it (a fused multiply-add). A quantile often falls
    on the same short decimal as another value of the data, and the last bit then decides a
    comparison. The product's rounding error is exact by Dekker's splitting.
    """

    def halves(c: Column) -> tuple[Column, Column]:
        wide = c * 134_217_729.0
        top = wide - (wide - c)
        return top, c - top

    rest, other = 1.0 - share, high * share
    product = low * rest
    (a, b), (c, d) = halves(low), halves(rest)
    lost = ((a * c - product) + a * d + b * c) + b * d
    total = product + other
    back = total - product
    lost = lost + ((product - (total - back)) + (other - back))
    return total + F.nanvl(lost, F.lit(0.0))  # infinite values have no splitting


def _sorted_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], out: str) -> DataFrame:
    sorted_ = F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_x")
    lists = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(sorted_).filter(F.size("_x") > 0)
    rows = lists.select(*by, "_x", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    place = F.col("q") * (F.size("_x") - 1)
    rows = rows.select(*by, "q", "_x", place.alias("_pos"), F.floor(place).cast("int").alias("_at"))
    low = F.get("_x", F.col("_at"))
    high = F.get("_x", F.ceil("_pos").cast("int"))
    found = rows.select(*by, "q", low.alias("_low"), high.alias("_high"), (F.col("_pos") - F.col("_at")).alias("_share"))
    return found.select(*by, "q", _between(F.col("_low"), F.col("_high"), F.col("_share")).alias(out))


def _between(low: Column, high: Column, share: Column) -> Column:
    return F.when(share == 0, low).otherwise(_blended(low, high, share))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], out: str = "value",
    small: int = SMALL_GROUP,
) -> DataFrame:
    """Rows ``(*by, q, out)``: the quantile ``q`` of ``value`` per group, nulls ignored.

    Groups of at most ``small`` rows (checked first) use the built-in aggregate for medians,
    which holds the distinct values of a group, and sorted arrays for other levels if they are
    no longer than ``SORTED_GROUP``. Otherwise a histogram on a fixed log scale finds the
    bucket of each wanted rank, only rows of those buckets are read again, and their distinct
    values are split into cells before any ranking: two scans, all counts pre-aggregated, the
    same result to the last bit.
    """
    by = list(by)
    largest = df.groupBy(*by).agg(F.count(value).alias("_n")).agg(F.max("_n")).first()[0] or 0
    median = all(q == 0.5 for q in quantiles)  # halves need no rounding
    if not median and largest <= min(small, SORTED_GROUP):
        return _sorted_quantiles(df, by, value, quantiles, out)
    if median and largest <= small:
        levels = F.array(*[F.lit(float(q)) for q in quantiles])
        level = F.lit(float(quantiles[0])) if len(quantiles) == 1 else levels
        picked = (
            df.filter(F.col(value).isNotNull())
            .groupBy(*by)
            .agg(F.percentile(F.col(value).cast("double"), level).alias("_p"))
        )
        if len(quantiles) == 1:
            return picked.select(*by, level.alias("q"), F.col("_p").alias(out))
        pairs = F.arrays_zip(levels.alias("q"), F.col("_p"))
        return picked.select(*by, F.inline(pairs).alias("q", out))
    return _refined_quantiles(df, by, value, quantiles, out)


def _refined_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], out: str
) -> DataFrame:
    data = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    data = data.withColumn("_b", _bucket(F.col("_v")))
    if not by:
        data = data.withColumn("_all", F.lit(1))
    group = by or ["_all"]

    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        data.groupBy(*group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_to", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )
    wanted = staged(
        histogram.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("_pos", F.col("q") * (F.col("_total") - 1))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn(
            "_rank",
            F.when(F.col("_side") == 0, F.floor("_pos")).otherwise(F.ceil("_pos")).cast("long"),
        )
        .filter("_from <= _rank AND _rank < _to")
        .withColumn("_place", F.col("_rank") - F.col("_from"))
        .select(*group, "_b", "q", "_side", "_pos", "_place", "_lo", "_hi"),
        "ranks",
    )
    buckets = wanted.select(*group, "_b", "_lo", "_hi").distinct()
    cell = F.least(
        F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS),
        F.lit(CELLS - 1),
    )
    values = staged(
        data.join(buckets, [*group, "_b"])
        .groupBy(*group, "_b", "_lo", "_hi", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cell", F.when(F.col("_lo") == F.col("_hi"), F.lit(0)).otherwise(cell).cast("long")),
        "values",
    )
    in_bucket = Window.partitionBy(*group, "_b").orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = (
        values.groupBy(*group, "_b", "_cell")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_start", F.coalesce(F.sum("_m").over(in_bucket), F.lit(0)))
        .withColumn("_stop", F.col("_start") + F.col("_m"))
        .drop("_m")
    )
    hits = wanted.drop("_lo", "_hi").join(cells, [*group, "_b"]).filter(
        "_start <= _place AND _place < _stop"
    )
    in_cell = Window.partitionBy(*group, "_b", "_cell").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = (
        values.join(hits.select(*group, "_b", "_cell").distinct(), [*group, "_b", "_cell"])
        .withColumn("_to", F.sum("_n").over(in_cell))
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .select(*group, "_b", "_cell", "_v", "_from", "_to")
    )
    low = F.max(F.when(F.col("_side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_v")))
    share = F.max(F.col("_pos") - F.floor("_pos"))
    result = (
        hits.withColumn("_place", F.col("_place") - F.col("_start"))
        .join(ranked, [*group, "_b", "_cell"])
        .filter("_from <= _place AND _place < _to")
        .groupBy(*group, "q")
        .agg(low.alias("_low"), high.alias("_high"), share.alias("_share"))
        .select(*group, "q", _between(F.col("_low"), F.col("_high"), F.col("_share")).alias(out))
    )
    return result if by else result.drop("_all")

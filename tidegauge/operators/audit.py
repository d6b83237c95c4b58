"""Acceptance audit of a store: rules as data, one aggregate per grain.

A measure is a number about a split, a sensor, a pair of splits, the table or its metadata.
Every grain is one aggregation that yields all its measures as rows ``(grain, subject,
measure, value)``; a rule names one of them and the least and greatest value that passes.
Rules are a table, so a data set brings its own, and no rule costs a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordered import with_lag

INFINITE = float("inf")
COLUMNS = ["grain", "subject", "measure", "value"]


class Rule(NamedTuple):
    """``measure`` of ``subject`` must lie in ``[low, high]``; a missing one fails."""

    check: str
    grain: str
    subject: str
    measure: str
    low: float
    high: float


def equals(check: str, grain: str, subject: str, measure: str, value: float) -> Rule:
    return Rule(check, grain, subject, measure, float(value), float(value))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("double")


def _long(df: DataFrame, grain: str, subject: Column, measures: Sequence[str]) -> DataFrame:
    named = df.select(subject.cast("string").alias("subject"), *(F.col(m).cast("double").alias(m) for m in measures))
    return named.unpivot(["subject"], list(measures), "measure", "value").select(F.lit(grain).alias("grain"), "subject", "measure", "value")


def split_measures(df: DataFrame) -> DataFrame:
    """Rows, labels, ids and borders of every split."""
    attack, id_ = F.col("label") == 1, F.col("attack_id")
    seconds = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    sums = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), _count(attack).alias("attack_rows"),
        _count(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_labels"),
        _count(~attack & id_.isNotNull()).alias("normal_with_id"), _count(attack & id_.isNull()).alias("attack_without_id"),
        _count(F.col("timestamp").isNull()).alias("null_times"), F.min("attack_id").alias("min_id"), F.max("attack_id").alias("max_id"),
        F.min(seconds).alias("first"), F.max(seconds).alias("last"),
    )
    return _long(sums, "split", F.col("split"), [c for c in sums.columns if c != "split"])


def step_measures(df: DataFrame, t: str = "t") -> DataFrame:
    """Backward and repeated steps, and the most frequent step in seconds, by split."""
    rows = with_lag(df.select("split", t, "timestamp"), ["split"], {"_p": ("timestamp", 1)}, t)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    steps = rows.select("split", (at("timestamp") - at("_p")).alias("d")).dropna().groupBy("split", "d").agg(F.count(F.lit(1)).alias("n"))
    sums = steps.groupBy("split").agg(
        F.sum(F.when(F.col("d") < 0, F.col("n")).otherwise(0)).alias("backward"),
        F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).alias("repeated"),
        (F.max_by("d", F.struct("n", -F.col("d"))) / 1e6).alias("mode"),
    )
    return _long(sums, "split", F.col("split"), ["backward", "repeated", "mode"])


def sensor_measures(df: DataFrame, sensors: Sequence[str], fit: str = "train") -> DataFrame:
    """Range over the fitting split, nulls and non-finite values over all, by sensor."""
    fitting = F.col("split") == fit
    measures = {}
    for i, s in enumerate(sensors):
        x = F.col(s).cast("double")
        known = x.isNotNull() & ~F.isnan(x)
        measures |= {
            f"{i}_min": F.min(F.when(fitting & known, x)), f"{i}_max": F.max(F.when(fitting & known, x)),
            f"{i}_nulls": _count(x.isNull()), f"{i}_nonfinite": _count(x.isNotNull() & (F.isnan(x) | (F.abs(x) == INFINITE))),
        }
    sums = df.agg(*(c.alias(name) for name, c in measures.items()))
    names = ("min", "max", "nulls", "nonfinite")
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("subject"), *(F.col(f"{i}_{m}").cast("double").alias(m) for m in names)) for i, s in enumerate(sensors))))
    each = sums.select(rows.alias("r")).select("r.*").withColumn("constant", F.coalesce((F.col("min") == F.col("max")).cast("int"), F.lit(1)))
    return _long(each, "sensor", F.col("subject"), [*names, "constant"])


def pair_measures(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Timestamps that two splits share."""
    flags = df.filter(F.col("timestamp").isNotNull()).groupBy("timestamp").agg(*(F.max((F.col("split") == s).cast("int")).alias(s) for s in splits))
    pairs = list(combinations(splits, 2))
    sums = flags.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("double").alias(f"{a}/{b}") for a, b in pairs))
    return sums.unpivot([], [f"{a}/{b}" for a, b in pairs], "subject", "value").select(
        F.lit("pair").alias("grain"), "subject", F.lit("shared").alias("measure"), "value"
    )


def table_measures(df: DataFrame, sensors: Sequence[str], types: dict[str, str], reload: DataFrame | None = None) -> DataFrame:
    """Number of sensors, columns of another type, and rows that a reload has not, or only it has."""
    wrong = [c for c, kind in types.items() if c not in df.columns or df.schema[c].dataType.simpleString() != kind]
    facts = df.sparkSession.createDataFrame(
        [("table", "sensors", "count", float(len(sensors))), *(("table", c, "wrong_type", float(c in wrong)) for c in types)],
        "grain string, subject string, measure string, value double",
    )
    if reload is None:
        return facts
    other = reload.select(*df.columns)
    for name, (a, b) in {"lost": (df, other), "added": (other, df)}.items():
        differs = a.exceptAll(b).agg(F.count(F.lit(1)).cast("double").alias("value"))
        facts = facts.unionByName(differs.select(F.lit("table").alias("grain"), F.lit("reload").alias("subject"), F.lit(name).alias("measure"), "value"))
    return facts


def meta_measures(spark, cadence: float | None, checksums: DataFrame | None = None) -> DataFrame:
    """The recorded cadence, the number of checksums and of those that are not 64 hex digits."""
    facts = spark.createDataFrame([("meta", "store", "cadence", None if cadence is None else float(cadence))], "grain string, subject string, measure string, value double")
    if checksums is None:
        return facts
    bad = F.col("sha256").isNull() | ~F.col("sha256").rlike("^[0-9a-f]{64}$")
    sums = checksums.agg(F.count(F.lit(1)).alias("files"), _count(bad).alias("bad"))
    return facts.unionByName(_long(sums, "meta", F.lit("checksums"), ["files", "bad"]))


def judge(measures: Sequence[DataFrame], rules: Sequence[Rule], dataset: str) -> DataFrame:
    """One row per rule: ``dataset, check, passed, detail``."""
    spark = measures[0].sparkSession
    every = measures[0]
    for part in measures[1:]:
        every = every.unionByName(part)
    given = spark.createDataFrame([(*r[:4], float(r.low), float(r.high)) for r in rules], "check string, grain string, subject string, measure string, low double, high double")
    # A rule is one short row, and rules are written by hand or from a short list.
    met = F.broadcast(given).join(every, ["grain", "subject", "measure"], "left")
    passed = F.coalesce((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")), F.lit(False))
    detail = F.concat_ws(" ", "subject", "measure", F.coalesce(F.col("value").cast("string"), F.lit("missing")))
    return met.select(F.lit(dataset).alias("dataset"), "check", passed.alias("passed"), detail.alias("detail"))


def standard_rules(
    splits: Sequence[str], sensors: Sequence[str], types: dict[str, str], cadence: float, rows: dict[str, int] | None = None,
    attack_rows: dict[str, int] | None = None, normal: Sequence[str] = (), ids: tuple[float, float] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None, constants: Sequence[str] = (), shared: dict[str, int] | None = None,
    reload: bool = False, checksums: bool = False,
) -> list[Rule]:
    """The usual acceptance rules for a store of ordered splits."""
    out = [equals("sensor count", "table", "sensors", "count", len(sensors))]
    for s in splits:
        zero = {
            "label domain": "bad_labels", "no id on normal rows": "normal_with_id", "an id on attack rows": "attack_without_id",
            "times known": "null_times", "times never step back": "backward", "times unique": "repeated",
        }
        out += [equals(f"{s} {check}", "split", s, measure, 0) for check, measure in zero.items()]
        out.append(equals(f"{s} cadence", "split", s, "mode", cadence))
    out += [equals(f"{s} rows", "split", s, "rows", n) for s, n in (rows or {}).items()]
    out += [equals(f"{s} attack rows", "split", s, "attack_rows", n) for s, n in (attack_rows or {}).items()]
    out += [equals(f"{s} labels all 0", "split", s, "attack_rows", 0) for s in normal]
    if ids is not None:
        out += [Rule(f"{s} attack ids", "split", s, m, *ids) for s in splits if s not in normal for m in ("min_id", "max_id")]
    for s in sensors:
        out.append(equals(f"{s} finite", "sensor", s, "nonfinite", 0))
        out.append(equals(f"{s} {'constant' if s in constants else 'varies'}", "sensor", s, "constant", int(s in constants)))
    for s, (low, high) in (ranges or {}).items():
        out += [Rule(f"{s} on raw scale, {m}", "sensor", s, m, low, high) for m in ("min", "max")]
    out += [Rule(f"{a}/{b} share no times", "pair", f"{a}/{b}", "shared", 0, (shared or {}).get(f"{a}/{b}", 0)) for a, b in combinations(splits, 2)]
    out += [equals(f"{c} is {kind}", "table", c, "wrong_type", 0) for c, kind in types.items()]
    out.append(equals("recorded cadence", "meta", "store", "cadence", cadence))
    if checksums:
        out += [Rule("checksums recorded", "meta", "checksums", "files", 1, INFINITE), equals("checksum shape", "meta", "checksums", "bad", 0)]
    if reload:
        out += [equals(f"reload {m} no rows", "table", "reload", m, 0) for m in ("lost", "added")]
    return out

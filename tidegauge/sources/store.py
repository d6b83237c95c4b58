"""The canonical store: one partitioned Parquet table plus metadata and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.ordered import with_lag

# Dataset names, splits and their sampling interval in seconds.
DATASETS = {"swat": 1, "wadi": 1, "batadal": 3600, "hai": 1}
SPLITS = ["train", "val", "test"]
PREFIX = ["timestamp", "label", "attack_id"]


def sensor_columns(df: DataFrame, also: Sequence[str] = ("dataset", "split", "series_id", "t")) -> list[str]:
    return [c for c in df.columns if c not in {*PREFIX, *also}]


def canonical(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Fixed prefix types and single-precision sensors."""
    passed = [c for c in ("dataset", "split") if c in df.columns]
    return df.select(
        *passed,
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.col("label").cast("byte").alias("label"),
        F.col("attack_id").cast("int").alias("attack_id"),
        *[F.col(s).cast("float").alias(s) for s in sensors],
    )


def write_store(df: DataFrame, root: str, mode: str = "error") -> None:
    """Write rows with ``dataset`` and ``split`` columns, time-clustered inside each split."""
    ordered = df.repartitionByRange("dataset", "split", "timestamp").sortWithinPartitions(
        "dataset", "split", "timestamp"
    )
    ordered.write.mode(mode).partitionBy("dataset", "split").parquet(root)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Write a result table as Parquet, CSV or JSON lines."""
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind in ("parquet", "json"):
        getattr(df.write, kind)(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def load_dataset(
    spark: SparkSession, root: str, name: str, split: str, names: Sequence[str] = tuple(DATASETS)
) -> DataFrame:
    """One split of one dataset; both filters prune partitions before any file is read."""
    if name not in names:
        raise ValueError(f"unknown dataset name: {name!r}")
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split!r}")
    table = spark.read.parquet(root)
    found = table.filter((F.col("dataset") == name) & (F.col("split") == split)).drop("dataset", "split")
    if found.isEmpty():
        raise FileNotFoundError(f"no rows for {name}/{split} in {root}")
    return found


def load_split_file(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """Split kept as its own file, a first-wave file preferred where one exists."""
    for candidate in (f"{split}_wave1", split):
        try:
            return spark.read.parquet(f"{root}/{name}/{candidate}.parquet")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"no {split} file for {name} in {root}")


def store_meta(df: DataFrame) -> DataFrame:
    """Start, end and rows per split."""
    return df.groupBy("dataset", "split").agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("rows")
    )


def constant_columns(df: DataFrame, cols: Sequence[str], rule: str = "distinct") -> list[str]:
    """Sensors without variation: at most one value, or sample deviation below 1e-12."""
    if rule not in ("distinct", "deviation"):
        raise ValueError("rule must be 'distinct' or 'deviation'")
    if rule == "distinct":
        tests = [(F.count(c) == 0) | (F.min(c) == F.max(c)) for c in cols]
    else:
        tests = [F.stddev_samp(c) < 1e-12 for c in cols]
    row = df.agg(*[F.coalesce(test, F.lit(False)).alias(c) for c, test in zip(cols, tests)]).first()
    return [c for c in cols if row[c]]


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file under ``path`` (files below the 2 GB limit of a binary row)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = "/" + path.rstrip("/").split("/")[-1] + "/"
    below = F.when(F.contains("path", F.lit(folder)), F.substring_index("path", folder, -1)).otherwise(
        F.element_at(F.split("path", "/"), -1)
    )
    return files.select(below.alias("file"), F.sha2("content", 256).alias("sha256"), "length")


def write_meta(df: DataFrame, path: str, dataset: str, checksums: DataFrame | None = None) -> None:
    """Save the metadata of one dataset as a single JSON record under ``path``.

    Interval, sensors and constant sensors, start, end and rows per split, raw file
    checksums: a few values per split, gathered by aggregates.
    """
    mine = df.filter(F.col("dataset") == dataset)
    sensors = sensor_columns(df)
    constants = constant_columns(mine.filter("split = 'train'"), sensors)
    entry = F.struct("split", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "rows")
    record = store_meta(mine).agg(F.sort_array(F.collect_list(entry)).alias("splits"))  # one entry per split
    words = F.lit(None).cast("array<string>") if not constants else F.array(*[F.lit(c) for c in constants])
    record = record.select(
        F.lit(dataset).alias("dataset"), F.lit(DATASETS.get(dataset)).alias("sampling_interval_s"),
        F.array(*[F.lit(s) for s in sensors]).alias("sensor_columns"), words.alias("constant_columns"), "splits",
    )
    if checksums is not None:
        sums = checksums.agg(F.map_from_entries(F.collect_list(F.struct("file", "sha256"))).alias("raw_file_checksums"))
        record = record.join(F.broadcast(sums))  # one row
    record.coalesce(1).write.json(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(path).first()
    if row is None:
        raise FileNotFoundError(f"no metadata in {path}")
    return row.asDict(recursive=True)


# ------------------------------------------------------------------------- audit
def _per_split(df: DataFrame, sensors: Sequence[str]) -> dict[str, dict]:
    sums = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("label") == 1, 1)).alias("attacks"),
        F.count(F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), 1)).alias("bad_labels"),
        F.count(F.when((F.col("label") == 0) & F.col("attack_id").isNotNull(), 1)).alias("normal_with_id"),
        F.count(F.when((F.col("label") == 1) & F.col("attack_id").isNull(), 1)).alias("attack_without_id"),
        F.min("attack_id").alias("min_id"),
        F.max("attack_id").alias("max_id"),
        *[F.min(s).alias(f"min_{s}") for s in sensors],
        *[F.max(s).alias(f"max_{s}") for s in sensors],
    )
    return {r["split"]: r.asDict() for r in sums.collect()}  # one row per split


def _steps(df: DataFrame) -> tuple[dict, dict]:
    rows = with_lag(df.select("split", "t", "timestamp"), ["split"], {"_p": ("timestamp", 1)})
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("_p").cast("timestamp"))
    diffs = rows.filter("_p IS NOT NULL").groupBy("split", micros.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = diffs.groupBy("split").agg(
        F.sum(F.when(F.col("d") <= 0, F.col("n")).otherwise(0)).alias("backward"),
        F.max_by("d", F.struct("n", -F.col("d"))).alias("mode"),
    ).collect()
    return {r["split"]: r["backward"] for r in found}, {r["split"]: r["mode"] / 1e6 for r in found}


def audit_store(df: DataFrame, dataset: str, rules: dict, meta: dict | None = None) -> DataFrame:
    """PASS/FAIL rows ``(dataset, check, passed, detail)`` for one dataset of the store.

    ``df`` holds ``split, t, timestamp, label, attack_id`` and sensors. ``rules`` may give
    ``rows, attack_rows`` (per split), ``sensors`` (count), ``normal`` (splits), ``cadence``,
    ``ranges`` (sensor -> low, high, in train), ``ids`` (low, high), ``constants`` (count),
    ``shared`` (allowed common timestamps per split pair) and ``reload`` (a second frame).
    Everything is reduced to a few numbers per split before it reaches the driver.
    """
    sensors = sensor_columns(df)
    ranged = list(rules.get("ranges", {}))
    per = _per_split(df, ranged)
    backward, mode = _steps(df)
    checks: list[tuple[str, bool, str]] = []

    def add(name: str, problems: list[str]) -> None:
        checks.append((name, not problems, "; ".join(problems)))

    for kind, column in (("rows", "rows"), ("attack_rows", "attacks")):
        if kind in rules:
            wrong = [
                f"{s} {kind} {per.get(s, {}).get(column, 0)} != {n}"
                for s, n in rules[kind].items() if per.get(s, {}).get(column, 0) != n
            ]
            add(kind.replace("_", " "), wrong)
    if "sensors" in rules:
        add("sensor count", [] if len(sensors) == rules["sensors"] else [f"{len(sensors)} sensors"])
    add("label domain", [f"{s} has other labels" for s, r in per.items() if r["bad_labels"]])
    add(
        "label and attack id agree",
        [f"{s} disagrees" for s, r in per.items() if r["normal_with_id"] or r["attack_without_id"]],
    )
    for s in rules.get("normal", []):
        add(f"{s} labels all 0", [f"{per[s]['attacks']} attack rows"] if per[s]["attacks"] else [])
    if "ids" in rules:
        low, high = rules["ids"]
        add(
            "attack ids in range",
            [s for s, r in per.items() if r["min_id"] is not None and not (low <= r["min_id"] and r["max_id"] <= high)],
        )
    add("strictly increasing timestamps", [f"{s} steps back {n} times" for s, n in backward.items() if n])
    if "cadence" in rules:
        add("cadence", [f"{s} mode {m:g} s" for s, m in mode.items() if m != rules["cadence"]])
    for s, (low, high) in rules.get("ranges", {}).items():
        train = per["train"]
        add(f"{s} on raw scale", [] if train[f"min_{s}"] > low and train[f"max_{s}"] < high else ["out of range"])
    wanted = {"timestamp": "timestamp_ntz", "label": "tinyint", "attack_id": "int", **dict.fromkeys(sensors, "float")}
    add("column types", [f"{c} is {df.schema[c].dataType.simpleString()}" for c, k in wanted.items() if df.schema[c].dataType.simpleString() != k])
    shared = shared_timestamps(df).collect()  # one row per split pair
    allowed = rules.get("shared", {})
    add(
        "no shared timestamps",
        [f"{r['pair']} share {r['n']}" for r in shared if r["n"] > allowed.get(r["pair"], 0)],
    )
    if "constants" in rules:
        n = len(constant_columns(df.filter("split = 'train'"), sensors))
        add("constant columns", [] if n == rules["constants"] else [f"{n} constant"])
    if meta is not None:
        sums = meta.get("raw_file_checksums", {})
        bad = [k for k, v in sums.items() if not (isinstance(v, str) and len(v) == 64)]
        add("checksums", bad if sums else ["none recorded"])
        add("recorded cadence", [] if meta.get("sampling_interval_s") == rules.get("cadence") else ["differs"])
    if "reload" in rules:
        other = rules["reload"].select(*df.columns)
        equal = df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty()
        add("reload equality", [] if equal else ["rows differ"])
    rows = [(dataset, *check) for check in checks]
    return df.sparkSession.createDataFrame(rows, "dataset string, check string, passed boolean, detail string")


def shared_timestamps(df: DataFrame) -> DataFrame:
    """Number of common timestamps per pair of splits."""

    def has(split: str) -> Column:
        return F.max((F.col("split") == split).cast("int"))

    flags = df.groupBy("timestamp").agg(*[has(s).alias(s) for s in SPLITS])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    sums = flags.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}/{b}") for a, b in pairs])
    return sums.unpivot([], [f"{a}/{b}" for a, b in pairs], "pair", "n")

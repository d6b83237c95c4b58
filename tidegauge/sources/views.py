"""Telemetry views over the given tables, and the same views as SQL.

A view is written as Parquet, like the canonical store it stands for: every
ordered operator reads its input more than once. A session writes a view once
per state of its table and reuses it while the table's files stay the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.ordered import with_index
from tidegauge.session import staged

PANEL_SENSORS = ["click", "error", "purchase", "signup", "view"]
VECTOR_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple, DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored view ``name``, written anew when the events files have changed."""
    files = table(spark, sf_dir, "events").select("_metadata.file_path", "_metadata.file_modification_time")
    state = files.agg(F.count_distinct("file_path"), F.max("file_modification_time")).first()
    key = (spark.sparkContext.applicationId, sf_dir, name, *state)
    if key not in _STORED:
        _STORED[key] = staged(build(), name)
    return _STORED[key]


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: ``series_id, t, ts, value, label`` and its length ``n``."""
    return _stored(spark, sf_dir, "series", lambda: _user_series(spark, sf_dir))


def _user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        "event_id",
        "ts",
        "value",
        (F.col("event_type") == "error").cast("int").alias("label"),
    )
    indexed = with_index(events, ["series_id"], "ts", ["event_id"]).drop("event_id")
    sizes = events.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return indexed.join(sizes, "series_id")


def split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_series`` with the first half as train, the next fifth as val, the rest as test."""
    half = F.floor(F.col("n") / 2)
    fifth = F.floor(F.col("n") / 5)
    split = (
        F.when(F.col("t") < half, "train")
        .when(F.col("t") < half + fifth, "val")
        .otherwise("test")
    )
    return user_series(spark, sf_dir).withColumn("split", split)


def hour_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multivariate series: mean value per hour and event type, null where empty."""
    return _stored(spark, sf_dir, "panel", lambda: _hour_panel(spark, sf_dir))


def _hour_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.date_trunc("hour", "ts").alias("hour"), "event_type", "value"
    )
    others = events.filter(~F.col("event_type").isin(PANEL_SENSORS)).select("event_type").limit(1).collect()
    if others:
        raise ValueError(f"event type {others[0][0]!r} has no column in the panel")
    cells = events.groupBy("hour").pivot("event_type", PANEL_SENSORS).agg(F.avg("value"))
    bounds = events.agg(F.min("hour").alias("h0"), F.max("hour").alias("h1"))
    spine = bounds.select(
        "h0", F.explode(F.sequence("h0", "h1", F.expr("INTERVAL 1 HOUR"))).alias("hour")
    )
    t = ((F.unix_timestamp("hour") - F.unix_timestamp("h0")) / 3600).cast("long")
    return (
        spine.join(cells, "hour", "left")
        .select(F.lit("panel").alias("series_id"), t.alias("t"), F.col("hour").alias("ts"), *PANEL_SENSORS)
        .withColumn("label", (F.col("t") % 60 >= 52).cast("int"))
        .withColumn(
            "split",
            F.when(F.col("t") < 360, "train").when(F.col("t") < 504, "val").otherwise("test"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64-sensor series: columns ``v0..v63`` in ``vec_id`` order."""
    raw = table(spark, sf_dir, "embeddings")
    if raw.filter(F.size("embedding") != VECTOR_WIDTH).limit(1).count():
        raise ValueError(f"every vector needs {VECTOR_WIDTH} numbers")
    return raw.select(
        F.lit("vec").alias("series_id"),
        F.col("vec_id").alias("t"),
        *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(VECTOR_WIDTH)],
    )


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel: shipped quantity per supplier and day, ``t`` in days since the first one."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sensor"), F.to_date("l_shipdate").alias("day"), "l_quantity"
    )
    first = lines.agg(F.min("day").alias("d0"))
    return (
        lines.groupBy("sensor", "day")
        .agg(F.sum("l_quantity").alias("value"))
        .join(F.broadcast(first))  # one row
        .select("sensor", F.datediff("day", "d0").cast("long").alias("t"), "day", "value")
    )


# ------------------------------------------------------------------ SQL twins
SERIES_SQL = """
series AS (
  SELECT user_id AS series_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         ts, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
split AS (
  SELECT *, CASE WHEN t < n // 2 THEN 'train' WHEN t < n // 2 + n // 5 THEN 'val' ELSE 'test' END AS split
  FROM series)"""

_PIVOT = ",\n         ".join(
    f"avg(value) FILTER (WHERE event_type = '{s}') AS \"{s}\"" for s in PANEL_SENSORS
)
PANEL_SQL = f"""
cells AS (
  SELECT date_trunc('hour', ts) AS hour, {_PIVOT}
  FROM events GROUP BY 1),
spine AS (
  SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS hour
  FROM events),
panel AS (
  SELECT 'panel' AS series_id, row_number() OVER (ORDER BY s.hour) - 1 AS t, s.hour AS ts,
         {", ".join(f'c."{s}"' for s in PANEL_SENSORS)},
         CASE WHEN (row_number() OVER (ORDER BY s.hour) - 1) % 60 >= 52 THEN 1 ELSE 0 END AS label,
         CASE WHEN row_number() OVER (ORDER BY s.hour) - 1 < 360 THEN 'train'
              WHEN row_number() OVER (ORDER BY s.hour) - 1 < 504 THEN 'val' ELSE 'test' END AS split
  FROM spine s LEFT JOIN cells c ON s.hour = c.hour)"""

SUPPLIER_SQL = """
supplier_days AS (
  SELECT l_suppkey AS sensor, date_diff('day', (SELECT min(l_shipdate) FROM lineitem), l_shipdate) AS t,
         l_shipdate AS day, sum(l_quantity) AS value
  FROM lineitem GROUP BY l_suppkey, l_shipdate)"""

"""Streaming queries over the events file source, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.plans.registry import query, rounded, sql_round
from tidegauge.session import new_path
from tidegauge.streaming import detectors

_D = """d AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, epoch_us(ts) AS us, value - 50.0 - 10.0 AS d, 80.0 AS h, value FROM events)"""
_R = """r AS (SELECT series_id, t, us, greatest(0, d) AS before, h FROM d WHERE t = 0 UNION ALL
  SELECT d.series_id, d.t, d.us, greatest(0, (CASE WHEN r.before > r.h THEN 0 ELSE r.before END) + d.d), d.h FROM r JOIN d ON d.series_id = r.series_id AND d.t = r.t + 1)"""


def events(spark, sf_dir):
    stream = detectors.read_table_stream(spark, sf_dir, "events")
    return stream.select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query(
    "stream_cusum",
    f"""WITH RECURSIVE {_D}, {_R} SELECT series_id, us, {sql_round('before', 5)} AS stat_before,
      {sql_round('CASE WHEN before > h THEN 0 ELSE before END', 5)} AS stat_after, before > h AS alarm, 0 AS late_rows FROM r""",
)
def stream_cusum(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"mu0": F.lit(50.0), "k": F.lit(10.0), "h": F.lit(80.0)})
    closing = detectors.Closing(rows)
    out = detectors.run_available(detectors.stream_cusum(closing.rows, ["series_id"], "value", "mu0", "k", "h"), closing=closing)
    out = out.withColumn("us", F.unix_micros("ts")).drop("ts")
    return rounded(out, "stat_before", "stat_after", digits=5)


@query(
    "stream_adaptive_cusum",
    f"""WITH RECURSIVE {_D}, a AS (
      SELECT series_id, t, us, mu, greatest(0.0, value - mu - 25.0) AS before FROM (
        SELECT *, CASE WHEN abs(value - 50.0) <= 80.0 THEN 50.0 + 0.05 * (value - 50.0) ELSE 50.0 END AS mu FROM d WHERE t = 0)
      UNION ALL SELECT series_id, t, us, mu, greatest(0.0, (CASE WHEN before > 250.0 THEN 0 ELSE before END) + value - mu - 25.0) FROM (
        SELECT d.series_id, d.t, d.us, d.value, a.before, CASE WHEN abs(d.value - a.mu) <= 80.0 THEN a.mu + 0.05 * (d.value - a.mu) ELSE a.mu END AS mu
        FROM a JOIN d ON d.series_id = a.series_id AND d.t = a.t + 1))
    SELECT series_id, us, {sql_round('mu', 8)} AS mu, {sql_round('before', 8)} AS stat_before, before > 250.0 AS alarm, 0 AS late_rows FROM a""",
)
def stream_adaptive_cusum(spark, sf_dir):
    settings = {"mean": 50.0, "std": 50.0, "gate": 1.6, "alpha": 0.05}
    rows = events(spark, sf_dir).withColumns({k: F.lit(v) for k, v in settings.items()})
    closing = detectors.Closing(rows)
    stream = detectors.stream_adaptive_cusum(closing.rows, ["series_id"], "value", "mean", "std", "gate", "alpha")
    out = detectors.run_available(stream, closing=closing).withColumn("us", F.unix_micros("ts")).drop("ts")
    return rounded(out, "mu", "stat_before", digits=8)


@query(
    "stream_ewma",
    f"""WITH {_D} SELECT x.series_id, x.us, {sql_round('abs(sum(0.2 * pow(0.8, x.t - y.t) * y.value))', 5)} AS ewma,
      {sql_round('coalesce(max(x.value) - max(y.value) FILTER (WHERE y.t = x.t - 1), 0)', 5)} AS residual, 0 AS late_rows
    FROM d x JOIN d y ON y.series_id = x.series_id AND y.t <= x.t GROUP BY x.series_id, x.us, x.t""",
)
def stream_ewma(spark, sf_dir):
    closing = detectors.Closing(events(spark, sf_dir))
    out = detectors.run_available(detectors.stream_ewma(closing.rows, ["series_id"], "value"), closing=closing)
    out = out.withColumn("us", F.unix_micros("ts")).drop("ts")
    return rounded(out, "ewma", "residual", digits=5)


ARRIVALS = 4
_DAY = 86_400_000_000

# Readings arrive up to a day after their time, and 3 % of them eight days after it.
_ARRIVED = f"""arrived AS (SELECT user_id AS series_id, epoch_us(ts) AS us, value,
    epoch_us(ts) + CASE WHEN event_id * 7919 % 1000 < 30 THEN 8 * {_DAY} ELSE event_id * 7919 % 1000 * 80000000 END AS came FROM events),
  placed AS (SELECT *, least({ARRIVALS - 1}, {ARRIVALS} * (came - (SELECT min(came) FROM arrived)) // ((SELECT max(us) - min(us) FROM arrived))) AS part FROM arrived),
  marks AS (SELECT b AS part, coalesce((SELECT (max(us) // 1000 - {_DAY // 1000}) * 1000 FROM placed WHERE placed.part < b), 0) AS border FROM range({ARRIVALS + 1}) r(b)),
  told AS (SELECT placed.*, us < border AS late FROM placed JOIN marks USING (part)),
  refused AS (SELECT series_id, us, count(*) OVER (PARTITION BY series_id ORDER BY part RANGE UNBOUNDED PRECEDING) AS late_rows, part FROM told WHERE late)"""


@query(
    "stream_late_rows",
    f"""WITH RECURSIVE {_ARRIVED},
    d AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY us) - 1 AS t, us, value - 50.0 - 10.0 AS d, 80.0 AS h FROM told WHERE NOT late),
    {_R},
    freed AS (SELECT r.*, (SELECT min(part) FROM marks WHERE border > us) AS part FROM r)
    SELECT series_id, us, {sql_round('before', 5)} AS stat_before, before > h AS alarm,
      (SELECT count(*) FROM refused WHERE refused.series_id = freed.series_id AND (freed.part IS NULL OR refused.part < freed.part)) AS late_rows FROM freed
    UNION ALL SELECT series_id, us, NULL, NULL, late_rows FROM refused""",
)
def stream_late_rows(spark, sf_dir):
    """Readings that arrive out of order in several deliveries, some after the watermark."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    share = F.expr("event_id * 7919 % 1000")
    rows = rows.withColumn("came", F.unix_micros("ts") + F.when(share < 30, 8 * _DAY).otherwise(share * 80_000_000))
    ends = rows.agg(F.min("came").alias("first"), F.max(F.unix_micros("ts")).alias("last"), F.min(F.unix_micros("ts")).alias("start")).first()
    part = F.least(F.lit(ARRIVALS - 1), F.expr(f"{ARRIVALS} * (came - {ends['first']}) div {ends['last'] - ends['start']}"))
    rows = rows.withColumn("part", part).select("series_id", "ts", "value", "part")
    folder = new_path(spark, "arrivals")

    def delivery(number: int):
        return lambda: rows.filter(F.col("part") == number).drop("part").write.mode("append").parquet(folder)

    rows.limit(0).drop("part").write.parquet(folder)
    stream = spark.readStream.schema(rows.drop("part").schema).parquet(folder)
    closing = detectors.Closing(stream.withColumns({"mu0": F.lit(50.0), "k": F.lit(10.0), "h": F.lit(80.0)}))
    scored = detectors.stream_cusum(closing.rows, ["series_id"], "value", "mu0", "k", "h", delay="1 day")
    out = detectors.run_available(scored, closing=closing, arrivals=[delivery(i) for i in range(ARRIVALS)])
    out = out.withColumn("us", F.unix_micros("ts")).drop("ts", "stat_after")
    return rounded(out, "stat_before", digits=5)


@query(
    "stream_activation",
    f"""WITH st AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS cells, count(*) FILTER (WHERE value > 100) AS on_ FROM events GROUP BY 1),
    w AS (SELECT date_trunc('day', hour) AS day, sum(cells) AS cells, sum(on_) AS on_, count(*) AS steps, count(*) FILTER (WHERE on_ > 0) AS active FROM st GROUP BY 1)
    SELECT epoch(day)::BIGINT AS window_start, cells::BIGINT AS cells, steps, {sql_round('on_ / cells')} AS active_cell_fraction, {sql_round('active / steps')} AS active_timestep_fraction
    FROM w WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""",
)
def stream_activation(spark, sf_dir):
    """Windows that the watermark has closed."""
    rows = events(spark, sf_dir).withColumn("active", F.col("value") > 100)
    out = detectors.run_available(detectors.stream_activation(rows, "active"))
    out = out.withColumn("window_start", F.unix_timestamp("window_start"))
    return rounded(out, "active_cell_fraction", "active_timestep_fraction")

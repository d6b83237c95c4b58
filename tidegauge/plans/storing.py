"""Queries on plant logs, labels, splits and the audited store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import audit, labelling
from tidegauge.operators.ordered import with_index
from tidegauge.operators.scaling import require_columns
from tidegauge.plans.registry import query, rounded, sql_round
from tidegauge.session import new_path, staged
from tidegauge.sources import plant_logs, store, views
from tidegauge.sources.views import PANEL_SENSORS, PANEL_SQL, SERIES_SQL

KEY = ["series_id"]


def written_log(spark, sf_dir, sep=";", banner=()):
    """Events exported as a plant log: text columns, 12-hour clock, some bad readings."""
    events = views.table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    bad = F.col("event_id") % 17 == 0
    rows = events.select(
        F.col("event_id").cast("string").alias("Row"),
        F.date_format(ts, "d/M/yyyy").alias("Date"),
        F.date_format(ts, "h:mm:ss a").alias("Time"),
        F.when(bad, "Bad Input").otherwise(F.col("value").cast("string")).alias("FIT101.Pv"),
        F.col("user_id").cast("string").alias("P101.Status"),
        F.when(F.col("event_type") == "error", "1").otherwise("-999").alias("ATT_FLAG"),
    )
    header = sep.join(f"  {c} " for c in rows.columns)
    lines = rows.select(F.concat_ws(sep, *[F.col(f"`{c}`") for c in rows.columns]).alias("value"))
    path = new_path(spark, "log")
    for i, line in enumerate([*banner, header]):
        head = spark.range(1).select(F.lit(line).alias("value"))
        head.write.mode("append").text(f"{path}/part={i:02d}")
    lines.write.text(f"{path}/part=99")
    return path, [*banner, header]


def read_log(spark, sf_dir):
    path, _ = written_log(spark, sf_dir)
    files = [f"{path}/part=00", f"{path}/part=99"]
    return plant_logs.read_plant_csv(spark, files, ";")


_EVENT_SECONDS = "date_trunc('second', ts)"


@query(
    "plant_log_rows",
    """SELECT event_id::VARCHAR AS "Row", strftime(ts, '%-d/%-m/%Y') AS "Date", CASE WHEN event_id % 17 = 0 THEN 'Bad Input' END AS bad,
      CASE WHEN event_type = 'error' THEN '1' ELSE '-999' END AS "ATT_FLAG" FROM events""",
)
def plant_log_rows(spark, sf_dir):
    rows = read_log(spark, sf_dir)
    bad = F.when(F.col("`FIT101.Pv`") == "Bad Input", F.col("`FIT101.Pv`"))
    return rows.select("Row", "Date", bad.alias("bad"), "ATT_FLAG")


@query(
    "parsed_timestamps",
    f"SELECT event_id AS id, epoch({_EVENT_SECONDS})::BIGINT AS twelve_hour, epoch(date_trunc('hour', ts))::BIGINT AS hourly,"
    " epoch_us(ts) AS fraction FROM events",
)
def parsed_timestamps(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    text = events.select(
        F.col("event_id").alias("id"),
        F.date_format(ts, "d/M/yyyy").alias("date"), F.date_format(ts, "h:mm:ss a").alias("time"),
        F.date_format(ts, "dd/MM/yy HH").alias("hour"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("iso"),
    )
    out = plant_logs.parse_ts(text, "day_first_12h", "date", "time", out="a")
    out = plant_logs.parse_ts(out, "day_first_hour", "hour", out="b")
    out = plant_logs.parse_ts(out, "iso_fraction", "iso", out="c")
    out = plant_logs.epoch_seconds(plant_logs.epoch_seconds(out, "a", "twelve_hour"), "b", "hourly")
    return out.select("id", "twelve_hour", "hourly", F.unix_micros(F.col("c").cast("timestamp")).alias("fraction"))


@query(
    "coerced_tags",
    "SELECT event_id::VARCHAR AS \"Row\", CASE WHEN event_id % 17 <> 0 THEN value END AS \"FIT101\", user_id::DOUBLE AS \"P101\" FROM events",
)
def coerced_tags(spark, sf_dir):
    return plant_logs.coerce_tags(read_log(spark, sf_dir), ["FIT101", "P101"], ["Row"])


@query(
    "flag_labels",
    "SELECT event_id::VARCHAR AS \"Row\", CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CASE WHEN event_type = 'error' THEN 1 END AS attack_id FROM events",
)
def flag_labels(spark, sf_dir):
    rows = read_log(spark, sf_dir).withColumn("ATT_FLAG", F.col("ATT_FLAG").cast("int"))
    return labelling.label_from_flag(rows, "ATT_FLAG").select("Row", "label", "attack_id")


@query(
    "phase_labels",
    """SELECT event_id, CASE WHEN value > 60 OR user_id % 3 = 0 OR event_type = 'view' THEN 1 ELSE 0 END AS label,
      nullif((value > 60)::INT * 4 + (user_id % 3 = 0)::INT * 2 + (event_type = 'view')::INT, 0) AS attack_id FROM events""",
)
def phase_labels(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").withColumns(
        {"p1": F.col("value") > 60, "p2": F.col("user_id") % 3 == 0, "p3": F.col("event_type") == "view"}
    ).withColumn("attack", (F.col("p1") | F.col("p2") | F.col("p3")).cast("int"))
    return labelling.label_from_phases(events, "attack", ["p1", "p2", "p3"]).select("event_id", "label", "attack_id")


@query(
    "synthesized_timestamps",
    "SELECT event_id, epoch(date_trunc('day', ts))::BIGINT + row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) - 1 AS at FROM events",
)
def synthesized_timestamps(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    out = labelling.synthesize_ts(rows, "day", ["event_id"])
    return out.select("event_id", F.unix_timestamp("timestamp").alias("at"))


# An attack list derived from the largest values of every user: starts a little
# early, some dated a year too soon, some ending after midnight.
_RAW_IV = """top AS (SELECT user_id, ts, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
raw AS (SELECT row_number() OVER (ORDER BY event_id) AS list_pos, user_id AS attack_id, date_trunc('second', ts) AS at,
   CASE WHEN user_id % 5 = 0 THEN date_trunc('second', ts) - INTERVAL 1 YEAR ELSE date_trunc('second', ts) END AS start,
   date_trunc('day', CASE WHEN user_id % 5 = 0 THEN date_trunc('second', ts) - INTERVAL 1 YEAR ELSE date_trunc('second', ts) END)
     + ((epoch(date_trunc('second', ts))::BIGINT % 86400 + 7200) % 86400) * INTERVAL 1 SECOND AS end_
   FROM top WHERE r = 1),
rolled AS (SELECT list_pos, attack_id, start, CASE WHEN end_ <= start THEN end_ + INTERVAL 1 DAY ELSE end_ END AS end_ FROM raw),
iv AS (SELECT list_pos, attack_id, CASE WHEN early THEN start + INTERVAL 1 YEAR ELSE start END AS start, CASE WHEN early THEN end_ + INTERVAL 1 YEAR ELSE end_ END AS end_
  FROM (SELECT *, start < (SELECT min(ts) FROM events) AND epoch((SELECT date_trunc('second', min(ts)) FROM events)) - epoch(start) < 365 * 86400 AS early FROM rolled))"""


def raw_intervals(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    top = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts"), F.struct("value", -F.col("event_id"))).alias("e"))
    at = F.date_trunc("second", F.col("e.ts")).cast("timestamp_ntz")
    start = F.when(F.col("user_id") % 5 == 0, at - F.expr("INTERVAL 1 YEAR")).otherwise(at)
    second = F.pmod(F.unix_timestamp(at.cast("timestamp")) % 86400 + 7200, F.lit(86400))
    end = F.date_trunc("day", start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)
    # one interval per user; the list position orders a table of that size
    rows = top.select(
        F.col("e.event_id").alias("list_pos"), F.col("user_id").alias("attack_id"), start.alias("start"), end.alias("end")
    )
    first = events.agg(F.min("ts").alias("data_start"))
    return rows.join(F.broadcast(first))  # one row


@query(
    "normalized_intervals",
    f"WITH {_RAW_IV} SELECT attack_id, epoch(start)::BIGINT AS start, epoch(end_)::BIGINT AS stop FROM iv",
)
def normalized_intervals(spark, sf_dir):
    out = labelling.normalize_intervals(raw_intervals(spark, sf_dir), F.col("data_start"))
    return out.select(
        "attack_id", F.unix_timestamp(F.col("start").cast("timestamp")).alias("start"),
        F.unix_timestamp(F.col("end").cast("timestamp")).alias("stop"),
    )


@query(
    "interval_labels",
    f"""WITH {_RAW_IV}, hit AS (SELECT e.event_id, max_by(iv.attack_id, iv.list_pos) AS attack_id FROM events e JOIN iv ON e.ts >= iv.start AND e.ts <= iv.end_ GROUP BY e.event_id)
    SELECT e.event_id, CASE WHEN h.attack_id IS NULL THEN 0 ELSE 1 END AS label, h.attack_id FROM events e LEFT JOIN hit h ON h.event_id = e.event_id""",
)
def interval_labels(spark, sf_dir):
    intervals = labelling.normalize_intervals(raw_intervals(spark, sf_dir), F.col("data_start"))
    out = labelling.label_by_intervals(views.table(spark, sf_dir, "events"), intervals, "ts")
    return out.select("event_id", "label", "attack_id")


@query(
    "chronological_splits",
    f"""WITH {SERIES_SQL} SELECT series_id, t, CASE WHEN t >= n - 10 THEN 'val' ELSE 'train' END AS last_rows,
      CASE WHEN t >= n - floor(n * 0.2) THEN 'val' ELSE 'train' END AS last_share, CASE WHEN t >= floor(n * 0.8) THEN 'val' ELSE 'train' END AS first_share,
      CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'val' ELSE 'train' END AS dated FROM series""",
)
def chronological_splits(spark, sf_dir):
    rows = views.user_series(spark, sf_dir)
    for name, rule in (
        ("last_rows", {"last_n": 10}), ("last_share", {"last_frac": 0.2}),
        ("first_share", {"first_frac": 0.8}), ("dated", {"cutoff": "2024-01-20", "ts": "ts"}),
    ):
        rows = labelling.chrono_split(rows, KEY, **rule).withColumnRenamed("split", name)
    return rows.select("series_id", "t", "last_rows", "last_share", "first_share", "dated")


@query(
    "boundary_guard",
    """WITH last AS (SELECT user_id, max(ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id)
    SELECT e.event_id FROM events e LEFT JOIN last l ON l.user_id = e.user_id WHERE e.ts >= TIMESTAMP '2024-01-10' AND (l.m IS NULL OR e.ts > l.m)""",
)
def boundary_guard(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    cut = lambda day: F.lit(day).cast("timestamp_ntz")
    train, val = events.filter(F.col("ts") < cut("2024-01-16")), events.filter(F.col("ts") >= cut("2024-01-10"))
    return labelling.boundary_guard(train, val, ["user_id"], "ts").select("event_id")


@query(
    "boundary_guard_gap",
    """WITH last AS (SELECT user_id, max(ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
    first AS (SELECT user_id, min(ts) AS f FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND (user_id % 3 > 0 OR ts >= TIMESTAMP '2024-01-16') GROUP BY user_id)
    SELECT e.event_id FROM events e JOIN first USING (user_id) LEFT JOIN last l USING (user_id) WHERE e.ts >= TIMESTAMP '2024-01-10'
      AND (user_id % 3 > 0 OR e.ts >= TIMESTAMP '2024-01-16') AND (l.m IS NULL OR f > l.m OR epoch_us(e.ts) > epoch_us(l.m) + 172800000000)""",
)
def boundary_guard_gap(spark, sf_dir):
    """Two days of distance for series that overlap, none for those that begin later."""
    events = views.table(spark, sf_dir, "events")
    cut = lambda day: F.lit(day).cast("timestamp_ntz")
    train = events.filter(F.col("ts") < cut("2024-01-16"))
    val = events.filter((F.col("ts") >= cut("2024-01-10")) & ((F.col("user_id") % 3 > 0) | (F.col("ts") >= cut("2024-01-16"))))
    return labelling.boundary_guard(train, val, ["user_id"], "ts", gap_seconds=172_800).select("event_id")


@query("joined_files", "SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM events WHERE event_type = 'view'")
def joined_files(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_id", "value")
    views_only = views.table(spark, sf_dir, "events").filter("event_type = 'view'").select("value", "event_id")
    return plant_logs.concat_files(events, views_only)


def panel_store(spark, sf_dir):
    """The panel written as a canonical store under the name ``swat``; returns its root."""
    panel = views.hour_panel(spark, sf_dir)
    rows = panel.withColumns(
        {
            "dataset": F.lit("swat"), "timestamp": F.col("ts").cast("timestamp_ntz"), "valve": F.lit(1.0),
            "attack_id": F.when((F.col("label") == 1) & (F.col("split") == "test"), F.floor(F.col("t") / 60)),
        }
    ).withColumn("label", F.when(F.col("split") == "test", F.col("label")).otherwise(0))
    root = new_path(spark, "store")
    store.write_store(store.canonical(rows, [*PANEL_SENSORS, "valve"]), root)
    return root


@query(
    "store_split",
    f"WITH {PANEL_SQL} SELECT epoch(ts)::BIGINT AS at, label, CASE WHEN label = 1 THEN t // 60 END AS attack_id, {sql_round('click::FLOAT::DOUBLE', 4)} AS click FROM panel WHERE split = 'test'",
)
def store_split(spark, sf_dir):
    test = store.load_dataset(spark, panel_store(spark, sf_dir), "swat", "test")
    at = F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("at")
    return rounded(test.select(at, "label", "attack_id", F.col("click").cast("double").alias("click")), "click", digits=4)


@query(
    "store_meta",
    f"WITH {PANEL_SQL} SELECT 'swat' AS dataset, split, epoch(min(ts))::BIGINT AS first_at, epoch(max(ts))::BIGINT AS last_at, count(*) AS rows FROM panel GROUP BY split",
)
def store_meta(spark, sf_dir):
    meta = store.store_meta(spark.read.parquet(panel_store(spark, sf_dir)))
    at = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return meta.select("dataset", "split", at("start").alias("first_at"), at("end").alias("last_at"), "rows")


@query(
    "constant_sensors",
    f"""WITH {PANEL_SQL}, c AS (SELECT {', '.join(f"count(DISTINCT {s}) <= 1 AS {s}" for s in PANEL_SENSORS)}, TRUE AS valve FROM panel WHERE split = 'train'),
    u AS (UNPIVOT c ON COLUMNS(*) INTO NAME sensor VALUE constant) SELECT sensor, constant FROM u""",
)
def constant_sensors(spark, sf_dir):
    train = store.load_dataset(spark, panel_store(spark, sf_dir), "swat", "train")
    sensors = store.sensor_columns(train)
    both = {r: set(store.constant_columns(train, sensors, r)) for r in ("distinct", "deviation")}
    if both["distinct"] != both["deviation"]:
        raise ValueError("the two rules differ on this table")
    return spark.createDataFrame([(s, s in both["distinct"]) for s in sensors], "sensor string, constant boolean")


@query(
    "file_checksum_shapes",
    "SELECT 64 AS digits, count(*) > 0 AS found FROM region",
)
def file_checksum_shapes(spark, sf_dir):
    sums = store.file_checksums(spark, f"{sf_dir}/events.parquet")
    return sums.agg(F.max(F.length("sha256")).cast("long").alias("digits"), (F.count(F.lit(1)) > 0).alias("found"))


@query(
    "store_audit",
    f"""WITH {PANEL_SQL}, v AS (SELECT unnest(['rows', 'sensor count', 'label domain', 'label and attack id agree', 'train labels all 0', 'val labels all 0',
      'strictly increasing timestamps', 'cadence', 'click on raw scale', 'column types', 'no shared timestamps', 'constant columns', 'checksums',
      'recorded cadence', 'reload equality']) AS "check")
    SELECT 'swat' AS dataset, "check", CASE "check" WHEN 'click on raw scale' THEN (SELECT min(click) > 0 AND max(click) < 100 FROM panel WHERE split = 'train') ELSE TRUE END AS passed FROM v""",
)
def store_audit(spark, sf_dir):
    root = panel_store(spark, sf_dir)
    rows = staged(with_index(spark.read.parquet(root), ["split"], "timestamp"), "audited")
    loaded = [
        store.load_dataset(spark, root, "swat", s).withColumn("split", F.lit(s)) for s in store.SPLITS
    ]
    again = staged(with_index(plant_logs.concat_files(*loaded), ["split"], "timestamp"), "reloaded")
    sums = {r["file"]: r["sha256"] for r in store.file_checksums(spark, f"{sf_dir}/events.parquet").collect()}
    rules = {
        "rows": {"train": 360, "val": 144}, "sensors": 6, "normal": ["train", "val"], "cadence": 3600,
        "ranges": {"click": (0, 100)}, "constants": 1, "reload": again,
    }
    out = store.audit_store(
        rows.drop("dataset"), "swat", rules, {"raw_file_checksums": sums, "sampling_interval_s": 3600},
    )
    return require_columns(out, ["dataset", "check", "passed"])


# The panel with faults of every kind, each on rows chosen by their place.
FAULTS_SQL = f"""{PANEL_SQL}, bad AS (SELECT split, t, CASE WHEN t % 97 = 13 THEN ts - INTERVAL 1 HOUR WHEN t % 101 = 40 THEN ts - INTERVAL 5 HOUR ELSE ts END AS ts,
    CASE WHEN t % 150 = 7 THEN 2 ELSE label END AS label, CASE WHEN label = 1 AND t % 11 <> 3 THEN t // 60 WHEN t % 180 = 9 THEN 99 END AS attack_id,
    CASE WHEN t % 200 = 50 THEN 1e6 ELSE click END AS click, error, "purchase", signup, CASE WHEN split = 'train' THEN 1.0 ELSE view END AS view FROM panel)"""
_FAULT_SENSORS = list(PANEL_SENSORS)
_KINDS = {"timestamp": "timestamp_ntz", "label": "int", "attack_id": "bigint", "click": "float", "view": "double"}


def faulty_panel(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    t = F.col("t")
    hours = F.when(t % 97 == 13, 1).when(t % 101 == 40, 5).otherwise(0)
    at = F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) - 3600 * hours).cast("timestamp_ntz")
    attack = F.when((F.col("label") == 1) & (t % 11 != 3), F.floor(t / 60)).when(t % 180 == 9, F.lit(99).cast("long"))
    changed = {
        "timestamp": at, "attack_id": attack, "label": F.when(t % 150 == 7, 2).otherwise(F.col("label")),
        "click": F.when(t % 200 == 50, 1e6).otherwise(F.col("click")), "view": F.when(F.col("split") == "train", 1.0).otherwise(F.col("view")),
    }
    rows = panel.withColumns(changed).select("split", "t", "timestamp", "label", "attack_id", *_FAULT_SENSORS)
    first = rows.groupBy("split").agg(F.min("t").alias("_first"))
    return rows.join(first, "split").withColumn("t", t - F.col("_first")).drop("_first")


def _sql_of(rules) -> str:
    """The rules as rows of SQL."""
    number = lambda x: "'infinity'::DOUBLE" if x == float("inf") else f"{x!r}::DOUBLE"
    return "VALUES " + ", ".join(f"('{r.check}', '{r.grain}', '{r.subject}', '{r.measure}', {number(r.low)}, {number(r.high)})" for r in rules)


AUDIT_RULES = audit.standard_rules(
    store.SPLITS, _FAULT_SENSORS, _KINDS, 3600, rows={"train": 360, "val": 144, "test": 216}, attack_rows={"train": 48, "val": 16, "test": 32},
    normal=["train", "val"], ids=(0, 50), ranges={"click": (0, 200), "error": (0, 200), "view": (0, 200)}, constants=["view"], shared={"train/val": 1},
    reload=True,
)


def _sensor_sql(s: str) -> str:
    return f"""SELECT 'sensor' AS grain, '{s}' AS subject, unnest(['min', 'max', 'nulls', 'nonfinite', 'constant']) AS measure,
      unnest([min({s}) FILTER (split = 'train'), max({s}) FILTER (split = 'train'), count(*) - count({s}), count(*) FILTER (NOT isfinite({s})),
        coalesce((min({s}) FILTER (split = 'train') = max({s}) FILTER (split = 'train'))::INT, 1)]::DOUBLE[]) AS value FROM bad"""


@query(
    "audit_rules",
    f"""WITH {FAULTS_SQL}, steps AS (SELECT split, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY split ORDER BY t)) AS d FROM bad),
    counted AS (SELECT split, d, count(*) AS n FROM steps WHERE d IS NOT NULL GROUP BY split, d),
    measures AS (
      SELECT 'split' AS grain, split AS subject, unnest(['rows', 'attack_rows', 'bad_labels', 'normal_with_id', 'attack_without_id', 'null_times', 'min_id', 'max_id']) AS measure,
        unnest([count(*), count(*) FILTER (label = 1), count(*) FILTER (label NOT IN (0, 1)), count(*) FILTER (label <> 1 AND attack_id IS NOT NULL),
          count(*) FILTER (label = 1 AND attack_id IS NULL), 0, min(attack_id), max(attack_id)]::DOUBLE[]) AS value FROM bad GROUP BY split
      UNION ALL SELECT 'split', split, unnest(['backward', 'repeated', 'mode']),
        unnest([coalesce(sum(n) FILTER (d < 0), 0), coalesce(sum(n) FILTER (d = 0), 0), max_by(d, (n, -d)) / 1e6]::DOUBLE[]) FROM counted GROUP BY split
      UNION ALL {' UNION ALL '.join(_sensor_sql(s) for s in _FAULT_SENSORS)}
      UNION ALL SELECT 'pair', a.split || '/' || b.split, 'shared', (SELECT count(*) FROM (SELECT ts FROM bad x WHERE x.split = a.split INTERSECT SELECT ts FROM bad y WHERE y.split = b.split))
        FROM (SELECT unnest(['train', 'train', 'val']) AS split, unnest(['val', 'test', 'test']) AS other) a JOIN (SELECT DISTINCT split FROM bad) b ON b.split = a.other
      UNION ALL SELECT 'table', 'sensors', 'count', {len(_FAULT_SENSORS)}
      UNION ALL SELECT 'table', unnest(['timestamp', 'label', 'attack_id', 'click', 'view']), 'wrong_type', unnest([typeof(ts) <> 'TIMESTAMP', typeof(label) <> 'INTEGER',
        typeof(attack_id) <> 'BIGINT', typeof(click) <> 'FLOAT', typeof(view) <> 'DOUBLE'])::INT FROM (SELECT * FROM bad LIMIT 1)
      UNION ALL SELECT 'meta', 'store', 'cadence', (SELECT max_by(d, n) FROM counted) / 1e6
      UNION ALL SELECT 'table', 'reload', unnest(['lost', 'added']), count(*) FILTER (t % 100 = 4) FROM bad
    ), rules("check", grain, subject, measure, low, high) AS ({_sql_of(AUDIT_RULES)})
    SELECT 'panel' AS dataset, "check", coalesce(value BETWEEN low AND high, FALSE) AS passed FROM rules LEFT JOIN measures USING (grain, subject, measure)""",
)
def audit_rules(spark, sf_dir):
    """All rules on a panel with faults and a reload that changed some rows."""
    rows = staged(faulty_panel(spark, sf_dir), "faulty")
    places = rows.join(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split")
    first = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 360).otherwise(504)
    again = places.withColumn("error", F.when((F.col("t") + first) % 100 == 4, -1.0).otherwise(F.col("error"))).drop("n")
    measures = [
        audit.split_measures(rows), audit.step_measures(rows), audit.sensor_measures(rows, _FAULT_SENSORS), audit.pair_measures(rows, store.SPLITS),
        audit.table_measures(rows, _FAULT_SENSORS, _KINDS, again), audit.meta_measures(spark, 3600.0),
    ]
    return audit.judge(measures, AUDIT_RULES, "panel").select("dataset", "check", "passed")


BLOCKS = [
    ("model_fit", "train", 0, 300), ("model_selection", "train", 300, 360), ("clean_calibration", "val", 0, 48),
    ("development", "val", 48, 96), ("sealed", "val", 96, 144),
]


@query(
    "block_assignment",
    f"""WITH {PANEL_SQL}, p AS (SELECT *, CASE WHEN split = 'val' THEN t - 360 ELSE t END AS i FROM panel WHERE split <> 'test')
    SELECT split, i, CASE WHEN split = 'train' THEN CASE WHEN i < 300 THEN 'model_fit' ELSE 'model_selection' END
      WHEN i < 48 THEN 'clean_calibration' ELSE 'development' END AS block FROM p WHERE NOT (split = 'val' AND i >= 96)""",
)
def block_assignment(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    rows = panel.withColumn("i", F.when(F.col("split") == "val", F.col("t") - 360).otherwise(F.col("t")))
    return labelling.assign_blocks(rows, BLOCKS, "i", held_out=["sealed"]).select("split", "i", "block")


# Block tables as written down, two of them wrongly: one leaves out rows, one is dated an hour late.
_CLAIMED = """rows_ AS (SELECT split, t, CASE WHEN split = 'val' THEN t - 360 ELSE t END AS i, ts FROM panel WHERE split <> 'test'),
  named AS (SELECT *, CASE WHEN split = 'train' THEN CASE WHEN i < 300 THEN 'model_fit' ELSE 'model_selection' END
    WHEN i < 48 THEN 'clean_calibration' WHEN i < 96 THEN 'development' ELSE 'sealed' END AS name FROM rows_),
  blocks AS (SELECT name, split, min(i) + CASE WHEN name = 'development' THEN 2 ELSE 0 END AS row_start, max(i) + 1 AS row_stop, min(t) AS pos,
    epoch(min(ts))::BIGINT + CASE WHEN name = 'sealed' THEN 3600 ELSE 0 END AS s, epoch(max(ts))::BIGINT AS e FROM named GROUP BY name, split)"""


@query(
    "block_audit",
    f"""WITH {PANEL_SQL}, {_CLAIMED} SELECT name, split, e = s + (row_stop - row_start - 1) * 3600 AS length_matches,
      coalesce(s = lag(e) OVER (ORDER BY pos) + 3600, TRUE) AS follows_previous,
      coalesce(row_start = lag(row_stop) OVER (PARTITION BY split ORDER BY pos), TRUE) AS contiguous_rows FROM blocks""",
)
def block_audit(spark, sf_dir):
    panel = views.hour_panel(spark, sf_dir)
    rows = panel.withColumn("i", F.when(F.col("split") == "val", F.col("t") - 360).otherwise(F.col("t")))
    rows = labelling.assign_blocks(rows, BLOCKS, "i")
    table = rows.groupBy(F.col("block").alias("name"), "split").agg(
        F.min("i").alias("row_start"), (F.max("i") + 1).alias("row_stop"), F.min("ts").alias("start"),
        F.max("ts").alias("end"), F.min("t").alias("pos"),
    )
    late = F.when(F.col("name") == "sealed", F.expr("start + INTERVAL 1 HOUR")).otherwise(F.col("start"))
    skipped = F.when(F.col("name") == "development", 2).otherwise(0)
    return labelling.audit_blocks(table.withColumns({"start": late, "row_start": F.col("row_start") + skipped}), 3600)


@query(
    "series_fingerprint",
    f"""WITH {SERIES_SQL}, a AS (SELECT series_id, count(*) AS rows, string_agg(round(value * 100)::BIGINT::VARCHAR, ',' ORDER BY t) AS s FROM series GROUP BY series_id)
    SELECT series_id, rows, sha256(rows || ':' || sha256(sha256(sha256(s)))) AS fingerprint FROM a""",
)
def series_fingerprint(spark, sf_dir):
    rows = views.user_series(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return labelling.series_fingerprint(rows, KEY, "cents")

"""State carried over micro-batches, order by event time, late rows, the end of a stream."""

import random

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries

from tidegauge.plans.registry import QUERIES
from tidegauge.streaming import detectors


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        pdf = pd.DataFrame(rows, columns=["k", "second", "y"])
        pdf["ts"] = pd.to_datetime(pdf.pop("second"), unit="s")
        pdf["ts"] = pdf["ts"].astype("datetime64[us]")
        pdf.to_parquet(folder / f"readings-{i}.parquet")
    schema = "k string, y double, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def cusum(stream, delay="1 hour"):
    rows = stream.withColumns({"m": F.lit(0.0), "q": F.lit(0.5), "h": F.lit(4.0)})
    closing = detectors.Closing(rows)
    out = detectors.run_available(detectors.stream_cusum(closing.rows, ["k"], "y", "m", "q", "h", delay=delay), closing=closing)
    return sorted((r["k"], int(r["ts"].timestamp()), r["stat_before"], r["alarm"], r["late_rows"]) for r in out.collect())


def test_disorder_within_the_delay_changes_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randrange(-2, 4))) for k in "abc" for i in range(200)]
    arrived = sorted(rows, key=lambda r: r[1] + rng.random() * 40)
    batches = [arrived[i : i + 60] for i in range(0, 600, 60)]
    got = cusum(feed(spark, tmp_path, batches), "41 seconds")
    want = []
    for k in "abc":
        s = 0.0
        for _, i, y in [r for r in rows if r[0] == k]:
            s = max(0.0, s + y - 0.5)
            want.append((k, i, s, s > 4.0, 0))
            s = 0.0 if s > 4.0 else s
    assert got == want


def test_late_rows_are_counted_and_returned(spark, tmp_path):
    batches = [
        [("a", 2, 2.0), ("a", 1, 1.0), ("b", 1, 9.0), ("a", 9, 0.0)],
        [("a", 10, 3.0), ("b", 12, 1.0)],
        [("a", 4, 50.0), ("c", 3, 1.0)],  # only late rows: the watermark is at 12 - 2
        [("a", 11, 0.5), ("a", 9, 7.0), ("b", 40, 1.0)],
    ]
    rows = feed(spark, tmp_path, batches).withColumns({"m": F.lit(0.0), "q": F.lit(0.5), "h": F.lit(4.0)})
    closing = detectors.Closing(rows)
    stream = detectors.stream_cusum(closing.rows, ["k"], "y", "m", "q", "h", delay="2 seconds")
    out = detectors.run_available(stream, closing=closing).collect()
    got = {(r["k"], int(r["ts"].timestamp()), r["stat_before"], r["alarm"], r["late_rows"]) for r in out}
    assert len(got) == len(out) and got == {
        ("a", 1, 0.5, False, 0), ("a", 2, 2.0, False, 0), ("a", 9, 1.5, False, 1), ("a", 10, 4.0, False, 2),
        ("a", 4, None, None, 1), ("a", 9, None, None, 2), ("a", 11, 4.0, False, 2), ("c", 3, None, None, 1),
        ("b", 1, 8.5, True, 0), ("b", 12, 0.5, False, 0), ("b", 40, 1.0, False, 0),
    }


def test_nothing_is_scored_before_the_watermark(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("a", 1, 1.0), ("a", 5, 1.0)], [("a", 3, 1.0), ("a", 20, 1.0)]])
    out = detectors.run_available(detectors.stream_ewma(stream, ["k"], "y", 0.5, delay="10 seconds"))
    assert sorted(int(r["ts"].timestamp()) for r in out.collect()) == [1, 3, 5]


def test_ewma_and_residual_over_batches(spark, tmp_path):
    values = [1.0, 3.0, 2.0, 5.0]
    closing = detectors.Closing(feed(spark, tmp_path, [[("a", i, v)] for i, v in enumerate(values)]))
    stream = detectors.stream_ewma(closing.rows, ["k"], "y", 0.5)
    out = detectors.run_available(stream, closing=closing).orderBy("ts").collect()
    level, want = 0.0, []
    for i, v in enumerate(values):
        level = 0.5 * v + 0.5 * level
        want.append((level, v - values[max(0, i - 1)]))
    assert [(r["ewma"], r["residual"]) for r in out] == want


def test_the_query_meets_late_rows(spark):
    rows = QUERIES["stream_late_rows"](spark, "/root/testdata/sf0.001").collect()
    late = [r for r in rows if r["stat_before"] is None]
    assert len(late) > 5 and max(r["late_rows"] for r in rows) > 0

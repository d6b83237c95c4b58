"""Keys of a stream share the state of a group, and stay apart in it."""

import pandas as pd
from pyspark.sql import functions as F

from tidegauge.session import new_path
from tidegauge.streaming import detectors


def test_state_does_not_grow_by_rows_of_its_own_for_every_key(spark, tmp_path):
    spark.range(5_000).select("id", F.lit(1.0).alias("y"), F.timestamp_seconds("id").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, y double, ts timestamp").parquet(str(tmp_path / "in"))
    scored = detectors.stream_ewma(stream, ["id"], "y", 0.5, delay="30 days")
    query = scored.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = query.option("checkpointLocation", new_path(spark, "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert 0 < held < 5_000


def test_keys_of_one_group_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(detectors, "GROUPS", 1)
    big = 2**53 + 1  # a null beside it must not turn it into a double
    parts = [[(big, "x", 1, 2.0), (None, "x", 2, 4.0), (big, None, 1, 8.0)], [(big - 1, "x", 1, 6.0), (big, "x", 3, 4.0), (None, "x", 1, 0.0)]]
    for i, rows in enumerate(parts):
        pdf = pd.DataFrame(rows, columns=["a", "b", "second", "y"])
        pdf["a"] = pd.array([r[0] for r in rows], dtype="Int64")  # from the rows: the frame holds doubles
        pdf["ts"] = pd.to_datetime(pdf.pop("second"), unit="s").astype("datetime64[us]")
        pdf.to_parquet(tmp_path / f"readings-{i}.parquet")
    schema = "a long, b string, y double, ts timestamp"
    closing = detectors.Closing(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)))
    out = detectors.run_available(detectors.stream_ewma(closing.rows, ["a", "b"], "y", 0.5), closing=closing)
    assert out.select("a", "b").dtypes == [("a", "bigint"), ("b", "string")]
    got = {(r["a"], r["b"], int(r["ts"].timestamp())): (r["ewma"], r["residual"], r["late_rows"]) for r in out.collect()}
    assert got == {
        (big, "x", 1): (1.0, 0.0, 0), (big, "x", 3): (2.5, 2.0, 0), (big, None, 1): (4.0, 0.0, 0),
        (big - 1, "x", 1): (3.0, 0.0, 0), (None, "x", 1): (0.0, 0.0, 0), (None, "x", 2): (2.0, 4.0, 0),
    }

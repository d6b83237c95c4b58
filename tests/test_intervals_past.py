"""Interval cells that carry the rows before them, against joins on every cell."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import recovery
from tidegauge.plans import recovering

SF = "/root/testdata/sf0.001"


def case(spark):
    """Three series, one with a single row of history; intervals at the start, at the end and over it."""
    clean = spark.range(300).selectExpr("id % 3 AS series_id", "id div 3 - CASE id % 3 WHEN 0 THEN 40 WHEN 1 THEN 1 ELSE 7 END AS t", "CAST(hash(id) % 1000 AS double) AS value")
    clean = clean.withColumn("value", F.when(F.col("t") % 13 == 5, None).otherwise(F.col("value")))
    ends = clean.groupBy("series_id").agg(F.max("t").alias("last"))
    scen = ends.withColumn("onset", F.explode(F.expr("array(0L, 1L, 6L, 15L, 16L, 31L, last - 3, last - 1)")))
    scen = scen.withColumn("duration", F.explode(F.expr("array(1L, 4L)")))
    return clean, scen.select(
        "series_id", F.concat_ws("-", "onset", "duration").alias("scenario_id"), "onset", "duration",
        (F.col("onset") + F.col("duration")).alias("offset"), F.lit(3.5).alias("amplitude"),
    )


@pytest.mark.parametrize("size", [recovery.ONSETS, 16])
@pytest.mark.parametrize("lag", [1, 2, 5])
def test_past_rows_give_what_joins_give(spark, monkeypatch, size, lag):
    monkeypatch.setattr(recovery, "ONSETS", size)
    clean, scen = case(spark)
    cells = recovery.interval_rows(scen, clean, 5, 4).withColumn("y", F.col("x") + F.col("amplitude"))
    got = recovery.persistence_past(cells, lag, F.col("first") + F.col("amplitude"))
    hit = scen.withColumn("t", F.explode(F.sequence("onset", F.col("offset") - 1))).join(clean, ["series_id", "t"])
    hit = hit.withColumn("y", F.col("value") + F.col("amplitude"))
    want = recovery.persistence_declared(hit, clean, lag)
    columns = ["series_id", "scenario_id", "t", "y", "x_hat", "delta_hat"]
    key = lambda r: tuple(r[:3])
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(map(tuple, want.select(columns).collect()), key=key)


def test_attacked_cells_are_not_shuffled_for_an_estimate(spark):
    """Joins on cells grew the suite's shuffles to ten times its result."""
    hits = recovering.attacked(spark, SF).withColumn("cell", F.lit(1))
    for estimate in recovering.ESTIMATORS.values():
        plan = estimate(hits)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Generate posexplode")]
        assert "Exchange" not in above and "Join" not in above

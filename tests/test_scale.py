"""What must hold for tables larger than a test can have."""

from pyspark.sql import functions as F

from tidegauge.operators import injection


def sent_whole(df):
    """Whether a run of ``df`` broadcast rows that were exploded after their last shuffle."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    depth = None
    for line in final.splitlines():
        at = len(line) - len(line.lstrip(" :+-*("))
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None and "Exchange" in line:
            depth = None
        elif depth is not None and "Generate" in line:
            return True
    return False


def scenario_case(spark):
    rows = spark.range(60).select(
        (F.col("id") % 3).alias("series_id"), F.lit("value").alias("sensor"), F.floor(F.col("id") / 3).alias("t"), (F.col("id") * 1.5).alias("value")
    )
    ends = rows.groupBy("series_id").agg(F.max("t").alias("n"))
    family = F.explode(F.array(F.lit("step"), F.lit("ramp")))
    scen = ends.withColumn("family", family).select(
        "series_id", F.concat_ws("_", "series_id", "family").alias("scenario_id"), "family", F.array(F.lit("value")).alias("sensors"),
        F.lit(4).cast("long").alias("onset"), F.lit(6).cast("long").alias("duration"), F.lit(30.0).alias("amplitude"),
        injection.no_parameters().alias("parameters"),
    )
    return rows, scen


def test_exploded_disturbances_do_not_pass_the_driver(spark):
    rows, scen = scenario_case(spark)
    deltas = injection.scenario_deltas(scen, random=False)
    assert not sent_whole(injection.check_envelope(rows, scen, deltas))
    assert not sent_whole(injection.inject(rows, scen, random=False))
    assert not sent_whole(injection.inject_whole(rows, scen, random=False))


def test_exploded_scenarios_meet_clean_cells_without_the_driver(spark):
    rows, scen = scenario_case(spark)
    bounds = rows.groupBy("sensor").agg(F.lit(10.0).alias("low"), F.lit(50.0).alias("high"))
    out = injection.check_envelope(rows, scen, injection.scenario_deltas(scen, random=False), bounds)
    assert not sent_whole(out)
    want = sum(not 10 <= 1.5 * i <= 50 for i in range(0, 60, 3)) - sum(1.5 * i > 50 for i in range(12, 30, 3))
    got = {r["scenario_id"]: r["violation_count"] for r in out.collect()}
    supported = sum(1.5 * i + 30.0 > 50 or 1.5 * i + 30 < 10 for i in range(12, 30, 3))
    assert got["0_step"] == want - sum(1.5 * i < 10 for i in range(12, 30, 3)) + supported


def test_onsets_are_searched_without_a_group_per_shape(spark):
    rows, scen = scenario_case(spark)
    bounds = rows.groupBy("sensor").agg(F.lit(0.0).alias("low"), F.lit(90.0).alias("high"))
    out = injection.first_valid_onset(rows, scen.drop("onset"), bounds, 0, F.lit(15))
    assert {r["scenario_id"]: r["onset"] for r in out.collect()}["0_step"] == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInPandas" in plan


def joined_whole(rows, scen, seed, random):
    """Whole series by a join with the sparse disturbances."""
    cells = scen.select("series_id", "scenario_id").join(rows, "series_id")
    deltas = injection.scenario_deltas(scen, seed, random).drop("i").withColumn("support", F.lit(True))
    joined = cells.join(deltas, ["series_id", "scenario_id", "sensor", "t"], "left")
    return joined.withColumns({"delta": F.coalesce("delta", F.lit(0.0)), "support": F.coalesce("support", F.lit(False))})


def test_whole_series_compute_their_disturbance_in_the_cells(spark):
    """The exploded cells were sorted and joined with the exploded disturbances, though a series had met its scenarios."""
    rows, scen = scenario_case(spark)
    other = rows.withColumns({"sensor": F.lit("other"), "value": F.col("value") + 1})
    rows = rows.unionByName(other)
    odd = scen.filter("family = 'step'").withColumns({"scenario_id": F.concat("scenario_id", F.lit("_late")), "onset": F.lit(17).cast("long")})
    both = scen.filter("family = 'ramp'").withColumns(
        {"scenario_id": F.concat("scenario_id", F.lit("_both")), "sensors": F.array(F.lit("other"), F.lit("value")), "duration": F.lit(1).cast("long")}
    )
    none = scen.filter("family = 'ramp'").withColumns({"scenario_id": F.concat("scenario_id", F.lit("_none")), "duration": F.lit(0).cast("long")})
    fixed = scen.unionByName(odd).unionByName(both).unionByName(none)
    drawn = scen.withColumns(
        {"family": F.when(F.col("family") == "step", "brownian").otherwise("ou"), "scenario_id": F.concat("scenario_id", F.lit("_random"))}
    )
    columns = ["series_id", "scenario_id", "sensor", "t", "value", "delta", "support"]
    for scenarios, random in ((fixed, False), (fixed.unionByName(drawn), True)):
        out = injection.inject_whole(rows, scenarios, 5, random, keep=["amplitude", "family"])
        assert out.filter("y <> value + delta OR amplitude <> 30 OR family IS NULL").count() == 0
        want = joined_whole(rows, scenarios, 5, random).select(columns).collect()
        assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, want))
    plan = injection.inject_whole(rows, fixed, random=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_the_largest_disturbance_is_known_from_the_scenario(spark):
    rows, scen = scenario_case(spark)
    scen = scen.filter("family = 'ramp'").withColumn("onset", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 12, 16, 19, 25)])))
    scen = scen.withColumn("scenario_id", F.concat_ws("_", "scenario_id", "onset"))
    got = {tuple(r[:2]): r[2] for r in scen.select("series_id", "scenario_id", injection.fixed_peak(F.lit(20))).collect()}
    cells = injection.inject_whole(rows, scen, random=False).filter("support").groupBy("series_id", "scenario_id").agg(F.max(F.abs("delta")))
    want = {tuple(r[:2]): r[2] for r in cells.collect()}
    assert len(got) == 15 and {k: v for k, v in got.items() if v is not None} == want


def test_scenarios_are_spread_before_they_become_cells(spark):
    """Scenarios have few bytes; merged into few tasks, each of these held a share of all cells for its shuffle."""
    rows, scen = scenario_case(spark)
    more = scen.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("scenario_id", F.concat_ws("_", "scenario_id", "k"))
    tasks = injection.scenario_deltas(more, random=False).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in tasks) == 3 * 2 * 50 * 6

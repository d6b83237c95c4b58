"""Small literal cases with known results."""

# The inputs and expected outputs below are the literal cases listed in FIXTURES.md.

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import injection, labelling, metrics, modelling, recovery, scaling, scores
from tidegauge.sources import plant_logs, store


def series(spark, columns, **values):
    names = list(values)
    rows = [("s", i, *v) for i, v in enumerate(zip(*values.values()))]
    return spark.createDataFrame(rows, "series_id string, t long, " + ", ".join(f"{n} {c}" for n, c in zip(names, columns)))


KEY = ["series_id"]


@pytest.mark.parametrize(
    "labels, pred, want",
    [
        ([0, 1, 1, 0, 1, 1, 1, 0], [0, 0, 1, 0, 0, 0, 1, 0], (2, 2, 1.0, 1.5)),
        ([0, 1, 1, 0, 1, 1, 0], [0, 1, 0, 0, 0, 0, 0], (2, 1, 0.5, 0.0)),
        ([0, 0, 0], [0, 1, 0], (0, 0, 0.0, None)),
    ],
)
def test_event_metrics(spark, labels, pred, want):
    r = metrics.event_metrics(series(spark, ["int", "int"], label=labels, pred=pred), KEY).first()
    assert (r["n_events"], r["detected_events"], r["event_recall"], r["median_detection_delay"]) == want


@pytest.mark.parametrize(
    "residual, least, want",
    [
        ([0, 2, 1.2, 1.1, 0], 3, [False, True, True, True, False]),
        ([0, 2, 0, 0], 2, [False] * 4),
        ([1.1, 1.2, 1.3], 3, [False] * 3),
    ],
)
def test_hysteresis(spark, residual, least, want):
    rows = series(spark, ["double"], r=[float(v) for v in residual])
    out = scores.temporal_support(rows, KEY, F.col("r"), F.lit(1.5), F.lit(1.0), least)
    assert [r["support"] for r in out.orderBy("t").collect()] == want


def test_blocked_threshold_and_distribution(spark):
    rows = series(spark, ["double"], score=[0.0, 100.0, 40.0, 40.0])
    assert metrics.blocked_threshold(rows, KEY, 0.75, 2).first()["threshold"] == 75.0
    val = series(spark, ["double"], score=[1.0, 3.0, 5.0])
    test = series(spark, ["double", "int"], score=[2.0, 200.0, 4.0, 400.0], label=[0, 1, 0, 1])
    r = metrics.score_distribution(val, test, KEY).first()
    assert (r["validation_median"], r["test_normal_median"], round(r["test_normal_q99"], 9)) == (3.0, 3.0, 3.98)


def test_score_summary(spark):
    rows = [("s", "val", i, 0, float(i)) for i in range(4)]
    rows += [("s", "test", i, y, v) for i, (y, v) in enumerate(zip([0, 1, 0, 1], [0.0, 3.0, 0.0, 4.0]))]
    df = spark.createDataFrame(rows, "series_id string, split string, t long, label int, score double")
    r = metrics.summarize_scores(df, KEY, 0.75).first()
    assert (r["threshold"], r["point_fpr"], r["point_tpr"], r["event_recall"], r["median_detection_delay"]) == (2.25, 0, 1, 1, 0)


def test_imputation(spark):
    rows = [("s", 0, "train", 1.0, None), ("s", 1, "train", None, None), ("s", 2, "train", 3.0, None),
            ("s", 0, "val", None, 9.0), ("s", 1, "val", 5.0, 9.0), ("s", 0, "test", None, 9.0), ("s", 1, "test", 7.0, 9.0)]
    df = spark.createDataFrame(rows, "series_id string, t long, split string, a double, b double")
    out, keep = scaling.prepare_features(df, df.filter("split = 'train'"), KEY, ["a", "b"])
    assert keep == ["a"] and "b" not in out.columns
    got = {(r["split"], r["t"]): r["a"] for r in out.collect()}
    assert [got[s, t] for s, t in (("train", 0), ("train", 1), ("train", 2), ("val", 0), ("val", 1), ("test", 0), ("test", 1))] == [1, 2, 3, 2, 5, 2, 7]


def test_score_before_reset(spark):
    rows = series(spark, ["double", "double"], z=[2.0, 2.0, 0.0], limit=[3.0] * 3)
    out = scores.cusum_score_reset(rows, KEY, ["z"], "limit", slack=0.0)
    assert [r["cusum"] for r in out.orderBy("t").collect()] == [2, 4, 0]


def test_cusum_detects_a_shift_soon(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.1, 200), np.full(100, 2.0)])
    rows = series(spark, ["double"], y=[float(v) for v in x]).withColumns({"m": F.lit(0.0), "k": F.lit(0.5), "h": F.lit(5.0)})
    first = scores.cusum_reset(rows, KEY, "y", "m", "k", "h").filter("alarm").agg(F.min("t")).first()[0]
    assert 200 <= first < 250


def test_standardized_injection(spark):
    rows = spark.createDataFrame([("s", f"x{j}", t, v) for t in range(6) for j, v in ((0, 10.0), (1, 100.0))], "series_id string, sensor string, t long, value double")
    scen = spark.createDataFrame([("s", "a", "step", ["x1"], 2, 3, 2.0, None)], "series_id string, scenario_id string, family string, sensors array<string>, onset long, duration long, amplitude double, parameters map<string,double>")
    scales = spark.createDataFrame([("s", "x0", 2.0), ("s", "x1", 10.0)], "series_id string, sensor string, scale double")
    out = injection.inject_standardized(rows, scen, scales).orderBy("t").collect()
    assert [(r["sensor"], r["t"], r["delta"], r["y"]) for r in out] == [("x1", t, 20.0, 120.0) for t in (2, 3, 4)]


def test_recovery_and_timing(spark):
    rows = spark.createDataFrame(
        [("e", 10 + i, e, d, d != 0) for i, (e, d) in enumerate([(1.0, 0.0), (4.5, 4.0), (4.5, 4.0), (4.5, 4.0), (0.0, 0.0)])],
        "k string, t long, est double, delta double, support boolean",
    )
    cut = rows.withColumn("est", scores.threshold_delta(F.col("est"), F.lit(2.0), F.lit(1.5)))
    r = metrics.recovery_metrics(cut, ["k"], "est", support="support").first()
    assert (r["support_f1"], r["sign_accuracy_on_support"], r["magnitude_mae_on_support"]) == (1.0, 1.0, 0.5)
    r = metrics.timing_metrics(cut, ["k"], "est", F.lit(11), F.lit(14)).first()
    assert (r["onset_error_samples"], r["duration_error_samples"]) == (0, 0)
    none = metrics.timing_metrics(rows.withColumn("est", F.lit(0.0)), ["k"], "est", F.lit(11), F.lit(14)).first()
    assert none["onset_error_samples"] == none["duration_error_samples"] == math.inf


def test_windows_and_phases(spark):
    cells = [(10 + t, s, abs(v) >= 1) for t, row in enumerate([[0.2, 0.2], [0.2, 0.2], [2, 0.2], [2, 2]]) for s, v in enumerate(row)]
    rows = spark.createDataFrame([("k", *c) for c in cells], "k string, t long, sensor int, active boolean")
    got = [tuple(r)[1:] for r in metrics.window_activation(rows, ["k"], 2, 12).orderBy("window_start").collect()]
    assert got == [("calibration", 10, 12, 0.0, 0.0), ("assessment", 12, 14, 0.75, 1.0)]
    rows = spark.createDataFrame([("k", 10 + i, v >= 1) for i, v in enumerate([0, 0, 3, 3, 0, 0])], "k string, t long, active boolean")
    got = {r["phase"]: r["active_sensor_fraction"] for r in metrics.phase_activation(rows, ["k"], F.lit(12), F.lit(14)).collect()}
    assert got == {"pre_attack": 0.0, "attack": 1.0, "post_attack": 0.0}
    early = metrics.phase_activation(rows, ["k"], F.lit(0), F.lit(14)).filter("phase = 'pre_attack'").first()
    assert early["sample_count"] == 0 and math.isnan(early["active_sensor_fraction"])


def test_downsampling(spark):
    rows = series(spark, ["int"], label=[0, 0, 1, 0, 0, 0, 1, 0, 0, 0])
    kept = {r["t"] for r in scaling.downsample_trace(rows, KEY, 5).collect()}
    assert {0, 2, 6, 9} <= kept and len(kept) <= 5
    for budget in range(1, 10):
        labels = np.array([0, 0, 1, 0, 0, 0, 1, 0, 0, 0])
        want = {0, 9, 2, 6}
        room = max(0, budget - len(want))
        if room:
            normal = np.flatnonzero(labels == 0)
            want |= set(normal[np.linspace(0, len(normal) - 1, room, dtype=int)].tolist())
        got = {r["t"] for r in scaling.downsample_trace(rows, KEY, budget).collect()}
        assert got == want, budget


def test_regime_grid_has_every_scenario_once(spark):
    rng = np.random.default_rng(4)
    rows = series(spark, ["double"], value=[float(v) for v in np.cumsum(rng.normal(0, 1, 480))])
    cut = injection.regime_cutoffs(rows, KEY, "value")
    named = injection.regimes(rows, cut, KEY, "value").select("series_id", "t", "regime")
    size = spark.createDataFrame([("s", 480, 1.0)], "series_id string, n long, train_std double")
    grid = injection.stratified_grid(named, size.select("series_id", "n"), 42, [0.5, 1.0, 2.0], [6, 12, 24, 48], [1, -1], 5, size.select("series_id", "train_std"))
    got = injection.require_full_grid(grid, 120).toPandas()
    assert len(got) == 120 and got["scenario_id"].is_unique
    assert (got["onset"] + got["duration"] <= 480).all()
    assert got.groupby("regime").size().tolist() == [40, 40, 40]
    one = got[(got.amplitude_std == 0.5) & (got.duration == 6) & (got.sign == 1)]
    assert one["onset"].is_unique and len(one) == 5


def test_persistence_history_and_edges(spark):
    clean = spark.createDataFrame([("s", t, float(10 + t)) for t in range(-2, 6)], "series_id string, t long, value double")
    hit = spark.createDataFrame([("s", "a", t, 100.0, 1) for t in range(1, 5)], "series_id string, scenario_id string, t long, y double, onset long")
    out = recovery.persistence_declared(hit, clean, 2).orderBy("t").collect()
    assert [r["x_hat"] for r in out] == [9.0, 10.0, 9.0, 10.0]
    far = recovery.persistence_declared(hit, clean, 24).orderBy("t").collect()
    assert [r["x_hat"] for r in far] == [10.0] * 4


def test_intervals(spark):
    text = [("2015-12-28 10:00:00", "2015-12-28 09:00:00", 1, 1), ("2015-01-02 10:00:00", "2015-01-02 11:00:00", 2, 2), ("1947-10-10 10:00:00", "1947-10-10 11:00:00", 3, 3), (None, "2015-01-02 11:00:00", 4, 4)]
    iv = spark.createDataFrame(text, "s string, e string, attack_id int, list_pos int").select(
        F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"), "attack_id", "list_pos"
    )
    out = labelling.normalize_intervals(iv, F.lit("2015-12-28 00:00:00").cast("timestamp_ntz"), {"1947-10-10": "2016-01-10"})
    got = {r["attack_id"]: (str(r["start"]), str(r["end"])) for r in out.collect()}
    assert got == {
        1: ("2015-12-28 10:00:00", "2015-12-29 09:00:00"), 2: ("2016-01-02 10:00:00", "2016-01-02 11:00:00"),
        3: ("2016-01-10 10:00:00", "2016-01-10 11:00:00"),
    }
    overlap = iv.filter("attack_id = 2").unionByName(iv.filter("attack_id = 2").withColumns({"attack_id": F.lit(9), "list_pos": F.lit(5)}))
    rows = spark.createDataFrame([("2015-01-02 11:00:00",), ("2015-01-02 11:00:01",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("timestamp"))
    got = [(r["label"], r["attack_id"]) for r in labelling.label_by_intervals(rows, overlap).orderBy("timestamp").collect()]
    assert got == [(1, 9), (0, None)]


def test_plant_log_with_banner(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report\nUnit 7\nRow, \\\\HOST\\LOG\\A.Pv ,Time\n1, 2.5 ,x\n2,Bad Input,y\n")
    rows = plant_logs.read_plant_csv(spark, str(tmp_path / "a.csv"), ",", 2, "\\\\HOST\\LOG\\")
    assert rows.columns == ["Row", "A.Pv", "Time"]
    out = plant_logs.coerce_tags(rows, ["A"], ["Row"]).orderBy("Row").collect()
    assert [tuple(r) for r in out] == [("1", 2.5), ("2", None)]
    with pytest.raises(KeyError):
        plant_logs.coerce_tags(rows, ["B"])


def test_store_round_trip_and_audit_failures(spark, tmp_path):
    rows = spark.range(6).select(
        F.lit("hai").alias("dataset"), F.when(F.col("id") < 3, "train").otherwise("test").alias("split"),
        F.timestamp_seconds(F.col("id") * 1 + F.when(F.col("id") >= 3, -1).otherwise(0)).cast("timestamp_ntz").alias("timestamp"),
        F.lit(0).alias("label"), F.when(F.col("id") == 4, 7).alias("attack_id"), F.col("id").cast("double").alias("P1"),
    )
    root = str(tmp_path / "store")
    store.write_store(store.canonical(rows, ["P1"]), root)
    train = store.load_dataset(spark, root, "hai", "train")
    assert train.columns == ["timestamp", "label", "attack_id", "P1"] and train.count() == 3
    with pytest.raises(ValueError):
        store.load_dataset(spark, root, "other", "train")
    with pytest.raises(FileNotFoundError):
        store.load_dataset(spark, root, "hai", "val")
    sums = store.file_checksums(spark, root)
    store.write_meta(spark.read.parquet(root), str(tmp_path / "meta"), "hai", sums)
    meta = store.read_meta(spark, str(tmp_path / "meta"))
    assert meta["sampling_interval_s"] == 1 and meta["sensor_columns"] == ["P1"]
    assert {s["split"]: s["rows"] for s in meta["splits"]} == {"train": 3, "test": 3}
    assert all(len(v) == 64 for v in meta["raw_file_checksums"].values() if v)
    for kind in ("csv", "json", "parquet"):
        store.write_table(train, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    from tidegauge.operators.ordered import with_index

    table = with_index(spark.read.parquet(root), ["split"], "timestamp").drop("dataset")
    got = {r["check"]: r["passed"] for r in store.audit_store(table, "hai", {"rows": {"train": 3, "test": 4}, "cadence": 1}).collect()}
    assert got["cadence"] and got["column types"] and got["strictly increasing timestamps"]
    assert not got["rows"] and not got["label and attack id agree"] and not got["no shared timestamps"]


def test_split_file_prefers_first_wave(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "swat" / "train.parquet"))
    assert store.load_split_file(spark, str(tmp_path), "swat", "train").count() == 2
    spark.range(5).write.parquet(str(tmp_path / "swat" / "train_wave1.parquet"))
    assert store.load_split_file(spark, str(tmp_path), "swat", "train").count() == 5
    with pytest.raises(FileNotFoundError):
        store.load_split_file(spark, str(tmp_path), "swat", "val")


def test_shape_fit_recovers_parameters(spark):
    rng = np.random.default_rng(6)
    x = 1.0 + 2.0 * rng.standard_t(4, 4000)
    rows = spark.createDataFrame(pd.DataFrame({"g": "t", "x": x}))
    fit = modelling.fit_shape(rows, ["g"], "x", "student_t").first()
    assert fit["loc"] == pytest.approx(1.0, abs=0.1) and fit["scale"] == pytest.approx(2.0, rel=0.08)
    assert fit["shape"] == pytest.approx(4.0, rel=0.25)
    best = modelling.rank_models(modelling.fit_all(rows, ["g"], "x"), ["g"]).filter("model_rank = 1").first()
    assert best["family"] == "student_t"


def test_rejections(spark):
    rows = series(spark, ["double"], score=[1.0, 2.0])
    for call in (
        lambda: metrics.blocked_threshold(rows, KEY, 1.0, 1),
        lambda: scores.ewma_score(rows, KEY, ["score"], 0.0),
        lambda: scores.principal_axes(rows, ["score"], 2),
        lambda: scaling.limit_rows(rows, 0),
        lambda: scaling.require_columns(rows, ["nothing"]),
        lambda: scaling.prepare_features(rows.withColumn("e", F.lit(None).cast("double")), rows.withColumn("e", F.lit(None).cast("double")), KEY, ["e"]),
        lambda: labelling.chrono_split(rows, KEY),
        lambda: injection.inject_open(rows.withColumnRenamed("score", "value"), KEY, "sawtooth", F.lit(0)),
        lambda: metrics.rank_runs(spark.createDataFrame([("a", 1), ("a", 2)], "run_name string, position int"), [F.col("position")], ["position"]),
    ):
        with pytest.raises(ValueError):
            call()

"""First feasible onsets against trying every onset."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import injection


@pytest.mark.parametrize("size", [injection.ONSETS, 8])
@pytest.mark.parametrize("step", [1, 3])
def test_every_onset_is_tried(spark, monkeypatch, size, step):
    monkeypatch.setattr(injection, "ONSETS", size)
    rng = random.Random(8)
    n = 90
    x = {(s, c): [rng.gauss(0, 1) + (3 if 20 < t < 60 else 0) for t in range(n)] for s in (1, 2) for c in "ab"}
    clean = spark.createDataFrame([(s, c, t, v) for (s, c), xs in x.items() for t, v in enumerate(xs) if t != 30], "series_id int, sensor string, t long, value double")
    rows = []
    for s in (1, 2):
        for k, (family, duration, amplitude) in enumerate([("step", 5, 1.5), ("ramp", 12, -4.0), ("trapezoid", 9, 2.0), ("periodic", 30, 2.5), ("step", 1, 9.0), ("step", 4, 0.3)]):
            rows.append((s, f"{s}-{k}", family, ["a", "b"] if k % 2 else ["a"], duration, amplitude))
    shapes = spark.createDataFrame(rows, "series_id int, scenario_id string, family string, sensors array<string>, duration int, amplitude double")
    shapes = shapes.withColumn("parameters", injection.no_parameters())
    bounds = spark.createDataFrame([("a", -3.0, 3.5)], "sensor string, low double, high double")
    stop = F.lit(n) - F.col("duration")
    got = injection.first_valid_onset(clean, shapes, bounds, 2, stop, F.lit(step))
    found = {r["scenario_id"]: r["onset"] for r in got.collect()}
    deltas = {}
    for r in injection.scenario_deltas(shapes.withColumn("onset", F.lit(0)), random=False).collect():
        deltas.setdefault(r["scenario_id"], {}).setdefault(r["sensor"], {})[r["i"]] = r["delta"]
    want = {}
    for s, name, _, _, duration, _ in rows:
        def fine(o):
            cells = [(c, x[s, c][o + i] + d) for c, ds in deltas[name].items() for i, d in ds.items() if o + i != 30]
            return cells and all(c != "a" or -3.0 - 1e-9 <= y <= 3.5 + 1e-9 for c, y in cells)

        want[name] = next((o for o in range(2, n - duration, step) if fine(o)), None)
    assert found == want and None in want.values() and len(set(want.values())) > 3


def test_no_shapes(spark):
    clean = spark.createDataFrame([(1, "a", 0, 1.0)], "series_id int, sensor string, t long, value double")
    shapes = spark.createDataFrame([], "series_id int, scenario_id string, family string, sensors array<string>, duration int, amplitude double")
    bounds = spark.createDataFrame([], "sensor string, low double, high double")
    out = injection.first_valid_onset(clean, shapes.withColumn("parameters", injection.no_parameters()), bounds, 0, F.lit(5))
    assert out.count() == 0 and "onset" in out.columns


@pytest.mark.parametrize("n,start,every", [(100, 0, 7), (60, 3, 1), (55, 0, 60), (21, 0, 2), (300, 50, 24)])
def test_a_range_of_onsets_gives_the_listed_grid(spark, n, start, every):
    onsets = range(start, n, every)
    grid = lambda o: injection.scenario_grid(spark, "s", n, ["step", "ramp"], ["a", "b", "c"], [20, 50, 11], o, [1.0, 2.0]).drop("parameters").collect()
    assert grid(onsets) == grid(list(onsets)) and len(grid(onsets)) > 0

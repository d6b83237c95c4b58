"""Interval sweep against all pairs of rows and intervals."""

import random

import numpy as np
import pytest

from tidegauge.operators import intervals, labelling

BASE = 1_700_000_000


def table(spark, rows, keyed=False):
    df = spark.createDataFrame(rows, "k string, list_pos int, s double, e double, attack_id int")
    out = df.selectExpr("k", "list_pos", "timestamp_seconds(s) AS start", "timestamp_seconds(e) AS end", "attack_id")
    return out if keyed else out.drop("k")


def random_intervals(rng, n, span):
    """Short, long, equal, touching and empty ones; some without a border."""
    out = []
    for i in range(n):
        start = rng.randrange(span)
        end = start + rng.choice([0, 1, 3, rng.randrange(span), -2])
        if rng.random() < 0.1:
            start = 5  # many begin together
        out.append((rng.choice("ab"), rng.randrange(n), float(BASE + start), None if rng.random() < 0.03 else float(BASE + end), i))
    return out


def brute(rows, given, keyed):
    out = {}
    for number, key, at in rows:
        hits = [(pos, s, e, i) for k, pos, s, e, i in given if e is not None and s <= at <= e and (k == key or not keyed)]
        out[number] = max(hits)[3] if hits else None
    return out


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("sizes", [{}, {"BORDERS": 7, "ROWS": 40, "BROADCAST_PIECES": 0}, {"RANGE": 2}])
def test_rows_get_the_last_interval_of_the_list(spark, monkeypatch, sizes, keyed):
    for name, value in sizes.items():
        monkeypatch.setattr(intervals, name, value)
    rng = random.Random(7)
    given = random_intervals(rng, 90, 300)
    rows = [(i, rng.choice("abc"), BASE + rng.randrange(-10, 700) / 2) for i in range(600)]
    df = spark.createDataFrame(rows, "number long, k string, at double").selectExpr("number", "k", "timestamp_seconds(at) AS timestamp", "'x' AS cut", "2 AS a")
    got = labelling.label_by_intervals(df, table(spark, given, keyed), key=["k"] if keyed else [])
    assert got.columns == [*df.columns, "label", "attack_id"]
    found = {r["number"]: r["attack_id"] for r in got.collect()}
    assert found == brute(rows, given, keyed) and len(set(found.values())) > 6


def test_null_times_and_no_intervals(spark):
    df = spark.sql("SELECT 1 AS n, CAST(NULL AS timestamp) AS timestamp UNION ALL SELECT 2, timestamp_seconds(1700000000)")
    given = [("a", 1, float(BASE), float(BASE), 9)]
    got = labelling.label_by_intervals(df, table(spark, given)).orderBy("n").collect()
    assert [(r["label"], r["attack_id"]) for r in got] == [(0, None), (1, 9)]
    none = labelling.label_by_intervals(df, table(spark, given).limit(0)).collect()
    assert [(r["label"], r["attack_id"]) for r in none] == [(0, None)] * 2


def test_tree_nodes_make_up_the_range(spark):
    for first, last in ((1, 1), (0, 7), (3, 12), (5, 5), (1, 14), (4, 6)):
        got = spark.range(1).select(intervals._nodes(*(intervals.F.lit(x) for x in (first, last)), 4).alias("n")).first()["n"]
        cuts = [c for n in got for c in range(n["place"] << n["level"], (n["place"] + 1) << n["level"])]
        assert sorted(cuts) == list(range(first, last + 1)), (first, last)


def test_sweep_of_nested_and_touching():
    a, b = np.array([0, 2, 4, 4, 9]), np.array([9, 6, 5, 5, 12])
    assert list(intervals._sweep(a, b, np.array([0, 1, 3, 2, 0]))) == [(0, 2, 0), (2, 4, 1), (4, 5, 3), (5, 6, 1), (6, 12, 0)]

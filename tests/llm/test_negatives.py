"""Hard negatives against all products, and the bounds of the cover tree."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import hard_negatives as mining

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    known = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        known.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2]))

    out = []
    for a in known:
        if a[0] % 100:
            continue
        same = sorted((-score(a, b), b[0]) for b in known if b[1] == a[1] and b != a)[:5]
        other = sorted((-score(a, b), b[0]) for b in known if b[1] != a[1])
        for minus, positive in same:
            fit = [(s, i) for s, i in other if 30 * -minus <= 100 * -s <= 90 * -minus]
            out += [(a[0], positive, rank, i, -minus, -s) for rank, (s, i) in enumerate(fit[:10], 1)]
    return sorted(out)


def rows_of(rng, n, clusters, size=8, spread=0.2):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = rows_of(rng, 900, 12)
    same = rows[100][1]
    rows += [(i, same, 1) for i in range(900, 1_200)]  # one vector of a quarter of all rows
    rows += [(1_300, [0.0] * 8, 2), (1_400, rows[3][1], 77), (500, rows[5][1], 3), rows[200], rows[200]]
    rows += [(None, same, 1), (1_500, None, 1), (1_600, same, None), (1_700, [None] + same[1:], 1)]
    rows += [(1_800, [math.nan] + same[1:], 1), (1_900, [math.inf] + same[1:], 1), (2_000, same[:5], 2), (2_100, [], 2)]
    return rows


def mined(df):
    return sorted(tuple(r) for r in mining.mine(df).collect())


def test_rows_match_all_products(llm, vectors):
    want = brute(vectors)
    assert mined(llm.createDataFrame(vectors, ROWS).repartition(3)) == want and len(want) > 200


@pytest.mark.parametrize("name,value", [("BLOCK", 50), ("GROUP", 2), ("BROADCAST_GROUPS", 0), ("PIVOTS", 1)])
def test_sizes_do_not_change_the_result(llm, vectors, monkeypatch, name, value):
    monkeypatch.setattr(mining, name, value)
    assert mined(llm.createDataFrame(vectors, ROWS)) == brute(vectors)


def test_extra_columns_and_empty_tables(llm, vectors):
    df = llm.createDataFrame(vectors[:300], ROWS)
    more = df.select("*", *(F.lit("mine").alias(c) for c in "id v g pos score block rank aim found s cell kind".split()))
    assert mined(more) == mined(df) == brute(vectors[:300])
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id % 100 <> 0")) == []


def test_huge_components_are_cut(llm):
    rows = [(i, [1e30 if i % 2 else -1e30, float(i)], i % 2) for i in range(0, 301, 3)]
    assert all(abs(r[4]) <= 2**62 and abs(r[5]) <= 2**62 for r in mined(llm.createDataFrame(rows, ROWS)))


def tree_of(rng, n, clusters, spread):
    points = np.array([[math.floor(256 * x) for x in r[1]] for r in rows_of(rng, n, clusters, 16, spread)])
    norm = math.sqrt((points**2).sum(1).max())
    labels = np.array([rng.randrange(3) for _ in range(n)])
    return mining.build_tree(points, np.arange(n), labels, norm), norm


def test_nodes_cover_their_points():
    tree, norm = tree_of(random.Random(1), 3_000, 20, 0.1)
    lifted = np.column_stack([tree.points, np.sqrt(np.maximum(0, norm**2 - (tree.points.astype(float) ** 2).sum(1)))])

    def points_of(node):
        if not tree.child[node]:
            return np.arange(tree.low[node], tree.high[node])
        own = range(tree.child[node], tree.child[node] + tree.children[node])
        return np.concatenate([points_of(c) for c in own])

    assert sorted(points_of(0)) == list(range(3_000))
    for node in range(len(tree.low)):
        own = points_of(node)
        cosine = lifted[own] @ lifted[tree.centre[node]] / norm**2
        assert np.arccos(np.clip(cosine, -1, 1)).max() <= tree.angle[node] + 1e-6
        assert {tree.first_label[node], tree.last_label[node]} == {tree.labels[own].min(), tree.labels[own].max()}


@pytest.mark.parametrize("same", [True, False])
def test_search_is_exact_and_skips(same):
    tree, norm = tree_of(random.Random(2), 6_000, 60, 0.03)
    search = mining.Search(tree, norm)
    asked = 0
    for k in range(0, 6_000, 301):
        anchor = tree.points[k]
        search.ask(anchor)
        scores = tree.points @ anchor
        top = int(scores.max())
        windows = [(-math.inf, math.inf), (top * 3 // 10, top * 9 // 10), (top, 0), (top // 3, top // 2)]
        for some in ([w] for w in windows), [windows[1:]]:
            for ask in some:
                for (low, high), found in zip(ask, search.best(10, int(tree.labels[k]), same, ask)):
                    fit = ((tree.labels == tree.labels[k]) == same) & (scores >= low) & (scores <= high)
                    want = sorted(zip((-scores[fit]).tolist(), tree.ids[fit].tolist()))[:10]
                    assert found == [(-s, i) for s, i in want]
                asked += 6_000
    assert search.verified < 0.6 * asked

"""Solvers, regressions and the baseline run against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import injection, linear, modelling, recovery, scores, solver
from tidegauge.operators.baseline_run import run_baselines

KEY = ["series_id"]


def problem(spark, r, low=None, high=None, key="p"):
    n = len(r)
    low = [-np.inf] * n if low is None else low
    high = [np.inf] * n if high is None else high
    rows = [(key, t, float(a), float(b), float(c)) for t, (a, b, c) in enumerate(zip(r, low, high))]
    return spark.createDataFrame(rows, "k string, t long, r double, low double, high double")


def loss(r, d, terms, weight=1.0):
    return float(solver.objective(np.array([r]), np.array([d]), weight, terms)[0])


@pytest.mark.parametrize("terms", [solver.step_terms(1.0, 0.05), solver.trend_terms(0.05, 0.5, 1.0)])
def test_solution_is_a_minimum_in_the_box(spark, terms):
    rng = np.random.default_rng(8)
    r = rng.normal(0, 0.3, 40)
    r[12:26] += 3.0
    high = np.full(40, 2.5)
    low = np.full(40, -2.5)
    low[:5] = high[:5] = 0.0
    out = solver.recover_whole(problem(spark, r, low, high), ["k"], terms, watch_box=True, least_iter=7).orderBy("t").toPandas()
    d = out["delta_hat"].to_numpy()
    assert (d >= low).all() and (d <= high).all() and (d[:5] == 0).all()
    best = loss(r, d, terms)
    assert out["loss"].iloc[0] == pytest.approx(best)
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            other = np.clip(d + rng.normal(0, scale, 40) * (rng.random(40) < rng.random()), low, high)
            assert loss(r, other, terms) >= best - 1e-4
    flat = d.copy()
    flat[12:26] = d[12:26].mean()
    assert loss(r, flat, terms) >= best - 1e-4


def test_unpenalised_solution_is_the_clipped_residual(spark):
    r = [0.5, -3.0, 2.0, 1.0]
    out = solver.recover_whole(problem(spark, r, [-1] * 4, [1] * 4), ["k"], solver.step_terms(0.0, 0.0)).orderBy("t")
    assert np.allclose([x["delta_hat"] for x in out.collect()], [0.5, -1, 1, 1], atol=1e-4)


def test_equal_problems_do_not_depend_on_their_batch(spark):
    rng = np.random.default_rng(9)
    series = {f"p{i}": rng.normal(0, 1, n) for i, n in enumerate([30, 30, 30, 17, 1])}
    rows = None
    for k, r in series.items():
        part = problem(spark, r, key=k)
        rows = part if rows is None else rows.unionByName(part)
    together = solver.recover_whole(rows, ["k"], solver.step_terms(1.0, 0.05)).toPandas()
    for k, r in series.items():
        alone = solver.recover_whole(problem(spark, r, key=k), ["k"], solver.step_terms(1.0, 0.05)).toPandas()
        mine = together[together.k == k].sort_values("t")
        assert np.allclose(mine["delta_hat"], alone.sort_values("t")["delta_hat"], atol=1e-12)
        assert (mine["iterations"].to_numpy() == alone["iterations"].to_numpy()).all()


def test_rolling_recovery_never_looks_ahead(spark):
    rng = np.random.default_rng(10)
    r = rng.normal(0, 0.2, 50)
    r[20:] += 2.0
    changed = r.copy()
    changed[35:] = 99.0
    terms = solver.step_terms(1.0, 0.05)
    a, b = (solver.recover_rolling(problem(spark, x), ["k"], terms, 12).orderBy("t").toPandas() for x in (r, changed))
    assert np.array_equal(a["delta_hat"][:35], b["delta_hat"][:35])
    assert a["delta_hat"][32] > 1.0 and abs(a["delta_hat"][:18]).max() < 0.5
    window = problem(spark, r[5:17])
    whole = solver.recover_whole(window, ["k"], terms, max_iter=300, tol=1e-5).orderBy("t").toPandas()
    assert a["delta_hat"][16] == pytest.approx(whole["delta_hat"].iloc[-1], abs=1e-12)


@pytest.mark.parametrize("terms", [solver.step_terms(1.0, 0.05), solver.trend_terms(0.05, 0.5, 1.0), solver.trend_terms(0.1, 0.0, 2.0)])
def test_band_solves_the_system(terms):
    rng = np.random.default_rng(4)
    for n in (3, 4, 5, 60):
        right = rng.normal(size=(6, n))
        assert np.allclose(solver.Band(n, 0.7, terms)(right), solver._dense(n, 0.7, terms)(right), atol=1e-11)


def test_long_offline_problem(spark, monkeypatch):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.1, 300) + np.where(np.arange(300) > 150, 2.0, 0.0)
    run = lambda x, **o: solver.recover_whole(problem(spark, x), ["k"], solver.step_terms(1.0, 0.05), **o).orderBy("t").toPandas()
    want = run(r)
    monkeypatch.setattr(solver, "DENSE_ROWS", 10)
    assert np.allclose(run(r)["delta_hat"], want["delta_hat"], atol=1e-9)
    long = np.where(np.arange(20_000) > 9_000, 2.0, 0.0)
    got = run(long, max_iter=12)
    assert len(got) == 20_000 and abs(got["delta_hat"].iloc[15_000] - 2.0) < 0.2


SOLVER_TERMS = [solver.step_terms(1.0, 0.05), solver.trend_terms(0.05, 0.5, 1.0), solver.trend_terms(0.1, 0.0, 2.0)]


def boxed(rng, n):
    """Residuals with jumps, a box with a closed part, and infinite ends."""
    r = rng.normal(0, 0.3, n) + 2.0 * (np.arange(n) % 300 > 190)
    low, high = np.full(n, -1.5), np.full(n, 2.2)
    low[: n // 9] = high[: n // 9] = 0.0
    high[n // 2 :] = np.inf
    return r, low, high


@pytest.mark.parametrize("terms", SOLVER_TERMS)
def test_gap_bounds_the_distance_to_the_minimum(spark, terms):
    rng = np.random.default_rng(20)
    r, low, high = boxed(rng, 70)
    rows = problem(spark, r, low, high)
    best = solver.recover_whole(rows, ["k"], terms, max_iter=40_000, tol=1e-12).orderBy("t").toPandas()
    assert best["gap"].iloc[0] < 1e-8
    for rounds in (3, 10, 40):
        rough = solver.recover_whole(rows, ["k"], terms, max_iter=rounds).orderBy("t").toPandas()
        gap, far = rough["gap"].iloc[0], rough["loss"].iloc[0] - best["loss"].iloc[0]
        assert far - 1e-9 <= gap
        assert np.abs(rough["delta_hat"] - best["delta_hat"]).max() <= np.sqrt(2 * gap) + 1e-6
    # A wrong point of the box is told by its gap.
    d, u = np.clip(r, low, high)[None], [np.zeros((1, 70 - order)) for order, *_ in terms]
    assert solver.duality_gap(r[None], d, low[None], high[None], 1.0, terms, u)[0] >= loss(r, d[0], terms) - best["loss"].iloc[0]


@pytest.mark.parametrize("terms", SOLVER_TERMS)
def test_blocks_equal_the_whole_series(spark, terms):
    rng = np.random.default_rng(21)
    rows = None
    for k, n in (("a", 900), ("b", 257), ("c", 1), ("d", 2)):
        part = problem(spark, *boxed(rng, n), key=k)
        rows = part if rows is None else rows.unionByName(part)
    want = solver.recover_whole(rows.filter("k <> 'c'"), ["k"], terms, max_iter=30_000, tol=1e-10)
    got = solver.recover_long(rows, ["k"], terms, block=64, gap=1e-8, tol=1e-10, max_iter=20_000)
    both = want.join(got.select("k", "t", F.col("delta_hat").alias("d"), F.col("loss").alias("l"), F.col("gap").alias("g"), "rounds"), ["k", "t"]).toPandas()
    assert len(both) == 1_159 and got.count() == 1_160
    assert (both["g"] <= 1e-8 * (1 + both["l"])).all() and 1 < both["rounds"].max() < 40
    assert np.abs(both["delta_hat"] - both["d"]).max() < 2e-4 and np.abs(both["loss"] - both["l"]).max() < 1e-5


def test_warm_windows_equal_cold_ones(spark):
    rng = np.random.default_rng(22)
    rows = problem(spark, *boxed(rng, 400))
    for terms in SOLVER_TERMS:
        options = {"window": 24, "tol": 1e-8, "max_iter": 5_000}
        cold = solver.recover_rolling(rows, ["k"], terms, **options).orderBy("t").toPandas()
        warm = solver.recover_rolling(rows, ["k"], terms, **options, warm=True).orderBy("t").toPandas()
        # Each is as near to the exact solution as its duality gap proves.
        apart, proven = np.abs(cold["delta_hat"] - warm["delta_hat"]), np.sqrt(2 * cold["gap"]) + np.sqrt(2 * warm["gap"])
        assert (apart <= proven + 1e-9).all() and apart.median() < 1e-6
        assert warm["iterations"].sum() < cold["iterations"].sum()


@pytest.mark.parametrize("standardize", [True, False])
def test_ridge(spark, standardize):
    rng = np.random.default_rng(11)
    x = rng.normal(3, [1, 5, 0.2], (400, 3))
    x = np.column_stack([x, np.full(400, 2.0)])
    y = x @ [1.0, -0.5, 2.0, 0.0] + 4 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "const", "y"]))
    model = linear.ridge_fit(df, "y", ["a", "b", "c", "const"], 1.0, standardize)
    s = x.std(axis=0) if standardize else np.ones(4)
    s[s == 0] = 1.0
    z = (x - x.mean(axis=0)) / s
    w = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean())) / s
    assert np.allclose(model["weights"], w, atol=1e-8)
    fit = x @ w + y.mean() - x.mean(axis=0) @ w
    assert model["residual_variance"] == pytest.approx(np.var(y - fit), rel=1e-6)
    assert model["r2"] == pytest.approx(1 - np.var(y - fit) / np.var(y), rel=1e-9)
    with pytest.raises(ValueError):
        linear.ridge_fit(df, "y", ["y"])


def numpy_scores(train, rows, reset, k):
    mean, scale = train.mean(axis=0), train.std(axis=0)
    tz, z = (train - mean) / scale, (rows - mean) / scale
    _, _, axes = np.linalg.svd(tz, full_matrices=False)
    spe = ((z - z @ axes[:k].T @ axes[:k]) ** 2).sum(axis=1)
    up, down, level = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    cusum, ewma = [], []
    for v in z:
        up, down = np.maximum(0, up + v - 0.5), np.maximum(0, down - v - 0.5)
        cusum.append(max(up.max(), down.max()))
        if reset is not None and cusum[-1] > reset:
            up, down = np.zeros_like(up), np.zeros_like(down)
        level = 0.2 * v + 0.8 * level
        ewma.append(np.abs(level).max())
    return {"cusum": np.array(cusum), "ewma": np.array(ewma), "pca_spe": spe}


def limit(x, q, blocks):
    return max(np.quantile(b, q) for b in np.array_split(x, blocks))


def test_baseline_run(spark):
    rng = np.random.default_rng(12)
    latent = rng.normal(0, 1, 300)
    x = latent[:, None] * [1, 0.7, -0.4] + rng.normal(0, 0.08, (300, 3))
    x[250:262, 0] += 8.0
    label = np.zeros(300, dtype=int)
    label[250:262] = 1
    label[[20, 140]] = 1
    x[7, 1] = np.nan
    split = np.array(["train"] * 120 + ["val"] * 60 + ["test"] * 120)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(series_id="s", t=np.arange(300), label=label, split=split)
    df = spark.createDataFrame(pdf.replace({np.nan: None}).astype({"b": object}), "a double, b double, c double, series_id string, t long, label int, split string")
    long, summary = run_baselines(df, KEY, ["a", "b", "c"], quantile=0.95, blocks=3, components=2)

    train = x[(split == "train") & (label == 0)]
    val, test = x[(split == "val") & (label == 0)], x[split == "test"]
    fill = np.nanmedian(train, axis=0)
    train, val, test = (np.where(np.isnan(p), fill, p) for p in (train, val, test))

    def diff(part, before):
        return np.diff(part, axis=0, prepend=before[None])

    want = {}
    for prefix, (a, b, c) in {
        "": (train, val, test),
        "residual_": (diff(train, train[0]), diff(val, train[-1]), diff(test, val[-1])),
    }.items():
        on_val = numpy_scores(a, b, None, 2)
        on_test = numpy_scores(a, c, limit(on_val["cusum"], 0.95, 3), 2)
        for name in on_val:
            want[prefix + name] = (on_val[name], on_test[name])
    got = long.toPandas()
    flat = summary.toPandas().set_index("baseline")
    truth = label[split == "test"]
    for name, (on_val, on_test) in want.items():
        mine = got[got.baseline == name].sort_values(["split", "t"])
        assert np.allclose(mine[mine.split == "val"]["score"], on_val, atol=1e-7), name
        assert np.allclose(mine[mine.split == "test"]["score"], on_test, atol=1e-7), name
        threshold = limit(on_val, 0.95, 3)
        hit = on_test > threshold
        assert flat.loc[name, "threshold"] == pytest.approx(threshold, abs=1e-7)
        assert flat.loc[name, "point_fpr"] == pytest.approx(hit[truth == 0].mean())
        assert flat.loc[name, "point_tpr"] == pytest.approx(hit[truth == 1].mean())
        assert flat.loc[name, "n_events"] == 1


def test_scores_rise_on_an_injected_shift(spark):
    rng = np.random.default_rng(13)
    latent = rng.normal(0, 1, 240)
    x = latent[:, None] * [1, 0.7, -0.4] + rng.normal(0, 0.08, (240, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(series_id="s", t=np.arange(240))
    clean = spark.createDataFrame(pdf)
    hit = clean.withColumn("a", F.col("a") + F.when(F.col("t") >= 40, 8.0).otherwise(0.0))
    a, b = (scores.baseline_scores(clean, rows, KEY, ["a", "b", "c"]).orderBy("t").toPandas() for rows in (clean, hit))
    for name in ("cusum", "ewma", "pca_spe"):
        assert b[name][40:].max() > 5 * a[name][40:].max()


def test_candidate_norms_agree_with_all_pairs(spark):
    rng = np.random.default_rng(14)
    delta = rng.normal(0, 1, (4, 50))
    y = rng.normal(0, 1, 50)
    rows = [("c", i, t, float(y[t]), float(y[t] - delta[i, t]), float(delta[i, t]), True) for i in range(4) for t in range(50)]
    df = spark.createDataFrame(rows, "case_id string, candidate int, t long, y double, clean double, delta double, support boolean")
    pairs = [np.abs(delta[i] - delta[j]) for i in range(4) for j in range(i)]
    linf = recovery.candidate_separation(df, tau=1.0).first()
    assert linf["max_separation"] == pytest.approx(max(p.max() for p in pairs)) and linf["ambiguous"]
    l1 = recovery.candidate_separation(df, tau=1e6, norm="l1", exhaustive=True).first()
    assert l1["max_separation"] == pytest.approx(max(p.sum() for p in pairs))
    assert l1["ambiguous"] is False and l1["certified"]
    open_case = recovery.candidate_separation(df, tau=1e6).first()
    assert open_case["ambiguous"] is None and not open_case["certified"]


def test_axes_belong_to_their_key(spark):
    rng = np.random.default_rng(3)
    blocks = {"a": rng.normal(size=(60, 3)) @ np.diag([5.0, 1.0, 0.2]), "b": rng.normal(size=(50, 3)) @ np.diag([0.1, 1.0, 7.0])}
    rows = [(k, i, *map(float, x)) for k, block in blocks.items() for i, x in enumerate(block)]
    df = spark.createDataFrame(rows, "series_id string, t long, x double, y double, z double").repartition(3)
    cols = ["x", "y", "z"]
    axes = scores.keyed_axes(df, ["series_id"], cols, 2)
    got = {(r["series_id"], r["t"]): r["pca_spe"] for r in scores.keyed_spe_score(df, ["series_id"], cols, axes).collect()}
    for k, block in blocks.items():
        _, _, v = np.linalg.svd(block, full_matrices=False)
        want = (block**2).sum(axis=1) - ((block @ v[:2].T) ** 2).sum(axis=1)
        assert np.allclose([got[k, i] for i in range(len(block))], want, atol=1e-9)


def test_reset_scan_against_a_loop():
    rng = np.random.default_rng(8)
    for level in (-0.4, 0.1, 2.0):
        drift = rng.normal(level, 1.0, size=(9000, 2))
        limit = rng.uniform(3, 6, size=9000)
        before, largest, end = scores.reset_scan(drift, limit, np.array([1.0, 0.0]))
        s = np.array([1.0, 0.0])
        for i, x in enumerate(drift):
            s = np.maximum(0.0, s + x)
            assert np.allclose(before[i], s, atol=1e-9) and abs(largest[i] - s.max()) < 1e-9
            if s.max() > limit[i]:
                s = np.zeros(2)
        assert np.allclose(end, s, atol=1e-9)


def test_many_reversion_rates_give_the_same_walk(spark, monkeypatch):
    rows = [("s", f"c{i}", "ou", ["v"], 3, 40 + i, 5.0, {"theta": 0.05 * (i + 1)}) for i in range(4)]
    df = spark.createDataFrame(
        rows,
        "series_id string, scenario_id string, family string, sensors array<string>, onset long, duration long, amplitude double, parameters map<string,double>",
    )
    run = lambda: {(r["scenario_id"], r["i"]): r["delta"] for r in injection.scenario_deltas(df, 7).collect()}
    want = run()
    monkeypatch.setattr(injection, "MAX_THETAS", 1)
    got = run()
    assert want.keys() == got.keys() and len(want) > 150 and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_shape_search_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g in "abc" for x in rng.standard_t(4, size=300)]
    df = spark.createDataFrame(rows, "g string, x double")
    run = lambda: {r["g"]: (r["loc"], r["scale"], r["shape"], r["converged"]) for r in modelling.fit_shape(df, ["g"], "x", "student_t").collect()}
    want = run()
    monkeypatch.setattr(modelling, "MAX_GROUPS", 1)
    assert all(np.allclose(run()[g][:3], want[g][:3]) and want[g][3] for g in "abc")


@pytest.mark.parametrize("sources", [1, 5])
def test_farthest_pair_without_all_pairs(spark, monkeypatch, sources):
    rng = np.random.default_rng(30)
    rows = []
    for case, n in (("a", 40), ("b", 7), ("c", 1)):
        centre = rng.normal(size=25)
        for k in range(n):
            for t, d in enumerate(centre + rng.normal(size=25) * rng.uniform(0.1, 2)):
                rows.append((case, f"k{k}", t, 0.0, 0.0, float(d), True))
    df = spark.createDataFrame(rows, "case_id string, candidate string, t long, y double, clean double, delta double, support boolean")
    want = {r["case_id"]: r["max_separation"] for r in recovery.candidate_separation(df, 1.0, "l1").collect()}
    monkeypatch.setattr(recovery, "MAX_CANDIDATES", 10)
    monkeypatch.setattr(recovery, "SOURCES", sources)
    got = {r["case_id"]: r["max_separation"] for r in recovery.candidate_separation(df, 1.0, "l1").collect()}
    assert got == pytest.approx(want) and got["c"] == 0.0 < got["b"]

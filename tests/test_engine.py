"""Ranks, frames, the break likelihood, and learned parts of the engine against numpy."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakwater.operators import frames, gram, learning, likelihood, neighbours, ranking
from breakwater.plans import catalog, engine

from . import numpy_series as arrays
from .conftest import SF


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 400), ("b", 37), ("c", 1)):
        x = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n).round(1))  # one value holds two fifths of the rows
        rows += [(i, key, None if i % 11 == 5 else float(v), int(rng.random() < 0.3), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    return rows


def test_ranks_and_areas(spark, values):
    df = spark.createDataFrame(values, "id long, k string, v double, y int, fold int").repartition(5)
    got = {(r.k, r.id): r.r for r in ranking.ranked(df, ["k"], "v").collect()}
    held = {(r.k, r.id): r.r for r in ranking.held_out(df, ["k"], "v", "fold", 3).collect()}
    auc = {r.k: r.auc for r in ranking.area(df, ["k"], "v").collect()}
    middle = {r.k: (r.q1, r.q2) for r in ranking.quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    assert len(got) == len(values)
    for key in "abc":
        own = [r for r in values if r[1] == key]
        x = np.array([r[2] for r in own if r[2] is not None])
        for i, _, v, _, fold in own:
            assert got[(key, i)] == pytest.approx(0.5 if v is None else ((x < v).sum() + ((x == v).sum() + 1) / 2) / len(x))
            rest = np.array([r[2] for r in own if r[2] is not None and r[4] != fold])
            assert held[(key, i)] == pytest.approx(0.5 if v is None or not len(rest) else (rest <= v).sum() / len(rest))
        if len(x):
            p, n = (np.array([r[2] for r in own if r[2] is not None and r[3] == y]) for y in (1, 0))
            want = ((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n)) if len(p) and len(n) else 0.5
            assert auc[key] == pytest.approx(want) and middle[key] == pytest.approx(tuple(np.quantile(x, [0.25, 0.5])))
    assert ranking.ranked(df.limit(0), ["k"], "v").count() == 0


def test_numbers_in_digest_order(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("y"), F.md5(F.col("id").cast("string")).alias("d"))
    got = ranking.numbered(df, ["y"], "d", ["id"]).collect()
    for y in (0, 1):
        rows = sorted((r for r in got if r.y == y), key=lambda r: r.d)
        assert [r.at for r in rows] == list(range(250)) and {r.at_of for r in rows} == {250}


def test_no_window_is_keyed_by_a_feature_alone(spark, values):
    df = spark.createDataFrame(values, "id long, k string, v double, y int, fold int")
    for made in (ranking.ranked(df, ["k"], "v"), ranking.area(df, ["k"], "v"), ranking.held_out(df, ["k"], "v", "fold", 3)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_range" in line or "_all_" in line  # rows of a range, or the few rows of the ranges' sums


@pytest.mark.parametrize("name", ["corr_filter", "cv_auc_rank_mean", "evaluation_summary", "stability_rank", "score_auc", "weight_grid", "binned_mi", "knn_mi", "rank_normalizer", "feature_auc", "baseline_score"])
def test_plans_stay_small(spark, name):
    """Sweeps and shared steps are written, so the last plan of a query reads few tables however many steps led to it."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Relation [") <= 14 and plan.count("Window [") <= 12, (plan.count("Relation ["), plan.count("Window ["))
    assert made.count("FileScan") <= 14


def test_frames(spark):
    rows = [(1, 1.0, 5.0, float("nan"), 2.0), (2, 2.0, 5.0, float("inf"), 4.0), (3, None, 5.0, 3.0, 6.1)]
    wide = spark.createDataFrame(rows, "id long, a double, same double, odd double, twin double")
    clean = frames.finite(wide)
    assert [r.odd for r in clean.orderBy("id").collect()] == [None, 0.0, 3.0]
    assert frames.constant(clean) == ["same"] and frames.medians(clean)["odd"] == 0.0
    again = frames.aligned(clean, ["twin", "new", "a"])
    assert again.columns == ["id", "twin", "new", "a"] and again.where("new is null").count() == 3
    assert frames.reindexed(clean, spark.range(5).toDF("id")).count() == 5
    assert frames.correlated(clean, ["a", "twin", "odd"], 0.98) == ["a", "odd"] or frames.correlated(clean, ["a", "twin", "odd"], 0.98) == ["a"]
    with pytest.raises(ValueError, match="missing feature columns: \\['x'\\]"):
        frames.check(clean, ["a", "x"])


@pytest.mark.parametrize("mode", likelihood.MODES)
def test_break_likelihood(spark, tmp_path, mode):
    assert len(likelihood.WEIGHTS) == 49
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    rows = [(i, float(a), None if i == 3 else float(b), 1.0) for i, (a, b) in enumerate(x)]
    wide = spark.createDataFrame(rows, "id long, delta_rmse double, energy_w50 double, other double")
    train, test = wide.where("id < 40"), wide.where("id >= 40 or id = 3")
    made = likelihood.BreakLikelihood(mode).fit(train)
    made.save(spark, str(tmp_path / mode))
    got = {r.id: r.break_likelihood for r in likelihood.BreakLikelihood.load(spark, str(tmp_path / mode)).transform(test).collect()}
    t = [np.array([r[1] for r in rows[:40]]), np.array([r[2] for r in rows[:40] if r[2] is not None])]
    for i in got:
        s = 0.0
        for w, c, v in ((2.0, t[0], rows[i][1]), (1.3, t[1], rows[i][2])):
            q = np.quantile(c, [0.25, 0.5, 0.75])
            s += w * ((0.5 if v is None else (c <= v).mean()) if mode == "rank_mean" else (0.0 if v is None else (v - q[1]) / (q[2] - q[0])))
        want = s / 3.3
        assert got[i] == pytest.approx(want if mode == "rank_mean" else 1 / (1 + np.exp(-want)))
    with pytest.raises(ValueError):
        likelihood.BreakLikelihood(mode).fit(wide.select("id", "other"))


def breaks(spark, n=24, points=30):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        x = np.concatenate([rng.normal(0, 1, points), rng.normal(2.5 * (k % 2), 1 + k % 2, points)])
        rows += [(k, s, int(s >= points), float(v)) for s, v in enumerate(x)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)], "id long, y int")
    return spark.createDataFrame(rows, "id long, seq long, period int, value double"), labels


def test_bundle_survives_saving(spark, tmp_path):
    table, labels = breaks(spark)
    bundle = engine.train(table, labels, ("quantile_deltas",))
    bundle.save(str(tmp_path / "b"))
    again = engine.Bundle.load(spark, str(tmp_path / "b"))
    a, b = ({r.id: r.score for r in engine.infer(table, m).collect()} for m in (bundle, again))
    assert a == b and min(a[k] for k in range(1, 24, 2)) > max(a[k] for k in range(0, 24, 2))
    assert again.columns == bundle.columns and again.medians == bundle.medians
    with pytest.raises(ValueError, match="missing feature columns"):
        engine.train(table, labels, ("quantile_deltas",), columns=["nothing"])


def test_learned_aggregation_scores_every_row_once(spark):
    table, labels = breaks(spark)
    wide = engine.features(table, ("quantile_deltas",))
    got = learning.learned_aggregation(wide, labels, top=6).collect()
    assert sorted(r.id for r in got) == list(range(24)) and all(0 <= r.meta_agg_score <= 1 for r in got)
    assert np.mean([r.meta_agg_score for r in got if r.y == 1]) > np.mean([r.meta_agg_score for r in got if r.y == 0]) + 0.3


def test_selection(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    good = y + rng.normal(0, 0.3, 200)
    rows = [(i, float(good[i]), float(2 * good[i] + 1), float(rng.normal()), float(rng.normal())) for i in range(200)]
    wide = spark.createDataFrame(rows, "id long, good double, copy double, noise double, other double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, y int")
    assert learning.stability_selection(wide, labels)[0] in ("good", "copy")
    assert len({"good", "copy"} & set(learning.stability_selection(wide, labels))) == 1
    grown, kept = learning.interaction_selection(wide, labels, top=3, keep=4)
    assert grown.columns == ["id", *kept] and 1 <= len(kept) <= 4 and grown.count() == 200
    values = grown.toPandas()[kept].to_numpy()
    assert np.abs(np.corrcoef(values.T) - np.eye(len(kept))).max() <= 0.95 + 1e-9


def test_thousands_of_combinations_in_one_plan(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20, 40))
    x[3, 5], x[4, 6] = np.nan, 0.0
    wide = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{k} double" for k in range(40)))
    made = frames.combinations([f"c{k}" for k in range(40)])
    start = time.perf_counter()
    block = frames.combined(wide, made)
    block._jdf.queryExecution().executedPlan()
    assert len(made) == 5000 and time.perf_counter() - start < 10
    how = {"mul": lambda a, b: a * b, "sqmul": lambda a, b: a * a * b, "div": lambda a, b: a / (b + 1e-8), "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "ratio": lambda a, b: a / (abs(a) + abs(b) + 1e-8), "harmonic": lambda a, b: 2 * a * b / (a + b + 1e-8)}
    for r in block.collect():
        for (k, a, b), v in zip(made, r.block):
            u, w = x[r.id, int(a[1:])], x[r.id, int(b[1:])]
            assert v is None if np.isnan(u + w) else v == pytest.approx(how[k](u, w))
    assert frames.combined(wide, []).first().block == []


def test_correlations_of_all_pairs_in_one_scan(spark, monkeypatch):
    """Equal to Spark's own, pair by pair, with nulls, constants, large means and several tasks and blocks."""
    monkeypatch.setattr(gram, "BLOCK", 3)
    monkeypatch.setattr(gram, "ROWS", 7)
    monkeypatch.setattr(gram, "TASKS", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 8)) @ rng.normal(size=(8, 8)) + np.array([0, 1e6, 0, -1e5, 0, 0, 0, 0])
    x[:, 6] = 2.5
    names = [f"f{k}" for k in range(8)]
    rows = [(i, *[None if rng.random() < 0.2 or k == 7 and i > 1 else float(v) for k, v in enumerate(r)]) for i, r in enumerate(x)]
    wide = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.a, r.b): r for r in gram.correlations(wide, names).collect()}
    assert len(got) == 28
    for (a, b), r in got.items():
        both = [(p[1 + names.index(a)], p[1 + names.index(b)]) for p in rows if p[1 + names.index(a)] is not None and p[1 + names.index(b)] is not None]
        assert r.n == len(both)
        u, v = (np.array(c) for c in zip(*both)) if both else (np.array([0.0]), np.array([0.0]))
        if len(both) > 1 and u.std() > 0 and v.std() > 0:
            assert r.r == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)
        else:
            assert r.r is None
    plan = gram.correlations(wide, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Repartition") == 1
    assert gram.correlations(wide, names[:1]).count() == 0 and gram.correlations(wide.limit(0), names).count() == 0


def test_information_by_nearest_neighbours(spark, monkeypatch):
    """Equal to a comparison of all pairs: ties, a common value, small classes, three labels, several ranges."""
    monkeypatch.setattr(ranking, "CUTS", 5)
    rng = np.random.default_rng(9)
    columns = {"normal": rng.normal(size=120), "tied": rng.integers(0, 6, 120) / 4, "mixed": np.where(rng.random(120) < 0.4, 1.5, rng.normal(size=120)), "same": np.ones(120)}
    y = rng.integers(0, 3, 120)
    y[:3], y[3] = 7, 9  # a class of three rows and one of a single row
    columns["label"] = y + rng.normal(0, 0.1, 120)
    rows = [(f, float(v), int(c)) for f, x in columns.items() for v, c in zip(x, y)] + [("normal", None, 1), ("normal", float("nan"), 1), ("tied", 1.0, None), ("empty", None, 1), ("lone", 1.0, 1)]
    got = {r.feature: r.mi for r in neighbours.knn_information(spark.createDataFrame(rows, "feature string, value double, y int").repartition(4)).collect()}
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    for f, x in columns.items():
        size = {c: (y == c).sum() for c in set(y)}
        keep = np.array([size[c] > 1 for c in y])
        total = psi(keep.sum())
        for i in np.flatnonzero(keep):
            own = np.sort(np.abs(x[(y == y[i]) & (np.arange(120) != i)] - x[i]))
            k = min(3, len(own))
            near = np.abs(x[keep] - x[i])
            m = (near < own[k - 1]).sum() if own[k - 1] > 0 else (near == 0).sum()
            total += (psi(k) - psi(size[y[i]]) - psi(m)) / keep.sum()
        assert got[f] == pytest.approx(max(total, 0), abs=1e-6), f
    assert got["label"] > 0.8 > got["normal"] and got["lone"] == 0.0 and "empty" not in got


def test_block_of_67(spark):
    rng = np.random.default_rng(1)
    x0, x1 = rng.normal(size=150), rng.normal(1, 2, size=160)
    block = arrays.ar_kalman_block(x0, x1)
    assert len(block) == 67 and all(np.isfinite(v) for v in block.values())
    short = arrays.ar_kalman_block(x0[-30:], x1[:30])
    assert np.isnan(short["ar1_phi_pre_w50"]) and np.isfinite(short["ar1_phi_pre_w25"])
    assert all(np.isnan(v) for v in arrays.ar_kalman_block(x0[:2], x1).values())
    low, high = np.quantile(x0, [0.01, 0.99])
    a, b = (np.clip(x, low, high) for x in (x0, x1))
    a, b = (a - a.mean()) / a.std(), (b - a.mean()) / a.std()
    phi = np.cov(a[1:], a[:-1], ddof=0)  # the means of both parts differ a little from the whole one's
    assert block["ar1_phi_pre"] == pytest.approx(phi[0, 1] / a.var(), abs=0.02)
    slope, level = np.polyfit(np.arange(len(b)), b, 1)
    assert block["trend_slope_post"] == pytest.approx(slope)
    assert block["trend_rmse_post"] == pytest.approx(np.sqrt(((b - level - slope * np.arange(len(b))) ** 2).mean()))


def test_full_matrix_has_920_columns(spark):
    from breakwater.plans import multiscale

    assert sum(multiscale.COUNTS.values()) == 920 and set(multiscale.COUNTS) == set(multiscale.GROUPS)
    table, _ = breaks(spark, 2, 60)
    wide = multiscale.matrix(table, ("cv", "compression"))
    assert len(wide.columns) == 1 + 88 + 68 and wide.count() == 2 and {"cv_pre", "cv_pre_w50", "ncd_boundary_w250"} <= set(wide.columns)

"""The series engine against numpy, by metamorphic relations, and against its DuckDB oracles."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest

from breakwater.operators import change, contrasts, distances, dynamics, filters, matrix, preprocessing, probabilities, spectra, tails
from breakwater.plans import catalog
from breakwater.plans.dialect import render
from breakwater.sources import series

from . import numpy_series as arrays
from .conftest import SF

ALL = {f.name: f for m in (preprocessing, contrasts, distances, tails, dynamics, filters, spectra, change, probabilities, matrix) for f in [*m.FAMILIES, *getattr(m, 'PLAIN', [])]}


def table(spark, x0, x1, ident=1):
    rows = [(ident, i + 1, 0, float(v)) for i, v in enumerate(x0)] + [(ident, len(x0) + i + 1, 1, float(v)) for i, v in enumerate(x1)]
    return spark.createDataFrame(rows, "id long, seq long, period int, value double")


def run(spark, name, x0, x1):
    f = ALL[name]
    segs = series.with_positions(table(spark, x0, x1))
    given = {k: series.scoped(segs) if base.startswith("scoped") else segs for k, base in f.inputs.items()}
    return {r.asDict().get("scope", ""): r.asDict() for r in f.apply(spark, given).collect()}


RNG = np.random.default_rng(5)
PRE, POST = RNG.normal(0, 1, 120), RNG.normal(0.7, 2, 110)


def w1(x, y):
    v = np.sort(np.concatenate([x, y]))
    f, g = (np.searchsorted(np.sort(a), v[:-1], "right") / len(a) for a in (x, y))
    return float((np.abs(f - g) * np.diff(v)).sum())


def energy(x, y):
    d = lambda a, b: np.abs(a[:, None] - b[None, :]).mean()
    return 2 * d(x, y) - d(x, x) - d(y, y)


def test_distances_are_those_of_numpy(spark):
    for scope, w in (("full", 1000), ("w50", 50)):
        a, b = PRE[-w:], POST[:w]
        assert run(spark, "wasserstein", PRE, POST)[scope]["wasserstein"] == pytest.approx(w1(a, b), abs=1e-4)
        assert run(spark, "energy_v", PRE, POST)[scope]["energy"] == pytest.approx(energy(a, b), abs=1e-4)


def test_rank_tests_are_those_of_numpy(spark):
    n, m = len(PRE), len(POST)
    rank = np.argsort(np.argsort(np.concatenate([PRE, POST]))) + 1
    z = (rank[:n].sum() - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    assert run(spark, "ranksum_z", PRE, POST)["full"]["wilcoxon_stat"] == pytest.approx(z, abs=1e-4)
    rx, ry = np.sort(rank[:n]), np.sort(rank[n:])
    u = n * ((rx - np.arange(1, n + 1)) ** 2).sum() + m * ((ry - np.arange(1, m + 1)) ** 2).sum()
    assert run(spark, "cvm_stat", PRE, POST)["full"]["cvm_stat"] == pytest.approx(u / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)), abs=1e-4)


def test_identical_segments_have_no_distance_and_swapping_keeps_it(spark):
    assert run(spark, "wasserstein", PRE, PRE[::-1])["full"]["wasserstein"] == 0
    assert run(spark, "energy_v", PRE, PRE)["full"]["energy"] == 0
    assert run(spark, "wasserstein", PRE, POST)["full"] == run(spark, "wasserstein", POST, PRE)["full"]


def test_shift_and_scale(spark):
    base = run(spark, "wasserstein", PRE, POST)["full"]["wasserstein"]
    assert run(spark, "wasserstein", PRE * 3 + 7, POST * 3 + 7)["full"]["wasserstein"] == pytest.approx(3 * base, abs=3e-4)
    assert run(spark, "wasserstein", PRE, PRE + 2)["full"]["wasserstein"] == pytest.approx(2, abs=1e-4)


def test_quantiles_autocorrelation_and_cusum(spark):
    got = run(spark, "quantile_deltas", PRE, POST)["full"]
    for q in (10, 50, 90):
        assert got[f"q{q}_delta"] == pytest.approx(abs(np.quantile(POST, q / 100) - np.quantile(PRE, q / 100)), abs=1e-4)
    acf = lambda x: ((x[1:] - x.mean()) * (x[:-1] - x.mean())).sum() / ((x - x.mean()) ** 2).sum()
    assert run(spark, "acf1_shift", PRE, POST)["full"]["acf1_shift"] == pytest.approx(abs(acf(POST) - acf(PRE)), abs=1e-4)
    c = np.cumsum(PRE - PRE.mean())
    got = run(spark, "cusum_features", PRE, POST)["full"]
    assert got["cusum_pre_max"] == pytest.approx((c / c.std()).max(), abs=1e-4)
    assert got["cusum_pre_path_length"] == pytest.approx(np.abs(np.diff(c / c.std())).sum(), abs=1e-3)


@pytest.mark.parametrize("pre, post", [([1.0], [2.0]), ([3.0] * 20, [3.0] * 20), ([1.0, 2.0], [5.0] * 12), (range(9), range(9)), ([], [1.0, 2.0])])
def test_short_constant_and_missing_segments(spark, pre, post):
    for name in ("wasserstein", "boundary_contrast", "cv_features", "cusum_features", "ar1_yw", "cohens_d", "levene_stat", "quantile_features", "hist_entropy"):
        run(spark, name, list(pre), list(post))


def test_nan_and_null_values_are_dropped_first(spark):
    rows = [(1, 1, 0, 1.0), (1, 2, 0, float("nan")), (1, 3, 0, None), (1, 4, 0, 2.0), (1, 5, 1, 4.0)]
    got = series.with_positions(spark.createDataFrame(rows, "id long, seq long, period int, value double")).collect()
    assert sorted((r.seq, r.pos) for r in got) == [(1, 2), (4, 1), (5, 1)]


def test_validation(spark):
    with pytest.raises(ValueError):
        series.validate(spark.createDataFrame([(1, 2, 0.5)], "id long, period int, value double"))
    with pytest.raises(ValueError):
        series.validate(spark.createDataFrame([(1, 0.5)], "id long, value double"))


@pytest.mark.parametrize("name", ["baseline_score", "wasserstein", "boundary_contrast", "dod_curve", "hill_tail", "cusum_elbow", "ar2_ridge", "rank_normalizer", "cv_auc_rank_mean", "ad_stat"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()[list(got.columns)]
    keys = list(got.columns)
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    for c in keys:
        a, b = got[c].to_numpy(), want[c].to_numpy()
        same = (a == b) | ((a != a) & (b != b)) if got[c].dtype.kind in "fi" else a == b
        assert same.all(), c


def test_results_do_not_depend_on_partitions(spark):
    first = sorted(map(tuple, catalog.QUERIES["baseline_score"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(tuple, catalog.QUERIES["baseline_score"](spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_macros_nest():
    assert render("R(DIV(a, max(b, c)))", 1).count("round(") == 2
    assert "try_divide" in render("DIV(PCT(v, 0.5), 2)", 0)


@pytest.mark.parametrize("name", list(arrays.FUNCTIONS))
def test_array_functions_keep_their_keys(name):
    f = arrays.FUNCTIONS[name]
    keys = list(f(PRE, POST))
    assert all(math.isfinite(v) for v in f(PRE, POST).values())
    for a, b in (([], []), ([1.0], []), ([1.0], [2.0]), ([1.0, 1.0, 1.0], [1.0, 1.0]), (PRE[:9], POST[:5]), (np.ones(30), np.ones(30))):
        assert list(f(np.array(a, float), np.array(b, float))) == keys


def test_wavelet_keeps_energy_and_constants():
    x = np.tile(PRE[:64], 1)
    assert len(arrays.wavelet_details(x)[1]) == 3
    assert all(np.abs(d).max() < 1e-9 for d in arrays.wavelet_details(np.ones(64))[1])
    a, details = arrays.haar_details(x)
    assert (a**2).sum() + sum((d**2).sum() for d in details) == pytest.approx((x**2).sum())


def test_kalman_and_change_point_find_a_jump():
    x = np.concatenate([np.zeros(60), np.full(60, 20.0)]) + RNG.normal(0, 0.1, 120)
    got = arrays.change_points(x[:60], x[60:])
    assert got["binseg_l2_cp_pos_error"] < 0.01 and got["pelt_l2_first_cp_pos_error"] < 0.01
    assert arrays.kalman(x[:60], x[60:])["kf_innov_var_pre"] > 0


def test_probabilities_agree_with_known_values():
    assert arrays.beta_share(2, 3, 0.5) == pytest.approx(0.6875)
    assert arrays.f_share(1.0, 5, 5) == pytest.approx(0.5)
    assert arrays.normal_tail(1.959963985) == pytest.approx(0.05)
    assert arrays.kolmogorov(0.0, 10, 10) == 1.0
    assert arrays.cvm_tail(0.46136) == pytest.approx(0.05, abs=2e-3) and arrays.cvm_tail(0.74346) == pytest.approx(0.01, abs=2e-3)


def test_lz76_counts_phrases():
    assert arrays.lz76(np.array([1.0] * 16)) == 2
    assert arrays.lz76(RNG.normal(size=200)) > 10


def test_engine_scores_breaks_above_others(spark):
    from breakwater.plans import engine

    rng = np.random.default_rng(3)
    frames = [table(spark, rng.normal(0, 1, 40), rng.normal(3 * (k % 2), 1 + k % 2, 40), k) for k in range(6)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.union(f)
    got = {r.id: r.score for r in engine.infer(rows, families=("quantile_deltas", "wasserstein")).collect()}
    assert min(got[k] for k in (1, 3, 5)) > max(got[k] for k in (0, 2, 4)) and all(0 <= s <= 1 for s in got.values())


def test_folds_are_stratified_and_scores_probabilities(spark):
    from breakwater.operators import learning

    df = learning.folded(learning.matrix_of(spark, SF))
    sizes = {(r.y, r.fold): r["count"] for r in df.groupBy("y", "fold").count().collect()}
    for y in (0.0, 1.0):
        n = [sizes[(y, k)] for k in range(learning.FOLDS)]
        assert max(n) - min(n) <= 1
    got = learning.out_of_fold(df.cache(), learning.logistic).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)


def test_loader_round_trip(spark, tmp_path):
    table(spark, [1, 2], [3]).write.parquet(str(tmp_path / "X_test.reduced.parquet"))
    x, y = series.load_split(spark, str(tmp_path), "test")
    assert x.count() == 3 and y is None
    series.save_predictions(spark.createDataFrame([(1, 0.5)], "id long, score double"), str(tmp_path / "out"))
    assert series.read_series(spark, str(tmp_path / "out")).columns == ["id", "prediction"]
    with pytest.raises(FileNotFoundError):
        series.load_split(spark, str(tmp_path), "train")

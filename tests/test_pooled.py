"""Families over sorted values: the plans that Spark runs, and odd segments against the SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from breakwater.operators import distances, pooled, spectra, tails
from breakwater.plans import engine
from breakwater.sources import series, tables

SLOW = ("percentile(", "Window ", "transform(")


@pytest.fixture(scope="module")
def odd(spark):
    """Series with ties, one value only, one segment only, few points, and an infinite value."""
    rng, rows = np.random.default_rng(3), []
    for i, (n0, n1) in enumerate(((60, 55), (30, 30), (3, 40), (0, 9), (1, 1), (2, 2), (20, 17))):
        x = np.full(n0 + n1, 4.5) if i == 1 else rng.normal(size=n0 + n1).round(1 if i % 2 else 6) + 1
        rows += [(i, s + 1, float(v), int(s >= n0)) for s, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, seq long, value double, period int").repartition(3)


def _plans(spark, monkeypatch, x, families):
    """Texts of the plans that the families run over scoped segments."""
    seen, write = [], tables.staged

    def staged(df, name):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(tables, "staged", staged)
    for f in families:
        seen.append(f.apply(spark, {"x": x})._jdf.queryExecution().optimizedPlan().toString())
    return seen


FINDINGS = ("winsor_distances", "boundary_distances", "tail_distances", "tail_bulk", "localization", "dod_curve", "dod_ratios", "agreement", "tail_localization", "tail_curve", "hill_tail", "wavelet", "spectral", "wasserstein", "energy_v", "quantile_deltas", "scale_shift", "ks_stat", "ar1_yw")


@pytest.mark.parametrize("name", FINDINGS)
def test_values_are_sorted_once_a_series(spark, monkeypatch, odd, name):
    """No quantile by a map of all values, no window and no join over scoped rows."""
    x = series.scoped(tables.staged(series.with_positions(odd), "segments"))
    assert not [p for p in _plans(spark, monkeypatch, x, [engine.SCOPED[name]]) if any(s in p for s in SLOW)]


@pytest.mark.parametrize("name", FINDINGS)
def test_odd_segments_as_in_sql(spark, odd, name):
    x = series.scoped(series.with_positions(odd))
    got = engine.SCOPED[name].apply(spark, {"x": x}).toPandas()
    con = duckdb.connect()
    rows = x.toPandas()  # noqa: F841
    sql = engine.SCOPED[name].oracle()
    start = sql.index("x AS (") + len("x AS (")
    depth, end = 1, start
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    want = con.execute(sql[:start] + "SELECT * FROM rows" + sql[end - 1 :]).df()[list(got.columns)]
    keys = [c for c in ("id", "scope") if c in got.columns]
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        if c == "scope":
            assert list(got[c]) == list(want[c])
        else:
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1.1e-4, err_msg=c)


def test_statistics_are_made_once_for_a_matrix(spark, monkeypatch, odd):
    names, write = [], tables.staged
    monkeypatch.setattr(tables, "staged", lambda df, name: (names.append(name), write(df, name))[1])
    engine.features(odd, ("quantile_features", "quantile_deltas", "scale_shift", "acf1_shift", "ar1_yw", "wasserstein", "energy_v"))
    assert sorted(names) == ["compared", "segments", "statistics"]


def test_tasks_take_a_bounded_number_of_points(spark, monkeypatch):
    monkeypatch.setattr(series, "POINTS", 10)
    rows = spark.range(500)
    assert series.by_id(rows, 500).rdd.getNumPartitions() == max(50, spark.sparkContext.defaultParallelism)

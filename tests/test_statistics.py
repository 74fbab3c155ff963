"""Families in SQL against numpy, on series with every odd length, ties, constants and gaps."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from breakwater.operators import change, filters, probabilities, spectra
from breakwater.sources import series

from . import numpy_series

RNG = np.random.default_rng(21)
CASES = {
    1: (RNG.normal(size=150), RNG.normal(0.5, 2, size=143)),
    2: (RNG.normal(size=61).round(1), RNG.normal(1, 1, size=74).round(1)),
    3: (np.ones(40), RNG.normal(size=40)),
    4: (RNG.normal(size=30), np.full(28, 2.0)),
    5: (RNG.normal(size=9), RNG.normal(size=5)),
    6: (RNG.normal(size=3), RNG.normal(size=2)),
    7: (RNG.normal(size=2), RNG.normal(size=40)),
    8: (RNG.normal(size=16), RNG.normal(size=15)),
    9: (np.cumsum(RNG.normal(size=120)), np.cumsum(RNG.normal(size=101)) + 4),
    10: (np.arange(26) % 4.0, np.arange(26) % 3.0),
    11: (np.zeros(50), np.zeros(50)),
    12: (RNG.normal(size=400), RNG.normal(size=300)),
}
FAMILIES = {f.name: f for m in (filters, spectra, change, probabilities) for f in [*m.FAMILIES, *getattr(m, "PLAIN", [])]}
#: Cases for which a statistic divides by a spread of nothing but rounding.
NOISE = {"transform_ewma": {3, 4, 11}, "ar_kalman_block": {3, 11}, "kalman_grid": {3, 4, 11}, "kalman_local_level": {3, 4, 11}, "test_pvalues": {3, 4, 11}, "pelt": {3, 4, 10, 11}, "spectral_advanced": {3, 4, 11, 10}, "wavelet_levels": {3, 4, 11}, "ar_kalman_estimated": {4, 11}, "spectral": {4}, "wavelet": {4}, "haar_dwt": {4}}


@pytest.fixture(scope="module")
def segs(spark):
    rows = [(k, i + 1, int(i >= len(a)), float(v)) for k, (a, b) in CASES.items() for i, v in enumerate(np.concatenate([a, b]))]
    return series.with_positions(spark.createDataFrame(rows, "id long, seq long, period int, value double").repartition(3)).cache()


@pytest.mark.parametrize("name", list(numpy_series.FUNCTIONS))
def test_family_equals_numpy(spark, segs, name):
    f = FAMILIES[name]
    given = {k: series.scoped(segs) if base.startswith("scoped") else segs for k, base in f.inputs.items()}
    got = {(r["id"], r.asDict().get("scope", "full")): r.asDict() for r in f.apply(spark, given).collect()}
    compared = 0
    for k, (a, b) in CASES.items():
        if k in NOISE.get(name, ()):
            continue
        for scope, (x0, x1) in {"full": (a, b), "w50": (a[-50:], b[:50])}.items():
            if scope == "w50" and not any(s == "w50" for _, s in got):
                continue
            row = got.get((k, scope), {})
            for column, want in numpy_series.FUNCTIONS[name](x0, x1).items():
                have = row.get(column)
                if not math.isfinite(want):
                    assert have is None or not math.isfinite(have), (name, k, scope, column, have, want)
                else:
                    compared += 1
                    # numpy's tail of the last test is an integral of coarse steps
                    assert have == pytest.approx(want, abs=4e-3 if column == "cvm_pval" else 1.1e-4, rel=1e-6), (name, k, scope, column)
    assert compared > 20


def test_exact_probability_of_small_samples(spark):
    """All ways to deal two samples out of distinct values, for sizes up to eight, and every gap."""
    from pyspark.sql import functions as F

    want = {}
    for n, m in [(1, 1), (1, 8), (3, 4), (4, 4), (5, 7), (8, 6), (8, 8)]:
        gaps = []
        for first in itertools.combinations(range(n + m), n):
            c0 = np.cumsum(np.isin(np.arange(n + m), first))
            gaps.append(np.abs(c0 * m - (np.arange(1, n + m + 1) - c0) * n).max())
        for d in sorted(set(gaps)):
            want[(n, m, int(d))] = float(np.mean(np.array(gaps) >= d))
    got = probabilities.lattice_p(spark.createDataFrame(list(want), "n0 long, n1 long, d long")).withColumn("p", F.col("p"))
    assert {(r.n0, r.n1, r.d): r.p for r in got.collect()} == pytest.approx(want)


def test_anderson_darling_levels():
    import re

    from breakwater.plans.dialect import render

    import duckdb

    for a, p in zip(probabilities.AD_CRITICAL, probabilities.AD_LEVELS):
        found = duckdb.sql(render(f"SELECT {probabilities.anderson_p(f'DBL({a})')} AS p", 1)).fetchall()[0][0]
        assert found == pytest.approx(p, rel=0.15)
    assert duckdb.sql(render(f"SELECT {probabilities.anderson_p('DBL(-2)')} AS p", 1)).fetchall()[0][0] == 0.25
    assert duckdb.sql(render(f"SELECT {probabilities.anderson_p('DBL(99)')} AS p", 1)).fetchall()[0][0] == 0.001
    assert re.search("exp", probabilities.anderson_p("a"))


def test_tails_at_tabulated_points():
    import duckdb

    from breakwater.plans.dialect import render

    points = {
        probabilities.cvm_p("DBL(0.46136)"): 0.05, probabilities.cvm_p("DBL(0.74346)"): 0.01, probabilities.cvm_p("DBL(1.16786)"): 0.001, probabilities.cvm_p("DBL(0.34730)"): 0.10,
        probabilities.normal_p("DBL(1.959963985)"): 0.05, probabilities.normal_p("DBL(0)"): 1.0, probabilities.kolmogorov_p("DBL(1.3580986)"): 0.05,
        probabilities.beta_share("DBL(2)", "DBL(3)", "DBL(0.5)"): 0.6875, probabilities.beta_share("DBL(300.5)", "DBL(299.5)", "DBL(0.5)"): numpy_series.beta_share(300.5, 299.5, 0.5),
    }
    for text, want in points.items():
        assert duckdb.sql(render(f"SELECT {text} AS p", 1)).fetchall()[0][0] == pytest.approx(want, abs=1e-5)


def test_scan_of_long_arrays(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 255, 256, 257, 1000):
        xs = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double"))
        got = spark.range(1).select(filters.scanned(xs, F.lit(0.0), lambda s, x: s + x).alias("s")).first().s
        assert got == np.cumsum(np.arange(1, n + 1)).tolist()

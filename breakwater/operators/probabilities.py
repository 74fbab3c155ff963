"""p-values of the two-sample tests, in SQL.

Tails of the normal, Kolmogorov, F and Cramér-von Mises distributions are series and continued
fractions of a fixed number of terms. For small samples the Kolmogorov-Smirnov p-value is
exact: the share of lattice paths that leave the band. The Anderson-Darling p-value is
interpolated in the published critical values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.operators.distances import _AD_STEPS, _MOMENTS, _ROWS, _U, FG, RANK, X, sweep
from breakwater.plans.family import columns, family, kept

# A rational fit of the complementary error function, to 1.2e-7 of its value.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# Critical points of the standardised Anderson-Darling statistic of two samples and their significance.
AD_CRITICAL = (0.325, 1.226, 1.961, 2.718, 3.752, 4.592, 6.546)
AD_LEVELS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
#: Products of both sizes up to which the Kolmogorov-Smirnov p-value is exact.
EXACT = 10_000
#: Terms of the continued fraction of the beta function; it converges in about the root of the degrees of freedom.
FRACTION = 400


def normal_p(z: str) -> str:
    """Two-sided p-value of a standard normal."""
    x = f"(abs({z}) / sqrt(DBL(2)))"
    t = f"(1 / (1 + {x} / 2))"
    fit = repr(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        fit = f"({c!r} + {t} * {fit})"
    return f"least({t} * exp(-{x} * {x} + {fit}), 1)"


def log_gamma(x: str) -> str:
    """Stirling's series seven steps up."""
    y = f"({x} + 7)"
    steps = " * ".join(f"({x} + {i})" for i in range(7))
    return f"(({y} - 0.5) * LN({y}) - {y} + 0.9189385332046727 + 1 / (12 * {y}) - 1 / (360 * power({y}, 3)) + 1 / (1260 * power({y}, 5)) - LN({steps}))"


def _beta_tail(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function where its fraction converges fast, evaluated from its last term back."""
    m = f"({FRACTION} - k + 1)"
    even = f"({m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m})))"
    odd = f"(-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1)))"
    first = f"(-({a} + {b}) * {x} / ({a} + 1))"
    fraction = f"(1 + {first} / FOLD(1, {FRACTION}, 1, 1 + {even} / (1 + {odd} / acc)))"
    return f"(exp({log_gamma(f'({a} + {b})')} - {log_gamma(a)} - {log_gamma(b)} + {a} * LN({x}) + {b} * LN(1 - {x})) / {a} / {fraction})"


def beta_share(a: str, b: str, x: str) -> str:
    low, high = _beta_tail(a, b, x), _beta_tail(b, a, f"(1 - {x})")
    return f"CASE WHEN {x} <= 0 THEN DBL(0) WHEN {x} >= 1 THEN DBL(1) WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {low} ELSE 1 - {high} END"


def kolmogorov_p(t: str) -> str:
    """Asymptotic."""
    return f"CASE WHEN {t} < 0.2 THEN DBL(1) ELSE greatest(least(2 * FOLD(1, 100, 0, acc + (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * {t} * {t})), 1), 0) END"


def cvm_p(t: str) -> str:
    """Upper tail of the limiting Cramér-von Mises distribution: a series of Bessel functions of order 1/4, each by its integral."""
    terms, weight = [], 1.0  # weight: Gamma(j + 1/2) / (Gamma(1/2) j!)
    for j in range(8):
        q = f"({(4 * j + 1) ** 2} / (16 * {t}))"
        bessel = f"FOLD(0, 90, 0, acc + (CASE WHEN k = 0 THEN 0.5 ELSE 1 END) * 0.1 * exp(-{q} * ((exp(k / 10) + exp(-k / 10)) / 2 + 1)) * (exp(k / 40) + exp(-k / 40)) / 2)"
        terms.append(f"{weight * (4 * j + 1) ** 0.5!r} * {bessel}")
        weight *= (j + 0.5) / (j + 1)
    return f"CASE WHEN {t} <= 0.003 THEN DBL(1) WHEN {t} > 6 THEN DBL(0) ELSE greatest(least(1 - ({' + '.join(terms)}) / (3.141592653589793 * sqrt({t})), 1), 0) END"


def anderson_p(a: str) -> str:
    """Interpolated on the logarithm of the level by a parabola through the published points, and never beyond them."""
    c2, c1, c0 = map(float, np.polyfit(AD_CRITICAL, np.log(AD_LEVELS), 2))
    return f"CASE WHEN {a} < {AD_CRITICAL[0]} THEN DBL({AD_LEVELS[0]}) WHEN {a} > {AD_CRITICAL[-1]} THEN DBL({AD_LEVELS[-1]}) ELSE exp({c2!r} * {a} * {a} + {c1!r} * {a} + {c0!r}) END"


def lattice_p(sizes: DataFrame) -> DataFrame:
    """``sizes(n0, n1, d)`` with ``p``: the chance that a path of n0 and n1 steps reaches the gap ``d``, a whole number of 1 / (n0 n1).

    Paths are counted along n0 as shares: ``a[j]`` is the share of paths to (i, j) that stay inside.
    """
    inside = lambda i, j: F.abs(i * F.col("n1") - j * F.col("n0")) < F.col("d")
    across = F.sequence(F.lit(0).cast("long"), F.col("n1"))
    start = F.transform(across, lambda j: F.when(j * F.col("n0") < F.col("d"), 1.0).otherwise(0.0))

    def row(old, i):
        def step(acc, j):
            here = F.when(inside(i, j), (acc["p"] * j + F.get(old, j.cast("int")) * i) / (i + j)).otherwise(0.0)
            return F.struct(here.alias("p"), F.concat(acc["row"], F.array(here)).alias("row"))

        none = F.struct(F.lit(0.0).alias("p"), F.array().cast("array<double>").alias("row"))
        return F.aggregate(across, none, step)["row"]

    last = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n0")), start, row)
    return sizes.withColumn("p", 1 - F.get(last, F.col("n1").cast("int")))


_STATS = (
    "st",
    "SELECT id, scope, max(n0) AS n0, max(n1) AS n1, max(abs(" + FG + ")) AS ks, "
    "(sum(k0 * RANK0) - max(n0) * (max(n0) + max(n1) + 1) / 2) / sqrt(max(n0) * max(n1) * (max(n0) + max(n1) + 1) / 12) AS wz, "
    "(sum(k0 * power(RANK0 - (n0 + n1 + 1) / 2, 2)) - max(n0) * (power(max(n0) + max(n1), 2) - 1) / 12) / sqrt(max(n0) * max(n1) * (max(n0) + max(n1) + 1) * (max(n0) + max(n1) + 2) * (max(n0) + max(n1) - 2) / 180) AS mz, "
    "(CVMU) / (max(n0) * max(n1) * (max(n0) + max(n1))) - (4 * max(n0) * max(n1) - 1) / (6 * (max(n0) + max(n1))) AS cvm FROM {sw} GROUP BY id, scope HAVING max(n0) >= 3 AND max(n1) >= 3",
)
_STATS = (_STATS[0], _STATS[1].replace("RANK0", RANK).replace("CVMU", _U))
_LEVENE = (
    ("l", "SELECT id, scope, period, DBL(count(*)) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM {r} GROUP BY id, scope, period"),
    ("t", "SELECT id, scope, sum(n) AS nn, sum(n * m) / sum(n) AS gm, sum(ss) AS sw FROM {l} GROUP BY id, scope"),
    ("lv", "SELECT l.id, l.scope, DIV((max(nn) - 2) * sum(n * power(m - gm, 2)), max(sw)) AS f FROM {l} l JOIN {t} t ON l.id = t.id AND l.scope = t.scope GROUP BY l.id, l.scope"),
    ("fr", "SELECT id, scope, DIV(V0(v), V1(v)) AS f FROM {mo} GROUP BY id, scope"),
)
#: Arguments of the tails, so that each is a column.
_ARGS = (
    "ar",
    "SELECT s.id, s.scope, ks * sqrt(n0 * n1 / (n0 + n1)) AS kt, wz, mz, (n0 - 1) / 2 AS fa, (n1 - 1) / 2 AS fb, (n0 - 1) * fr.f / ((n0 - 1) * fr.f + n1 - 1) AS fx, (n0 + n1 - 2) / 2 AS lb, lv.f / (lv.f + n0 + n1 - 2) AS lx, "
    "DBL(1) / 6 + (cvm - (1 + 1 / (n0 + n1)) / 6) / sqrt(45 * (n0 + n1 + 1) * (4 * n0 * n1 * (n0 + n1) - 3 * (n0 * n0 + n1 * n1) - 2 * n0 * n1) / (45 * power(n0 + n1, 2) * 4 * n0 * n1)) AS ct "
    "FROM {st} s JOIN {fr} fr ON s.id = fr.id AND s.scope = fr.scope JOIN {lv} lv ON s.id = lv.id AND s.scope = lv.scope",
)
_SHARES = ("sh", f"SELECT id, scope, kt, wz, mz, ct, {beta_share('fa', 'fb', 'fx')} AS fs, {beta_share('DBL(0.5)', 'lb', 'lx')} AS ls FROM {{ar}}")
_P = {"f_test_p": "2 * least(fs, 1 - fs)", "levene_p": "1 - ls", "ks_p": kolmogorov_p("kt"), "wilcoxon_pval": normal_p("wz"), "mood_pval": normal_p("mz"), "cvm_pval": cvm_p("ct")}

#: Kolmogorov-Smirnov of small samples: gaps in whole numbers, and paths by recursion over their steps.
#: Sizes and gaps that a task counts paths for.
LATTICES = 200


def _apart(sizes: DataFrame) -> DataFrame:
    """Sizes over as many tasks as their number calls for: they cost time, not bytes, so partitions must not be joined."""
    n = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-sizes.count() // LATTICES))
    return sizes.repartition(n, "n0", "n1", "d")


_GAPS = kept(("gp", "SELECT id, BIG(max(n0)) AS n0, BIG(max(n1)) AS n1, BIG(max(abs(c0 * n1 - c1 * n0))) AS d, max(abs(" + FG + ")) AS ks FROM {sw} WHERE n0 > 0 AND n1 > 0 GROUP BY id"))
_SIZES = kept(("sz", f"SELECT DISTINCT n0, n1, d FROM {{gp}} WHERE n0 * n1 <= {EXACT}"))
_PATHS = (
    "pa",
    "SELECT n0, n1, d, BIG(0) AS i, BIG(0) AS j, DBL(1) AS p FROM {sz} UNION ALL SELECT n0, n1, d, BIG(i + di) AS i, BIG(j + 1 - di) AS j, DBL(sum(p * (di * (i + 1) + (1 - di) * (j + 1)) / (i + j + 1))) AS p FROM {pa} CROSS JOIN (VALUES (0), (1)) AS s(di) "
    "WHERE i + di <= n0 AND j + 1 - di <= n1 AND abs((i + di) * n1 - (j + 1 - di) * n0) < d GROUP BY n0, n1, d, i + di, j + 1 - di",
    lambda have: None,
)
_LATTICE = ("la", "SELECT z.n0, z.n1, z.d, 1 - coalesce(p.p, 0) AS p FROM {sz} z LEFT JOIN {pa} p ON z.n0 = p.n0 AND z.n1 = p.n1 AND z.d = p.d AND p.i = z.n0 AND p.j = z.n1", lambda have: lattice_p(_apart(have["sz"])))

FAMILIES = [
    family("test_pvalues", *sweep(), _STATS, _MOMENTS, _ROWS, *_LEVENE, _ARGS, _SHARES, "SELECT " + columns(_P) + " FROM {sh}", **X),
    family("ks_exact", ("x", "SELECT id, 'full' AS scope, period, value FROM {seg}"), *sweep(), _GAPS, _SIZES, _PATHS, _LATTICE, "SELECT g.id, R(ks) AS ks_stat, R(greatest(least(coalesce(p, " + kolmogorov_p("(ks * sqrt(DBL(g.n0 * g.n1) / (g.n0 + g.n1)))") + "), 1), 0)) AS ks_p FROM {gp} g LEFT JOIN {la} l ON g.n0 = l.n0 AND g.n1 = l.n1 AND g.d = l.d", seg="seg_users"),
    family("ad_pvalue", *sweep(), *_AD_STEPS, ("sd", "SELECT id, scope, (a2 - 1) / sqrt((ca * n * n * n + cb * n * n + cc * n + cd) / ((n - 1) * (n - 2) * (n - 3))) AS a FROM {co}"), "SELECT id, scope, R(a) AS anderson_darling_stat, R(" + anderson_p("a") + ") AS anderson_darling_p FROM {sd}", x="scoped_suppliers", seg="seg_suppliers"),
]

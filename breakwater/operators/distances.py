"""Distances and two-sample tests from one sweep over the pooled sorted sample.

``sweep`` holds, for each distinct value of a group, the running counts of both segments and
the gap to the next value; all statistics are sums over it, in O(n log n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.operators import pooled
from breakwater.plans.dialect import render
from breakwater.plans.family import columns, family, kept, way

X = {"x": "scoped_suppliers"}
EPS = "1e-12"


def sweep(source: str = "x", keys: str = "id, scope") -> tuple[tuple[str, str], ...]:
    """Steps ``g`` (counts by value) and ``sw`` (running counts c0, c1, totals n0, n1, gap) of a relation."""
    return (
        ("g", f"SELECT {keys}, value, DBL(sum(CASE WHEN period = 0 THEN 1 ELSE 0 END)) AS k0, DBL(sum(CASE WHEN period = 1 THEN 1 ELSE 0 END)) AS k1 FROM {{{source}}} GROUP BY {keys}, value"),
        ("sw", f"SELECT {keys}, value, k0, k1, sum(k0) OVER (PARTITION BY {keys} ORDER BY value) AS c0, sum(k1) OVER (PARTITION BY {keys} ORDER BY value) AS c1, sum(k0) OVER (PARTITION BY {keys}) AS n0, sum(k1) OVER (PARTITION BY {keys}) AS n1, lead(value) OVER (PARTITION BY {keys} ORDER BY value) - value AS gap FROM {{g}}"),
    )


#: F - G of the two empirical distribution functions.
FG = "(c0 / n0 - c1 / n1)"
#: Mid-rank of a value in the pooled sample.
RANK = "(c0 + c1 - (k0 + k1) / 2 + 0.5)"
_GROUP = " FROM {sw} WHERE n0 > 0 AND n1 > 0 GROUP BY id, scope"


def _swept(name: str, pairs: dict[str, str], **inputs):
    return family(name, *sweep(), "SELECT " + columns(pairs) + _GROUP, **(inputs or X))


def _compared(name: str, column: str, swept: str, whole: str):
    """A distance that is a sum over the sweep; on Spark an expression of ``pooled.compared``."""
    text = render("SELECT " + columns({column: whole}) + " FROM {cp} WHERE n0 > 0 AND n1 > 0", 0)
    last = way(lambda have: have["x"].sparkSession.sql(text, cp=pooled.compared(have["x"])), "x")
    return family(name, *sweep(), ("result", "SELECT " + columns({column: swept}) + _GROUP, last), **X)


def _sq(n: str) -> str:
    return f"({n} * ({n} + 1) * (2 * {n} + 1) / 6)"


_CVM = "max(n{i}) * sum(k{i} * {r} * {r} - 2 * {r} * (k{i} * (2 * c{i} - k{i} + 1) / 2) + ({a} - {b}))"
_U = " + ".join(_CVM.format(i=i, r=RANK, a=_sq(f"c{i}"), b=_sq(f"(c{i} - k{i})")) for i in (0, 1))
_NN, _N = "(max(n0) * max(n1))", "(max(n0) + max(n1))"
_ROWS = ("r", "SELECT x.id, x.scope, x.period, abs(value - med) AS z FROM {x} x JOIN (SELECT id, scope, period, PCT(value, 0.5) AS med FROM {x} GROUP BY id, scope, period) m ON x.id = m.id AND x.scope = m.scope AND x.period = m.period")
_MOMENTS = ("mo", "SELECT id, scope, period, DBL(count(*)) AS n, avg(value) AS mean, var_samp(value) AS v FROM {x} GROUP BY id, scope, period")

# Anderson-Darling with mid-ranks, and the harmonic sums its variance needs.
_L, _B = "(k0 + k1)", "(c0 + c1 - (k0 + k1) / 2)"
_NALL = "(n0 + n1)"
_AD_TERM = "{l} * power({N} * (c{i} - k{i} / 2) - n{i} * {b}, 2) / ({b} * ({N} - {b}) - {N} * {l} / 4) / n{i}"
_AD = f"sum(({_NALL} - 1) / {_NALL} / {_NALL} * (" + " + ".join(_AD_TERM.format(l=_L, N=_NALL, b=_B, i=i) for i in (0, 1)) + "))"
_AD_STEPS = (
    ("a", f"SELECT id, scope, max(n0) AS n0, max(n1) AS n1, {_AD} AS a2 {_GROUP}"),
    ("sizes", "SELECT DISTINCT n0 + n1 AS n FROM {a}"),
    ("nums", "SELECT DISTINCT DBL(seq) AS j FROM {seg}"),
    ("hs", "SELECT n, j, sum(1 / (n - j + 1)) OVER (PARTITION BY n ORDER BY j) AS cs FROM {sizes} JOIN {nums} ON j >= 2 AND j <= n - 1"),
    ("hg", "SELECT n, max(cs) + 1 AS h, sum(cs / j) AS g FROM {hs} GROUP BY n"),
    ("co", "SELECT id, scope, a2, n, (4 * g - 6) + (10 - 6 * g) * q AS ca, (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * q - 8 * h + 4 * g - 6 AS cb, (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * q + 4 * h AS cc, (2 * h + 6) * 4 - 8 * h AS cd FROM (SELECT a.*, h, g, n, 1 / n0 + 1 / n1 AS q FROM {a} a JOIN {hg} k ON a.n0 + a.n1 = k.n) z"),
)

# Variants of the two segments: as they are, winsorised, and tails cut at each segment's own quantiles.
_QS = ("q", "SELECT id, scope, period, PCT(value, 0.05) AS q05, PCT(value, 0.1) AS q10, PCT(value, 0.9) AS q90, PCT(value, 0.95) AS q95 FROM {x} GROUP BY id, scope, period")
_JOIN = "FROM {x} x JOIN {q} q ON x.id = q.id AND x.scope = q.scope AND x.period = q.period"
_CUTS = {"q90_upper": "value >= q90", "q90_lower": "value <= q10", "q90_both": "value >= q90 OR value <= q10", "q95_upper": "value >= q95", "q95_lower": "value <= q05", "q95_both": "value >= q95 OR value <= q05"}
_VARIANTS = (
    "v",
    "SELECT id, scope, period, 'raw' AS variant, value FROM {x} UNION ALL "
    f"SELECT x.id, x.scope, x.period, 'wins' AS variant, least(greatest(value, q05), q95) AS value {_JOIN}"
    + "".join(f" UNION ALL SELECT x.id, x.scope, x.period, '{k}' AS variant, value {_JOIN} WHERE {c}" for k, c in _CUTS.items()),
)
_BASIC = ("bv", "SELECT * FROM {v} WHERE variant IN ('raw', 'wins')")


_VARIANTS_OF = {"bv": ("raw", "wins"), "v": ("raw", "wins", *_CUTS)}


def _standardised(x: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """Spark's way to ``d``: one shuffle of the segments, a series at a time."""
    scale = F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s"))
    rows = pooled.variants_apart(x, variants).withColumn("ener", F.sqrt(F.greatest(2 * F.col("area2"), F.lit(0.0))))
    return rows.select("id", "scope", "variant", F.col("area").alias("wass"), "ener", (F.col("area") / scale).alias("wz"), (F.col("ener") / scale).alias("ez"))


def _located(x: DataFrame) -> DataFrame:
    of = lambda c: F.max(F.when(F.col("period") == 1, F.col(c))) - F.max(F.when(F.col("period") == 0, F.col(c)))
    return pooled.statistics(x).groupBy("id", "scope").agg(of("mean").alias("dm"), of("med").alias("dmed"))


def _distances(source: str) -> tuple[tuple, ...]:
    """Steps that end in ``d``: Wasserstein, energy and both over the pooled robust scale, by variant."""
    return (
        *sweep(source, "id, scope, variant"),
        ("w", f"SELECT id, scope, variant, sum(abs({FG}) * gap) AS wass, sqrt(greatest(2 * sum({FG} * {FG} * gap), 0)) AS ener FROM {{sw}} WHERE n0 >= 2 AND n1 >= 2 GROUP BY id, scope, variant"),
        ("pm", f"SELECT id, scope, variant, PCT(value, 0.5) AS med FROM {{{source}}} GROUP BY id, scope, variant"),
        ("ps", f"SELECT v.id, v.scope, v.variant, 1.4826 * PCT(abs(value - med), 0.5) AS s FROM {{{source}}} v JOIN {{pm}} p ON v.id = p.id AND v.scope = p.scope AND v.variant = p.variant GROUP BY v.id, v.scope, v.variant"),
        ("d", "SELECT w.id, w.scope, w.variant, wass, ener, wass / sc AS wz, ener / sc AS ez FROM (SELECT w.*, CASE WHEN s < 1e-12 THEN DBL(1) ELSE s END AS sc FROM {w} w JOIN {ps} p ON w.id = p.id AND w.scope = p.scope AND w.variant = p.variant) w", way(lambda have: _standardised(have["x"], _VARIANTS_OF[source]), "x")),
    )


def _of(variant: str, col: str) -> str:
    return f"max(CASE WHEN variant = '{variant}' THEN {col} END)"


#: The four standardised distances of a scope, wide.
_WIDE = kept(("z4", "SELECT id, scope, " + ", ".join(f"{_of(v, c)} AS {n}" for v, c, n in (("raw", "wz", "wassz"), ("raw", "ez", "enez"), ("wins", "wz", "wins_wassz"), ("wins", "ez", "wins_enez"))) + " FROM {d} GROUP BY id, scope"))
_FOUR = ("wassz", "enez", "wins_wassz", "wins_enez")
_PAIRS = (("wassz", "enez"), ("wins_wassz", "wins_enez"))
_D2 = (_QS, _VARIANTS, _BASIC, *_distances("bv"))
_Z4 = (*_D2, _WIDE)
LOGW = "LN(CASE scope WHEN 'w50' THEN 50 WHEN 'w100' THEN 100 ELSE 250 END)"


def curve(metrics: dict[str, str], prefix: str, source: str) -> str:
    """Statistics of each metric over the windows: its line against the log of the window, range, spread and bend."""
    out = []
    for name, m in metrics.items():
        p = f"{prefix}_{name}"
        few = lambda e: f"CASE WHEN count({m}) < 2 THEN NULL ELSE {e} END"  # noqa: E731, B023
        low, high = f"MINBY(CASE WHEN {m} IS NOT NULL THEN {m} END, CASE WHEN {m} IS NOT NULL THEN lw END)", f"MAXBY(CASE WHEN {m} IS NOT NULL THEN {m} END, CASE WHEN {m} IS NOT NULL THEN lw END)"
        out += [
            (f"{p}_slope_logw", f"regr_slope({m}, lw)"), (f"{p}_intercept_logw", f"regr_intercept({m}, lw)"), (f"{p}_range", few(f"max({m}) - min({m})")), (f"{p}_std", few(f"stddev_pop({m})")),
            (f"{p}_cv", few(f"CASE WHEN avg(abs({m})) > {EPS} THEN stddev_pop({m}) / avg(abs({m})) END")), (f"{p}_delta_wmin_wmax", few(f"{high} - {low}")), (f"{p}_ratio_wmin_wmax", few(f"CASE WHEN abs({low}) > {EPS} THEN {high} / {low} END")),
            (f"{p}_curv_wA_wB_wC", " - 2 * ".join(f"max(CASE WHEN scope = '{s}' THEN {m} END)" for s in ("w50", "w100")) + f" + max(CASE WHEN scope = 'w250' THEN {m} END)"),
        ]
    return "SELECT " + columns(dict(out), "id") + f" FROM (SELECT *, {LOGW} AS lw FROM {{{source}}} WHERE scope <> 'full') z GROUP BY id"


def localized(metrics: tuple[str, ...], prefix: str, source: str) -> str:
    """Each metric at a window against the full scope."""
    pairs = {}
    for m in metrics:
        pairs |= {f"{prefix}_diff_{m}": f"w.{m} - f.{m}", f"{prefix}_absdiff_{m}": f"abs(w.{m} - f.{m})", f"{prefix}_ndiff_{m}": f"(w.{m} - f.{m}) / (abs(w.{m}) + abs(f.{m}) + {EPS})", f"{prefix}_ratio_{m}": f"DIV(w.{m}, f.{m} + {EPS})"}
    return "SELECT " + columns(pairs, "w.id, w.scope") + f" FROM {{{source}}} w JOIN {{{source}}} f ON w.id = f.id AND f.scope = 'full' WHERE w.scope <> 'full'"


_HILO = ("p", "SELECT id, scope, PCT(value, 0.9) AS h90, PCT(value, 0.1) AS l90, PCT(value, 0.95) AS h95, PCT(value, 0.05) AS l95 FROM {x} GROUP BY id, scope")
_MASS = {}
for _q in ("90", "95"):
    _MASS |= {
        f"bl_tail_p_hi_delta_q{_q}": f"POST(avg(CASE WHEN value >= h{_q} THEN DBL(1) ELSE 0 END)) - PRE(avg(CASE WHEN value >= h{_q} THEN DBL(1) ELSE 0 END))",
        f"bl_tail_p_lo_delta_q{_q}": f"POST(avg(CASE WHEN value <= l{_q} THEN DBL(1) ELSE 0 END)) - PRE(avg(CASE WHEN value <= l{_q} THEN DBL(1) ELSE 0 END))",
        f"bl_tail_mean_excess_hi_delta_q{_q}": f"POST(avg(CASE WHEN value >= h{_q} THEN value END)) - PRE(avg(CASE WHEN value >= h{_q} THEN value END))",
        f"bl_tail_mean_excess_lo_delta_q{_q}": f"POST(avg(CASE WHEN value <= l{_q} THEN value END)) - PRE(avg(CASE WHEN value <= l{_q} THEN value END))",
    }

FAMILIES = [
    _compared("wasserstein", "wasserstein", f"sum(abs({FG}) * gap)", "area"),
    _swept("wasserstein_types", {"wasserstein": f"sum(abs({FG}) * gap)"}, x="scoped_types"),
    family("wasserstein_legacy", ("o", "SELECT id, scope, value, lead(value) OVER (PARTITION BY id, scope ORDER BY period, value) - value AS gap FROM {x}"), *sweep(), "SELECT " + columns({"wasserstein_legacy": f"sum(abs({FG}) * o.gap)"}, "o.id, o.scope") + " FROM {o} o JOIN {sw} s ON o.id = s.id AND o.scope = s.scope AND o.value = s.value GROUP BY o.id, o.scope", **X),
    _compared("energy_v", "energy", f"greatest(2 * sum({FG} * {FG} * gap), 0)", "greatest(2 * area2, 0)"),
    _compared("energy_sqrt", "energy_dist", f"sqrt(greatest(2 * sum({FG} * {FG} * gap), 0))", "sqrt(greatest(2 * area2, 0))"),
    _swept("ranksum_z", {"wilcoxon_stat": f"(sum(k0 * {RANK}) - max(n0) * ({_N} + 1) / 2) / sqrt({_NN} * ({_N} + 1) / 12)"}),
    _swept("mood_z", {"mood_stat": f"(sum(k0 * power({RANK} - (n0 + n1 + 1) / 2, 2)) - max(n0) * ({_N} * {_N} - 1) / 12) / sqrt({_NN} * ({_N} + 1) * ({_N} + 2) * ({_N} - 2) / 180)"}),
    _swept("cvm_stat", {"cvm_stat": f"({_U}) / ({_NN} * {_N}) - (4 * {_NN} - 1) / (6 * {_N})"}),
    family("ad_stat", *sweep(), *_AD_STEPS, "SELECT " + columns({"anderson_darling_stat": "(a2 - 1) / sqrt((ca * n * n * n + cb * n * n + cc * n + cd) / ((n - 1) * (n - 2) * (n - 3)))"}) + " FROM {co}", x="scoped_suppliers", seg="seg_suppliers"),
    family("levene_stat", _ROWS, ("l", "SELECT id, scope, period, DBL(count(*)) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM {r} GROUP BY id, scope, period"), ("t", "SELECT id, scope, sum(n) AS nn, sum(n * m) / sum(n) AS gm, sum(ss) AS sw FROM {l} GROUP BY id, scope"), "SELECT " + columns({"levene_stat": "DIV((max(nn) - 2) * sum(n * power(m - gm, 2)), max(sw))"}, "l.id, l.scope") + " FROM {l} l JOIN {t} t ON l.id = t.id AND l.scope = t.scope GROUP BY l.id, l.scope", **X),
    family("f_ratio", _MOMENTS, "SELECT " + columns({"f_test_stat": "DIV(V0(v), V1(v))"}) + " FROM {mo} GROUP BY id, scope", **X),
    family("cohens_d", _MOMENTS, "SELECT " + columns({"cohens_d": "(V1(mean) - V0(mean)) / (sqrt((V0(v) + V1(v)) / 2) + 1e-12)", "std_jump": "(V1(mean) - V0(mean)) / (sqrt(V0(v)) + 1e-12)"}) + " FROM {mo} GROUP BY id, scope", **X),
    family("boundary_distances", *_D2, ("loc", "SELECT id, scope, POST(avg(value)) - PRE(avg(value)) AS dm, PCTF(0.5, 1) - PCTF(0.5, 0) AS dmed FROM {x} GROUP BY id, scope", way(lambda have: _located(have["x"]), "x")), "SELECT " + columns({"bl_wasserstein": "wass", "bl_energy": "ener", "bl_wasserstein_z": "wz", "bl_energy_z": "ez", "bl_mean_delta": "dm", "bl_median_delta": "dmed"}, "d.id, d.scope") + " FROM {d} d JOIN {loc} l ON d.id = l.id AND d.scope = l.scope WHERE variant = 'raw'", **X),
    family("winsor_distances", *_D2, "SELECT " + columns({"bl_tail_wins_wasserstein": "wass", "bl_tail_wins_energy": "ener", "bl_tail_wins_wasserstein_z": "wz", "bl_tail_wins_energy_z": "ez"}) + " FROM {d} WHERE variant = 'wins'", **X),
    family("tail_distances", _QS, _VARIANTS, *_distances("v"), "SELECT " + columns({f"bl_tail_{n}_{k}": _of(k, c) for k in _CUTS for n, c in (("wasserstein", "wass"), ("energy", "ener"), ("wasserstein_z", "wz"), ("energy_z", "ez"))}) + " FROM {d} GROUP BY id, scope", **X),
    family("tail_mass", _HILO, "SELECT " + columns(_MASS, "x.id, x.scope") + " FROM {x} x JOIN {p} p ON x.id = p.id AND x.scope = p.scope GROUP BY x.id, x.scope", **X),
    family("dod_ratios", *_Z4, "SELECT " + columns({f"bl_dod_{k}_{a}_{b}": e.format(a=a, b=b) for a, b in _PAIRS for k, e in (("diff", "{a} - {b}"), ("ratio", "{a} / ({b} + 1e-12)"), ("ndiff", "({a} - {b}) / (abs({a}) + abs({b}) + 1e-12)"), ("logratio", "LN(({a} + 1e-12) / ({b} + 1e-12))"))}) + " FROM {z4}", **X),
    family("agreement", *_Z4, "SELECT " + columns({f"bl_dod_{k}_{a}_{b}": e.format(a=a, b=b) for a, b in _PAIRS for k, e in (("absdiff", "abs({a} - {b})"), ("reldiff", "abs({a} - {b}) / (abs({a}) + abs({b}) + 1e-12)"))} | {"bl_dod_outlier_sens_wassz": "wassz - wins_wassz", "bl_dod_outlier_sens_enez": "enez - wins_enez"}) + " FROM {z4}", **X),
    family("tail_bulk", _QS, _VARIANTS, *_distances("v"), "SELECT " + columns({f"bl_dod_tailbulk_{n}_{q}_both": f"{_of(q + '_both', c)} - {_of('wins', c)}" for q in ("q90", "q95") for n, c in (("wassz", "wz"), ("enez", "ez"))}) + " FROM {d} GROUP BY id, scope", **X),
    family("localization", *_Z4, localized(_FOUR, "bl_loc", "z4"), **X),
    family("dod_curve", *_Z4, curve({"wasserstein_z": "wassz", "energy_z": "enez", "wins_wasserstein_z": "wins_wassz", "wins_energy_z": "wins_enez"}, "bl_dod", "z4"), **X),
]

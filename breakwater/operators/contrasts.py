"""Quantile, scale, shape and dependence contrasts of the two segments, by scope.

``seg_*`` steps hold one row per segment; contrasts are taken in the last step. Segments are
used as they are (not scaled first), so location contrasts carry information.
"""

from __future__ import annotations

from breakwater.operators import pooled
from breakwater.plans.family import columns, family, way

X = {"x": "scoped_suppliers"}
K = "id, scope"

#: Values with their segment's mean, index and predecessor.
ROWS = ("r", "SELECT id, scope, period, seq, value, avg(value) OVER (PARTITION BY id, scope, period) AS m, DBL(row_number() OVER (PARTITION BY id, scope, period ORDER BY seq) - 1) AS t, lag(value) OVER (PARTITION BY id, scope, period ORDER BY seq) AS prev FROM {x}")
#: Moments and quantiles of each segment.
STATS = (
    "st",
    "SELECT id, scope, period, BIG(count(*)) AS n, avg(value) AS mean, stddev_pop(value) AS sd, stddev_samp(value) AS sd1, var_samp(value) AS var1, var_pop(value) AS var0, min(value) AS lo, max(value) AS hi, "
    "PCT(value, 0.05) AS q05, PCT(value, 0.1) AS q10, PCT(value, 0.25) AS q25, PCT(value, 0.5) AS med, PCT(value, 0.75) AS q75, PCT(value, 0.9) AS q90, PCT(value, 0.95) AS q95, "
    "avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4, regr_slope(value, t) AS slope, var_pop(value - prev) AS dvar, var_samp(value - prev) AS dvar1, "
    "sum((value - m) * (prev - m)) AS acov, sum((value - m) * (value - m)) AS ss, corr(value, prev) AS lag_corr FROM {r} GROUP BY id, scope, period",
    way(lambda have: pooled.statistics(have["x"]).drop("k", "mad"), "x"),
)
MADS = ("md", "SELECT x.id, x.scope, x.period, PCT(abs(value - med), 0.5) AS mad FROM {x} x JOIN {st} s ON x.id = s.id AND x.scope = s.scope AND x.period = s.period GROUP BY x.id, x.scope, x.period", way(lambda have: pooled.statistics(have["x"]).select("id", "scope", "period", "mad"), "x"))
BOTH = ("b", "SELECT s.*, mad FROM {st} s JOIN {md} m ON s.id = m.id AND s.scope = m.scope AND s.period = m.period", way(lambda have: pooled.statistics(have["x"]), "x"))
FLIPS = (
    "fl",
    "SELECT id, scope, period, CASE WHEN count(*) < 2 THEN NULL ELSE DIV(sum(CASE WHEN sg <> psg THEN 1 ELSE 0 END), count(*) - 1) END AS flips FROM (SELECT id, scope, period, sign(value) AS sg, lag(sign(value)) OVER (PARTITION BY id, scope, period ORDER BY seq) AS psg FROM {x} WHERE value <> 0) z GROUP BY id, scope, period",
)
KS = (
    "ks",
    "SELECT id, scope, max(abs(DIV(c0, n0) - DIV(c1, n1))) AS ks FROM (SELECT id, scope, sum(k0) OVER (PARTITION BY id, scope ORDER BY value) AS c0, sum(k1) OVER (PARTITION BY id, scope ORDER BY value) AS c1, sum(k0) OVER (PARTITION BY id, scope) AS n0, sum(k1) OVER (PARTITION BY id, scope) AS n1 "
    "FROM (SELECT id, scope, value, sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) AS k0, sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) AS k1 FROM {x} GROUP BY id, scope, value) g) w GROUP BY id, scope",
    way(lambda have: pooled.compared(have["x"]).select("id", "scope", "ks"), "x"),
)


def _delta(stat: str) -> str:
    return f"V1({stat}) - V0({stat})"


def _ratio(stat: str, eps: str = "1e-8") -> str:
    return f"(V1({stat}) + {eps}) / (V0({stat}) + {eps})"


def _stats(name: str, pairs: dict[str, str], *more: tuple[str, str], source: str = "st", **inputs: str):
    steps = [ROWS, STATS, *more]
    return family(name, *steps, f"SELECT {columns(pairs)} FROM {{{source}}} GROUP BY {K}", **(inputs or X))


_SKEW, _KURT = "CASE WHEN n < 3 THEN NULL ELSE DIV(m3, pow(sd, 3)) END", "CASE WHEN n < 3 THEN NULL ELSE DIV(m4, pow(sd, 4)) - 3 END"
_CV = "CASE WHEN abs(mean) < 1e-10 THEN sd ELSE DIV(sd, abs(mean)) END"
_GLOBAL = ("gl", "SELECT id, scope, avg(value) AS gmean, stddev_pop(value) AS gsd FROM {x} GROUP BY id, scope")
_CVS = (
    "cvs",
    f"SELECT s.id, s.scope, max(gmean) AS gmean, max(gsd) AS gsd, max(CASE WHEN abs(gmean) < 1e-10 THEN gsd ELSE DIV(gsd, abs(gmean)) END) AS g, V0({_CV}) AS c0, V1({_CV}) AS c1, V0(mean) AS m0, V1(mean) AS m1, V0(sd) AS s0, V1(sd) AS s1 FROM {{st}} s JOIN {{gl}} g ON s.id = g.id AND s.scope = g.scope GROUP BY s.id, s.scope",
)
_HIST = (
    "bins",
    "SELECT id, scope, period, bin, DBL(count(*)) AS k, max(width) AS width, max(n) AS n FROM (SELECT x.id, x.scope, x.period, CASE WHEN hi = lo THEN 10 ELSE least(19, BIG(floor((value - lo) / ((hi - lo) / 20)))) END AS bin, CASE WHEN hi = lo THEN DBL(1) / 20 ELSE (hi - lo) / 20 END AS width, n FROM {x} x JOIN {st} s ON x.id = s.id AND x.scope = s.scope AND x.period = s.period) z GROUP BY id, scope, period, bin",
)
_ROLL50 = (
    "rv",
    "SELECT id, scope, v, DBL(row_number() OVER (PARTITION BY id, scope ORDER BY seq)) AS t FROM (SELECT id, scope, seq, var_samp(value) OVER (PARTITION BY id, scope ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY id, scope ORDER BY seq) AS rn, count(*) OVER (PARTITION BY id, scope) AS n FROM {x} WHERE period = 1) z WHERE rn >= 50 AND n >= 100",
)
_WINDOWED = "SELECT id, w, period, value, lag(value) OVER (PARTITION BY id, w, period ORDER BY seq) AS prev FROM {seg} CROSS JOIN (VALUES (5), (20), (50), (100), (200)) AS v(w) WHERE pos <= w"
_VR = "DIV(POST(var_samp({0})) + 1e-12, PRE(var_samp({0})) + 1e-12)"

FAMILIES = [
    _stats("quantile_features", {"delta_q_slope": "abs(V1(q90 - q10) - V0(q90 - q10))", "median_shift": f"abs({_delta('med')})", "iqr_ratio": "V1(q75 - q25) / (V0(q75 - q25) + 1e-8)"}),
    _stats("quantile_deltas", {f"{q}_delta": f"abs({_delta(c)})" for q, c in (("q10", "q10"), ("q50", "med"), ("q90", "q90"))}),
    family("scale_shift", ROWS, STATS, MADS, BOTH, f"SELECT {columns({'mad_ratio': _ratio('mad'), 'iqr_ratio_robust': _ratio('q75 - q25')})} FROM {{b}} GROUP BY {K}", **X),
    family("hist_entropy", ROWS, STATS, _HIST, ("h", "SELECT id, scope, period, -sum(k / (n * width) * LN(k / (n * width))) AS h FROM {bins} GROUP BY id, scope, period"), f"SELECT {columns({'entropy_pre': 'V0(h)', 'entropy_post': 'V1(h)', 'delta_entropy': 'abs(V1(h) - V0(h))'})} FROM {{h}} GROUP BY {K}", **X),
    _stats("acf1_shift", {"acf1_shift": "abs(V1(CASE WHEN var0 < 1e-10 THEN DBL(0) ELSE DIV(acov, ss) END) - V0(CASE WHEN var0 < 1e-10 THEN DBL(0) ELSE DIV(acov, ss) END))"}),
    family("rolling_var_slope", _ROLL50, ("f", "SELECT id, scope, abs(regr_slope(v, t)) AS s FROM {rv} GROUP BY id, scope"), f"SELECT {columns({'vol_slope_post': 'coalesce(max(s), 0)'}, 'x.id, x.scope')} FROM {{x}} x LEFT JOIN {{f}} f ON x.id = f.id AND x.scope = f.scope GROUP BY x.id, x.scope", **X),
    _stats("diff_variance", {"delta_kalman_var": "abs(V1(coalesce(dvar, 0)) - V0(coalesce(dvar, 0)))"}),
    family("sign_flip_rate", FLIPS, f"SELECT {columns({'signflip_rate_pre': 'V0(flips)', 'signflip_rate_post': 'V1(flips)', 'signflip_rate_delta': _delta('flips')})} FROM {{fl}} GROUP BY {K}", x="scoped_users"),
    _stats("slope_delta", {"slope_delta": "V1(CASE WHEN n < 3 THEN NULL ELSE slope END) - V0(CASE WHEN n < 3 THEN NULL ELSE slope END)"}),
    family("ks_stat", KS, f"SELECT {columns({'ks_stat': 'ks'})} FROM {{ks}}", **X),
    family(
        "boundary_contrast", ROWS, STATS, MADS, FLIPS, KS,
        ("b", "SELECT s.*, m.mad, flips FROM {st} s JOIN {md} m ON s.id = m.id AND s.scope = m.scope AND s.period = m.period LEFT JOIN {fl} f ON s.id = f.id AND s.scope = f.scope AND s.period = f.period"),
        "SELECT " + columns({"bl_median_delta": _delta("med"), "bl_mean_delta": _delta("mean"), "bl_skew_delta": _delta(_SKEW), "bl_kurt_delta": _delta(_KURT), "bl_signflip_rate_delta": _delta("flips"), "bl_slope_delta": _delta("CASE WHEN n < 3 THEN NULL ELSE slope END"), "bl_q10_delta": _delta("q10"), "bl_q50_delta": _delta("med"), "bl_q90_delta": _delta("q90"), "bl_iqr_ratio": "V1(q75 - q25 + 1e-8) / V0(q75 - q25 + 1e-8)", "bl_mad_ratio": "V1(mad + 1e-8) / V0(mad + 1e-8)", "bl_std_ratio": "V1(sd + 1e-8) / V0(sd + 1e-8)", "bl_ks_stat": "max(ks)"}, "b.id, b.scope") + " FROM {b} b JOIN {ks} k ON b.id = k.id AND b.scope = k.scope GROUP BY b.id, b.scope",
        **X,
    ),
    family(
        "cv_features", ROWS, STATS, _GLOBAL, _CVS,
        "SELECT " + columns({
            "cv_global": "g", "cv_pre": "c0", "cv_post": "c1", "cv_diff": "c1 - c0", "cv_abs_diff": "abs(c1 - c0)", "cv_ratio": "c1 / (c0 + 1e-8)", "cv_log_ratio": "LN((c1 + 1e-8) / (c0 + 1e-8))",
            "cv_global_low": "CASE WHEN g < 0.05 THEN 1 ELSE 0 END", "cv_global_easy_neg": "CASE WHEN g >= 0.198 AND g <= 0.20 THEN 1 ELSE 0 END", "cv_global_high": "CASE WHEN g > 0.27 THEN 1 ELSE 0 END",
            "cv_stability": "1 / (1 + abs(c1 - c0))", "mean_norm_diff": "CASE WHEN abs(gmean) < 1e-10 THEN m1 - m0 ELSE DIV(m1 - m0, abs(gmean)) END",
            "cv_rolling_pre_mean": "c0", "cv_rolling_pre_std": "0", "cv_rolling_post_mean": "c1", "cv_rolling_post_std": "0",
            "snr_pre": "abs(m0) / (s0 + 1e-8)", "snr_post": "abs(m1) / (s1 + 1e-8)", "snr_diff": "abs(m1) / (s1 + 1e-8) - abs(m0) / (s0 + 1e-8)", "snr_ratio": "(abs(m1) / (s1 + 1e-8)) / (abs(m0) / (s0 + 1e-8) + 1e-8)",
            "cv_std_interaction": "g * gsd", "cv_var_over_mean": "gsd * gsd / (abs(gmean) + 1e-8)",
        }) + " FROM {cvs}",
        **X,
    ),
    family("variance_ratios", ("w", _WINDOWED), "SELECT id, " + ", ".join([*(f"R(max(CASE WHEN w = {w} THEN d END)) AS vard_ratio_w{w}" for w in (5, 20, 100)), *(f"R(max(CASE WHEN w = {w} THEN c END)) AS vard_ratio_cumsum_w{w}" for w in (20, 100))]) + f" FROM (SELECT id, w, {_VR.format('value - prev')} AS d, {_VR.format('CASE WHEN prev IS NOT NULL THEN value END')} AS c FROM {{w}} GROUP BY id, w) z GROUP BY id", seg="seg_suppliers"),
    family("iqr_ratios", ("w", _WINDOWED), ("q", "SELECT id, w, DIV(PCTF(0.75, 1) - PCTF(0.25, 1) + 1e-12, PCTF(0.75, 0) - PCTF(0.25, 0) + 1e-12) AS r FROM {w} GROUP BY id, w"), ("g", "SELECT id, (PCTF(0.9, 1) - PCTF(0.1, 1)) - (PCTF(0.9, 0) - PCTF(0.1, 0)) AS d FROM {seg} GROUP BY id"), "SELECT q.id, " + ", ".join(f"R(max(CASE WHEN w = {w} THEN r END)) AS iqr_ratio_w{w}" for w in (20, 50, 100, 200)) + ", R(max(d)) AS d_iqr_range FROM {q} q JOIN {g} g ON q.id = g.id GROUP BY q.id", seg="seg_suppliers"),
    family("rolling_stats", ("w", "SELECT id, period, avg(value) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS rm, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY seq) > 1 THEN stddev_samp(value) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) END AS rs FROM {seg}"), "SELECT id, " + ", ".join(f"R(PRE(avg({c}))) AS rolling_{n}_w16_pre_mean, R(POST(avg({c}))) AS rolling_{n}_w16_post_mean, R(POST(avg({c})) - PRE(avg({c}))) AS rolling_{n}_w16_diff" for n, c in (("mean", "rm"), ("std", "rs"))) + " FROM {w} GROUP BY id", seg="seg_suppliers"),
    family(
        "advanced_tails", ROWS, STATS, ("ex", "SELECT x.id, x.scope, x.period, DBL(sum(CASE WHEN abs(value - mean) > 3 * sd THEN 1 ELSE 0 END)) AS k FROM {x} x JOIN {st} s ON x.id = s.id AND x.scope = s.scope AND x.period = s.period GROUP BY x.id, x.scope, x.period"),
        "SELECT " + columns({"tail_q95_q05_ratio": "V1(q95 / (q05 + 1e-8)) / V0(q95 / (q05 + 1e-8))", "tail_q95_q05_diff": _delta("q95 / (q05 + 1e-8)"), "tail_kurtosis_diff": _delta(_KURT), "tail_kurtosis_ratio": f"DIV(V1({_KURT}), V0({_KURT}) + 1e-8)", "tail_extremes_ratio": "V1(k + 1) / V0(k + 1)", "tail_extremes_diff": _delta("k")}, "s.id, s.scope") .replace("V1(q95", "V1(q95") + " FROM (SELECT a.*, e.k FROM {st} a JOIN {ex} e ON a.id = e.id AND a.scope = e.scope AND a.period = e.period) s GROUP BY s.id, s.scope",
        **X,
    ),
    family(
        "simple_robust", ROWS, STATS, MADS, BOTH,
        "SELECT " + columns({f"{n}_{side}": f"V{p}({e})" for n, e in (("mean", "mean"), ("std", "sd"), ("median", "med"), ("mad", "mad"), ("min", "lo"), ("max", "hi"), ("range", "hi - lo"), ("iqr", "q75 - q25"), ("trend", "slope"), ("autocorr1", "lag_corr")) for side, p in (("pre", 0), ("post", 1))} | {"mean_diff": _delta("mean"), "std_diff": _delta("sd"), "median_diff": _delta("med"), "std_ratio": _ratio("sd"), "range_ratio": _ratio("hi - lo")}) + f" FROM {{b}} GROUP BY {K}",
        **X,
    ),
    family(
        "variance_reduction", ROWS, STATS, MADS, BOTH,
        "SELECT " + columns({"var_ratio": _ratio("var0"), "mad_ratio": _ratio("mad"), "iqr_ratio": _ratio("q75 - q25"), "range_ratio": _ratio("hi - lo"), "cv_ratio": _ratio(_CV), "diff_var_ratio": _ratio("dvar"), "max_dev_ratio": _ratio("greatest(hi - med, med - lo)"), "kurt_delta": _delta(_KURT), "skew_delta": _delta(_SKEW), "acf1_delta": _delta("DIV(acov, ss)"), "mean_shift_z": "DIV(V1(mean) - V0(mean), V0(sd))", "log_var_ratio": f"LN({_ratio('var0')})"}) + f" FROM {{b}} GROUP BY {K}",
        **X,
    ),
]

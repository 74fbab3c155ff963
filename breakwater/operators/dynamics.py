"""Autoregression, trend, CUSUM, transforms and change points, as windows and aggregates."""

from __future__ import annotations

from breakwater.operators import pooled
from breakwater.operators.contrasts import ROWS, STATS
from breakwater.operators.distances import FG, sweep
from breakwater.plans.dialect import render
from breakwater.plans.family import columns, family, way

X = {"x": "scoped_suppliers"}
S = {"seg": "seg_suppliers"}

_PHI = {
    "yw": "CASE WHEN n < 3 OR var1 < 1e-10 THEN DBL(0) ELSE acov / (n - 1) / var1 END",
    "ols": "CASE WHEN n < 3 OR pvar < 1e-10 THEN DBL(0) ELSE pcov / pvar END",
}
_AR_STATS = (
    "ar",
    "SELECT id, scope, period, DBL(count(*)) AS n, var_samp(value) AS var1, sum((value - m) * (prev - m)) AS acov, covar_pop(value, prev) AS pcov, var_samp(CASE WHEN prev IS NOT NULL THEN prev END) AS pvar, "
    "sum(CASE WHEN prev IS NOT NULL THEN value * value END) AS syy, sum(value * prev) AS sxy, sum(prev * prev) AS sxx, sum(CASE WHEN prev IS NOT NULL THEN value END) AS sy, sum(prev) AS sx, DBL(count(prev)) AS k FROM {r} GROUP BY id, scope, period",
    way(lambda have: pooled.statistics(have["x"]), "x"),
)


def _ar(name: str, phi: str, resid: str):
    fit = ("f", f"SELECT *, {resid} AS rv, CASE WHEN n < 3 THEN DBL(0) ELSE sqrt(greatest((syy - 2 * phi * sxy + phi * phi * sxx) / k, 0)) END AS rmse FROM (SELECT *, {phi} AS phi FROM {{ar}}) z")
    pairs = {}
    for stat, col in (("phi", "phi"), ("resid_var", "rv"), ("rmse", "rmse")):
        delta = "delta_ar1_phi" if stat == "phi" else f"delta_{stat}"
        pairs |= {f"ar1_{stat}_pre": f"V0({col})", f"ar1_{stat}_post": f"V1({col})", delta: f"V1({col}) - V0({col})"}
    return family(name, ROWS, _AR_STATS, fit, "SELECT " + columns(pairs) + " FROM {f} GROUP BY id, scope", **X)


#: Values clipped to the pre-segment's 1% and 99% quantiles and standardised by its moments (constant: zero).
PROCESSED = (
    ("q", "SELECT id, PCT(value, 0.01) AS lo, PCT(value, 0.99) AS hi FROM {seg} WHERE period = 0 GROUP BY id"),
    ("c", "SELECT s.id, seq, period, pos, least(greatest(value, lo), hi) AS v FROM {seg} s JOIN {q} q ON s.id = q.id"),
    ("f0", "SELECT id, avg(v) AS m, stddev_pop(v) AS sd FROM {c} WHERE period = 0 GROUP BY id"),
    ("p", "SELECT c.id, seq, period, pos, CASE WHEN sd < 1e-10 THEN DBL(0) ELSE (v - m) / sd END AS value FROM {c} c JOIN {f0} f ON c.id = f.id"),
    ("px", "SELECT id, scope, period, seq, value, avg(value) OVER (PARTITION BY id, scope, period) AS m, DBL(row_number() OVER (PARTITION BY id, scope, period ORDER BY seq) - 1) AS t, lag(value) OVER (PARTITION BY id, scope, period ORDER BY seq) AS p1, lag(value, 2) OVER (PARTITION BY id, scope, period ORDER BY seq) AS p2, count(*) OVER (PARTITION BY id, scope, period) AS n FROM (SELECT * FROM {p} CROSS JOIN (VALUES ('w25', 25), ('w50', 50), ('w100', 100), ('full', 1000000000)) AS v(scope, w) WHERE pos <= w) z"),
)
_AR1 = (
    "ar",
    "SELECT id, scope, period, DBL(count(*)) AS n, var_pop(value) AS v0, sum((value - m) * (p1 - m)) / (count(*) - 1) AS a1, sum(CASE WHEN p1 IS NOT NULL THEN value * value END) AS syy, sum(value * p1) AS sxy, sum(p1 * p1) AS sxx, sum(CASE WHEN p1 IS NOT NULL THEN value END) AS sy, sum(p1) AS sx, DBL(count(p1)) AS k, "
    "sum(p1 * p1 * CASE WHEN p2 IS NULL THEN NULL ELSE 1 END) AS b11, sum(p1 * p2) AS b12, sum(p2 * p2) AS b22, sum(value * p1 * CASE WHEN p2 IS NULL THEN NULL ELSE 1 END) AS c1, sum(value * p2) AS c2, sum(CASE WHEN p2 IS NOT NULL THEN value * value END) AS d, sum(CASE WHEN p2 IS NOT NULL THEN value END) AS e, sum(CASE WHEN p2 IS NOT NULL THEN p1 END) AS e1, sum(p2) AS e2, DBL(count(p2)) AS k2, "
    "regr_slope(value, t) AS slope, regr_intercept(value, t) AS level, sum(value) AS s, sum(value * value) AS ss, sum(t) AS st, sum(t * t) AS stt, sum(value * t) AS svt FROM {px} GROUP BY id, scope, period",
)
_PHI2 = ("fit", "SELECT *, CASE WHEN v0 < 1e-10 THEN DBL(0) ELSE greatest(least(a1 / v0, 0.999), -0.999) END AS phi, ((b22 + 1e-6) * c1 - b12 * c2) / ((b11 + 1e-6) * (b22 + 1e-6) - b12 * b12) AS g1, ((b11 + 1e-6) * c2 - b12 * c1) / ((b11 + 1e-6) * (b22 + 1e-6) - b12 * b12) AS g2 FROM {ar}")
_MSE = "({a}.syy - 2 * {p} * {a}.sxy + {p} * {p} * {a}.sxx) / {a}.k"
_MEAN = "(({a}.sy - {p} * {a}.sx) / {a}.k)"
_PAIR = " FROM {fit} a JOIN {fit} b ON a.id = b.id AND a.scope = b.scope AND a.period = 0 AND b.period = 1 WHERE a.n >= 3 AND b.n >= 2"


def _mse(side: str, phi: str) -> str:
    return f"greatest({_MSE.format(a=side, p=phi)}, 0)"


def _rv(side: str, phi: str) -> str:
    return f"greatest({_MSE.format(a=side, p=phi)} - {_MEAN.format(a=side, p=phi)} * {_MEAN.format(a=side, p=phi)}, 0)"


_R0, _R1 = _rv("a", "a.phi"), _rv("b", "b.phi")
_STABLE = "CASE WHEN g1 * g1 + 4 * g2 >= 0 THEN greatest(abs((g1 + sqrt(greatest(g1 * g1 + 4 * g2, 0))) / 2), abs((g1 - sqrt(greatest(g1 * g1 + 4 * g2, 0))) / 2)) ELSE sqrt(greatest(-g2, 0)) END < 0.999"
_E2 = "(d - 2 * g1 * c1 - 2 * g2 * c2 + g1 * g1 * b11 + 2 * g1 * g2 * b12 + g2 * g2 * b22) / k2"
_T_MSE = "greatest(({a}.ss - 2 * {f}.level * {a}.s - 2 * {f}.slope * {a}.svt + {f}.level * {f}.level * {a}.n + 2 * {f}.level * {f}.slope * {a}.st + {f}.slope * {f}.slope * {a}.stt) / {a}.n, 0)"

# CUSUM: deviations from the segment's and from the whole scope's mean, summed and put over their spread.
_CUSUM = (
    ("cs", "SELECT id, scope, period, seq, sum(value - m) OVER (PARTITION BY id, scope, period ORDER BY seq ROWS UNBOUNDED PRECEDING) AS own, sum(value - gm) OVER (PARTITION BY id, scope ORDER BY seq ROWS UNBOUNDED PRECEDING) AS whole FROM (SELECT *, avg(value) OVER (PARTITION BY id, scope, period) AS m, avg(value) OVER (PARTITION BY id, scope) AS gm FROM {x}) z"),
    ("cn", "SELECT id, scope, period, seq, CASE WHEN so > 1e-10 THEN own / so ELSE own END AS own, CASE WHEN sw > 1e-10 THEN whole / sw ELSE whole END AS whole FROM (SELECT *, stddev_pop(own) OVER (PARTITION BY id, scope, period) AS so, stddev_pop(whole) OVER (PARTITION BY id, scope) AS sw FROM {cs}) z"),
    ("cr", "SELECT *, lag(own) OVER (PARTITION BY id, scope, period ORDER BY seq) AS pown, DBL(row_number() OVER (PARTITION BY id, scope, period ORDER BY seq) - 1) AS t, row_number() OVER (PARTITION BY id, scope, period ORDER BY seq) AS up, row_number() OVER (PARTITION BY id, scope, period ORDER BY seq DESC) AS down, count(*) OVER (PARTITION BY id, scope, period) AS n, lag(whole) OVER (PARTITION BY id, scope, period ORDER BY seq) AS pwhole FROM {cn}"),
)
_CUSUM_STATS = (
    "ct",
    "SELECT id, scope, period, max(n) AS n, max(CASE WHEN down = 1 THEN own END) AS fin, max(own) AS hi, min(own) AS lo, stddev_pop(own) AS sd, sum(abs(own - pown)) AS path, max(CASE WHEN up = 1 THEN whole END) AS g1, max(CASE WHEN up = 2 THEN whole END) AS g2, max(CASE WHEN up = 3 THEN whole END) AS g3, max(CASE WHEN down = 1 THEN whole END) AS h1, max(CASE WHEN down = 2 THEN whole END) AS h2, max(CASE WHEN down = 3 THEN whole END) AS h3, "
    "max(CASE WHEN up = least(20, n) THEN whole END) AS g20, max(CASE WHEN down = least(20, n) THEN whole END) AS h20 FROM {cr} GROUP BY id, scope, period",
    way(lambda have: pooled.cusums(have["x"]), "x"),
)
_SL0, _SL1 = "V0((h1 - h20) / least(20, n))", "V1((g20 - g1) / least(20, n))"
_ELBOW = ("el", f"SELECT id, scope, {_SL0} AS s0, {_SL1} AS s1, abs(V0(h1) - 2 * V1(g1) + V1(g2)) AS curv FROM {{ct}} GROUP BY id, scope")
_DETRENDED = (
    ("cf", "SELECT id, scope, period, regr_slope(own, t) AS b, regr_intercept(own, t) AS a FROM {cr} GROUP BY id, scope, period"),
    ("e", "SELECT c.id, c.scope, c.period, own - a - b * t AS value FROM {cr} c JOIN {cf} f ON c.id = f.id AND c.scope = f.scope AND c.period = f.period"),
)
_ERROR = render("SELECT " + columns({"cusum_error_wasserstein": "area"}) + " FROM {ce}", 0)
_VOL = (
    "vol",
    "SELECT id, scope, period, max(w) AS w, stddev_pop(CASE WHEN (period = 0 AND down < w) OR (period = 1 AND up > 1 AND up <= w) THEN whole - pwhole END) AS v FROM (SELECT c.*, least(50, w.w) AS w FROM {cr} c JOIN (SELECT id, scope, min(BIG(floor(n / 4))) AS w FROM {ct} GROUP BY id, scope) w ON c.id = w.id AND c.scope = w.scope) z GROUP BY id, scope, period",
    way(lambda have: pooled.cusums(have["x"]), "x"),
)

_TRANSFORMS = {
    "cumsum": "SELECT id, seq, period, sum(value) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS value FROM {seg}",
    "diff": "SELECT id, seq, period, value FROM (SELECT id, seq, period, value - lag(value) OVER (PARTITION BY id ORDER BY seq) AS value FROM {seg}) z WHERE value IS NOT NULL",
    "rank": "SELECT id, seq, period, DBL(dense_rank() OVER (PARTITION BY id ORDER BY value)) AS value FROM {seg}",
    "abs": "SELECT id, seq, period, abs(value) AS value FROM {seg}",
    "zscore": "SELECT id, seq, period, CASE WHEN sd < 1e-10 THEN value - m ELSE (value - m) / sd END AS value FROM (SELECT *, avg(value) OVER (PARTITION BY id) AS m, stddev_pop(value) OVER (PARTITION BY id) AS sd FROM {seg}) z",
    # Half of a series below 100 points is its own window; such a series has few pairs.
    "mosum": "SELECT id, seq, period, sum(value * value) OVER (PARTITION BY id ORDER BY seq ROWS 49 PRECEDING) AS value FROM {sized} WHERE n >= 100 UNION ALL SELECT a.id, a.seq, max(a.period) AS period, sum(b.value * b.value) AS value FROM {sized} a JOIN {sized} b ON a.id = b.id WHERE a.n < 100 AND b.n < 100 AND b.seq <= a.seq AND b.seq > a.seq - floor(a.n / 2) GROUP BY a.id, a.seq",
    "raw": "SELECT id, seq, period, value FROM {seg}",
}
_SIZED = ("sized", "SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {seg}")


def transformed(seg, kind: str):
    """``id, seq, period, value`` of segments under a transform by its name."""
    steps = [_SIZED] if kind == "mosum" else []
    return family(kind, *steps, ("t", _TRANSFORMS[kind]), **S).apply(seg.sparkSession, {"seg": seg})


def _transform(kind: str):
    steps = [_SIZED] if kind == "mosum" else []
    return family(f"transform_{kind}", *steps, ("t", _TRANSFORMS[kind]), "SELECT id, seq, period, R(value) AS value FROM {t}", **S)


def _transform_stats(kind: str):
    """Eight contrasts of a transformed series."""
    pick = ("q", "SELECT id, period, avg(value) AS mean, stddev_pop(value) AS sd, PCT(value, 0.5) AS med, PCT(value, 0.1) AS q10, PCT(value, 0.9) AS q90 FROM {t} GROUP BY id, period")
    w = ("w", f"SELECT id, sum(abs({FG}) * gap) AS wass, sqrt(greatest(2 * sum({FG} * {FG} * gap), 0)) AS ener FROM {{sw}} GROUP BY id")
    pairs = {"mean_diff": "V1(mean) - V0(mean)", "std_ratio": "V1(sd) / (V0(sd) + 1e-8)", "median_diff": "V1(med) - V0(med)", "q10_diff": "V1(q10) - V0(q10)", "q50_diff": "V1(med) - V0(med)", "q90_diff": "V1(q90) - V0(q90)", "wasserstein": "max(wass)", "energy": "max(ener)"}
    return family(f"transform_stats_{kind}", ("t", _TRANSFORMS[kind]), pick, *sweep("t", "id"), w, "SELECT " + columns({f"{k}_{kind}": v for k, v in pairs.items()}, "q.id") + " FROM {q} q JOIN {w} w ON q.id = w.id GROUP BY q.id", **S)


_PATTERN = ("pt", "SELECT id, period, CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN c < a AND a <= b THEN 3 WHEN b <= c AND c < a THEN 4 ELSE 5 END AS pat FROM (SELECT id, period, value AS a, lead(value) OVER (PARTITION BY id, period ORDER BY seq) AS b, lead(value, 2) OVER (PARTITION BY id, period ORDER BY seq) AS c FROM {seg}) z WHERE c IS NOT NULL")
_PE = ("pe", "SELECT id, period, -sum(k / n * LN(k / n)) AS h FROM (SELECT id, period, k, sum(k) OVER (PARTITION BY id, period) AS n FROM (SELECT id, period, pat, DBL(count(*)) AS k FROM {pt} GROUP BY id, period, pat) y) z GROUP BY id, period")
_SPLITS = ("sp", "SELECT id, seq, n, s2n - sn * sn / n AS total, s2 - s1 * s1 / seq + (s2n - s2) - (sn - s1) * (sn - s1) / (n - seq) AS cost FROM (SELECT id, seq, sum(value) OVER w AS s1, sum(value * value) OVER w AS s2, sum(value) OVER (PARTITION BY id) AS sn, sum(value * value) OVER (PARTITION BY id) AS s2n, count(*) OVER (PARTITION BY id) AS n FROM {seg} WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)) z WHERE seq < n AND seq % 5 = 0 AND seq >= 2 AND n - seq >= 2")

FAMILIES = [
    _ar("ar1_yw", _PHI["yw"], "CASE WHEN n < 3 THEN DBL(0) ELSE greatest(var1 * (1 - phi * phi), 0) END"),
    _ar("ar1_ols", _PHI["ols"], "CASE WHEN n < 3 THEN DBL(0) ELSE greatest((syy - 2 * phi * sxy + phi * phi * sxx - (sy - phi * sx) * (sy - phi * sx) / k) / (k - 1), 0) END"),
    family("ar1_cross", *PROCESSED, _AR1, _PHI2, "SELECT " + columns({"ar1_phi_pre": "a.phi", "ar1_phi_post": "b.phi", "ar1_delta_phi": "b.phi - a.phi", "ar1_resid_var_pre": _R0, "ar1_resid_var_post": _R1, "ar1_log_resid_var_ratio": f"CASE WHEN {_R0} > 1e-10 THEN LN({_R1} / ({_R0} + 1e-10)) END", "ar1_rmse_pre": f"sqrt({_mse('a', 'a.phi')})", "ar1_rmse_post": f"sqrt({_mse('b', 'b.phi')})", "ar1_rmse_cross_pred": f"sqrt({_mse('b', 'a.phi')})", "ar1_resid_var_cross_pred": _rv("b", "a.phi"), "ar1_delta_rmse_cross": f"sqrt({_mse('b', 'a.phi')}) - sqrt({_mse('a', 'a.phi')})"}, "a.id, a.scope") + _PAIR, **S),
    family("ar2_ridge", *PROCESSED, _AR1, _PHI2, "SELECT " + columns({"ar2_phi1_pre": f"CASE WHEN {_STABLE} THEN g1 ELSE phi END", "ar2_phi2_pre": f"CASE WHEN {_STABLE} THEN g2 ELSE 0 END", "ar2_rmse_pre": f"CASE WHEN {_STABLE} THEN sqrt(greatest({_E2}, 0)) ELSE sqrt({_mse('a', 'a.phi')}) END", "ar2_resid_var_pre": f"CASE WHEN {_STABLE} THEN greatest({_E2} - power((e - g1 * e1 - g2 * e2) / k2, 2), 0) ELSE {_R0} END"}, "id, scope") + " FROM {fit} a WHERE period = 0 AND n >= 5", **S),
    family("linear_trend", *PROCESSED, _AR1, _PHI2, "SELECT " + columns({"trend_slope_pre": "a.slope", "trend_slope_post": "b.slope", "trend_delta_slope": "b.slope - a.slope", "trend_rmse_pre": f"sqrt({_T_MSE.format(a='a', f='a')})", "trend_rmse_post": f"sqrt({_T_MSE.format(a='b', f='b')})", "trend_rmse_cross": f"sqrt({_T_MSE.format(a='b', f='a')})", "trend_mean_error_cross": "(b.s - a.level * b.n - a.slope * b.st) / b.n"}, "a.id, a.scope") + _PAIR, **S),
    family("cusum_features", *_CUSUM, _CUSUM_STATS, "SELECT " + columns({f"cusum_{s}_{k}": f"V{p}({e})" for p, s in ((0, "pre"), (1, "post")) for k, e in (("final", "fin"), ("max", "hi"), ("min", "lo"), ("range", "hi - lo"), ("std", "sd"), ("path_length", "coalesce(path, 0)"))} | {"cusum_range_diff": "V1(hi - lo) - V0(hi - lo)", "cusum_std_diff": "V1(sd) - V0(sd)", "cusum_path_length_ratio": "V1(coalesce(path, 0)) / (V0(coalesce(path, 0)) + 1e-8)", "cusum_global_jump": "V1(g1) - V0(h1)", "cusum_global_pre_final": "V0(h1)", "cusum_global_post_first": "V1(g1)"}) + " FROM {ct} GROUP BY id, scope", **X),
    family("cusum_elbow", *_CUSUM, _CUSUM_STATS, _ELBOW, "SELECT " + columns({"elbow_sharpness": "abs(s1 - s0)", "elbow_curvature": "curv", "elbow_category": "CASE WHEN abs(s0) < 0.05 AND abs(s1) < 0.05 THEN 0 WHEN abs(s1) < 0.05 THEN CASE WHEN s0 > 0 THEN 1 ELSE 2 END WHEN abs(s0) < 0.05 THEN CASE WHEN s1 > 0 THEN 3 ELSE 4 END WHEN s0 > 0 AND s1 > 0 THEN 3 WHEN s0 < 0 AND s1 < 0 THEN 4 WHEN s0 > 0 THEN 6 ELSE 5 END"}) + " FROM {el}", **X),
    family("cusum_error", *_CUSUM, *_DETRENDED, *sweep("e"), ("result", "SELECT " + columns({"cusum_error_wasserstein": f"sum(abs({FG}) * gap)"}) + " FROM {sw} GROUP BY id, scope", way(lambda have: have["x"].sparkSession.sql(_ERROR, ce=pooled.cusum_errors(have["x"])), "x")), **X),
    family("cusum_boundary_vol", *_CUSUM, _CUSUM_STATS, _VOL, "SELECT " + columns({"cusum_boundary_vol_pre": "CASE WHEN max(w) > 5 THEN V0(v) ELSE 0 END", "cusum_boundary_vol_post": "CASE WHEN max(w) > 5 THEN V1(v) ELSE 0 END", "cusum_boundary_vol_ratio": "CASE WHEN max(w) > 5 THEN V1(v) / (V0(v) + 1e-8) ELSE 1 END"}) + " FROM {vol} GROUP BY id, scope", **X),
    *(_transform(k) for k in ("cumsum", "diff", "rank", "abs", "zscore", "mosum")),
    *(_transform_stats(k) for k in ("raw", "cumsum", "diff")),
    family("perm_entropy", _PATTERN, _PE, "SELECT " + columns({"perm_entropy_pre": "V0(h)", "perm_entropy_post": "V1(h)", "perm_entropy_ratio": "DIV(V1(h), V0(h) + 1e-8)", "perm_entropy_diff": "V1(h) - V0(h)"}, "id") + " FROM {pe} GROUP BY id", **S),
    family("binseg_split", _SPLITS, "SELECT id, BIG(MINBY(seq, cost)) AS binseg_l2_cp, R(MINBY(seq, cost) / DBL(max(n))) AS binseg_l2_cp_pos, R(abs(MINBY(seq, cost) / DBL(max(n)) - 0.5)) AS binseg_l2_cp_from_mid FROM {sp} GROUP BY id", **S),
    family("segment_stats", ROWS, STATS, "SELECT " + columns({"cp_mean_diff": "V1(mean) - V0(mean)", "cp_mean_ratio": "DIV(V1(mean), V0(mean) + 1e-8)", "cp_var_diff": "V1(var0) - V0(var0)", "cp_var_ratio": "DIV(V1(var0), V0(var0) + 1e-8)", "cp_range_diff": "V1(hi - lo) - V0(hi - lo)"}) + " FROM {st} GROUP BY id, scope", **X),
]

"""Smoothing, the local-level filter, and the autoregression, filter and trend blocks.

Autoregression and trend statistics are closed forms of a few moments of each segment, so one
aggregation gives all scopes. The filter is a fold over a segment's array; its state is four
numbers, so its errors are summed as they arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.plans.family import columns, dealt, family, kept, spread

#: Process variances that the filter chooses from, in units of the noise; ten to the powers from -3 to 0.
GRID = tuple(10.0 ** (-3 + 0.75 * i) for i in range(5))
WINDOWS = (25, 50, 100)
ALPHA = 2 / 21
#: Points that a scan takes in one array before it joins them to the others.
CHUNK = 256
SCOPES = "(VALUES ('full', 1073741824), " + ", ".join(f"('w{w}', {w})" for w in WINDOWS) + ") AS g(scope, w)"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(xs: Column, start: Column, step) -> Column:
    """The states of a fold over an array: ``step(state, x)`` is the next. Linear in the array's length up to some 100,000 points."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: F.slice(xs, i * CHUNK + 1, CHUNK))
    none = F.struct(start.alias("s"), F.filter(F.array(start), lambda s: F.lit(False)).alias("out"))
    inner = lambda acc, x: _let(step(acc["s"], x), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")))
    outer = lambda acc, c: _let(F.aggregate(c, F.struct(acc["s"].alias("s"), none["out"].alias("out")), inner), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], r["out"]).alias("out")))
    return F.aggregate(chunks, none, outer)["out"]


def _smoothed(seg: DataFrame) -> DataFrame:
    """``id, seq, period, value, m, v, s2`` of the joined series: level, spread and squared weights of exponential smoothing."""
    points = dealt(seg).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "period", F.col("value").cast("double").alias("value")))).alias("xs"))
    first = F.get("xs", F.lit(0))
    start = F.struct(first["seq"].alias("seq"), first["period"].alias("period"), first["value"].alias("value"), first["value"].alias("m"), F.lit(0.0).alias("v"), F.lit(None).cast("double").alias("s2"))

    def step(a: Column, x: Column) -> Column:
        gap = x["value"] - a["m"]
        later = a["s2"].isNotNull()
        s2 = F.when(later, (1 - ALPHA) ** 2 * a["s2"] + ALPHA**2).otherwise(1.0)
        return F.struct(x["seq"].alias("seq"), x["period"].alias("period"), x["value"].alias("value"), (a["m"] + ALPHA * gap).alias("m"), ((1 - ALPHA) * (a["v"] + ALPHA * gap * gap)).alias("v"), s2.alias("s2"))

    return points.select("id", F.explode(scanned(F.col("xs"), start, step)).alias("p")).select("id", "p.*")


_JOINED = ("e", f"SELECT id, seq, period, value, value AS m, DBL(0) AS v, DBL(1) AS s2 FROM {{seg}} WHERE seq = 1 UNION ALL SELECT s.id, s.seq, s.period, s.value, e.m + {ALPHA!r} * (s.value - e.m) AS m, (1 - {ALPHA!r}) * (e.v + {ALPHA!r} * power(s.value - e.m, 2)) AS v, power(1 - {ALPHA!r}, 2) * e.s2 + {ALPHA!r} * {ALPHA!r} AS s2 FROM {{e}} e JOIN {{seg}} s ON s.id = e.id AND s.seq = e.seq + 1", lambda have: _smoothed(have["seg"]))
#: Level, and the residual over its smoothed spread (no value at the first point).
_BOTH = ("b", "SELECT id, period, 'ewma' AS kind, m AS value FROM {e} UNION ALL SELECT id, period, 'residual' AS kind, (value - m) / (sqrt(v / (1 - s2)) + 1e-8) AS value FROM {e} WHERE s2 < 1")
_BOTH_STATS = ("bs", "SELECT id, kind, PRE(count(value)) AS n0, POST(count(value)) AS n1, POST(avg(value)) - PRE(avg(value)) AS dm, POST(stddev_pop(value)) / (PRE(stddev_pop(value)) + 1e-8) AS ds, PCTF(0.5, 1) - PCTF(0.5, 0) AS dq FROM {b} GROUP BY id, kind")
_EWMA = {f"{n}_{k}": f"max(CASE WHEN kind = '{k}' AND n0 >= 5 AND n1 >= 5 THEN {c} END)" for k in ("ewma", "residual") for n, c in (("mean_diff", "dm"), ("std_ratio", "ds"), ("median_diff", "dq"))}

# Both segments clipped to the first one's outer percentiles and standardised by it; as they are if that has under three points.
_ENDS = ("cq", "SELECT id, PRE(count(*)) AS n0, POST(count(*)) AS n1, PCTF(0.01, 0) AS lo, PCTF(0.99, 0) AS hi FROM {seg} GROUP BY id")
_CLIPPED = ("cz", "SELECT s.id, seq, period, pos, n0, n1, CASE WHEN n0 >= 3 THEN least(greatest(value, lo), hi) ELSE value END AS value FROM {seg} s JOIN {cq} q ON s.id = q.id")
_CENTRE = ("cm", "SELECT id, PRE(avg(value)) AS m, PRE(stddev_pop(value)) AS sd FROM {cz} GROUP BY id")
_Z = kept(("z", "SELECT c.id, seq, period, pos, n0, n1, CASE WHEN n0 < 3 THEN value WHEN sd < 1e-10 THEN 0 ELSE (value - m) / sd END AS value FROM {cz} c JOIN {cm} m ON c.id = m.id"))
_STANDARD = (_ENDS, _CLIPPED, _CENTRE, _Z)


def _fits(source: str, keys: str, least: str) -> tuple[tuple, ...]:
    """Step ``ft``: the process variance ``q`` of the grid with the least Gaussian loss of an array ``a``, and its innovation variance ``v``.

    All fits of an array stand in its row, so nothing is grouped or joined. No step filters on a
    fit, as the filter would be pushed below it and fold the array again.
    """
    each = lambda text: ", ".join(text.replace("#", str(i)) for i in range(len(GRID)))
    pick = lambda values: "CASE " + " ".join(f"WHEN l{i} = best THEN {v}" for i, v in enumerate(values)) + " END"
    fits = ", ".join(f"FILTER(a, DBL({q!r}), 1) AS s{i}" for i, q in enumerate(GRID))
    return (
        ("fs", f"SELECT {keys}, DBL(LEN(a) - 1) AS n, {fits} FROM {{{source}}} WHERE {least}"),
        ("fv", f"SELECT {keys}, n, {each('s#.s2 AS t#')}, {each('s#.s2 / n - power(s#.s1 / n, 2) AS v#')} FROM {{fs}}"),
        ("fl", f"SELECT {keys}, {each('v#')}, {each('CASE WHEN v# > 1e-20 THEN t# / v# / 2 + n * LN(v#) / 2 END AS l#')} FROM {{fv}}"),
        ("fm", f"SELECT *, least({each('l#')}) AS best FROM {{fl}}"),
        ("ft", f"SELECT {keys}, {pick([f'DBL({q!r})' for q in GRID])} AS q, {pick([f'v{i}' for i in range(len(GRID))])} AS v FROM {{fm}}"),
    )


_ARRAYS = spread(("ka", f"SELECT id, scope, w, SERIES(value, seq, period = 0) AS a, SERIES(value, seq, period = 1) AS b FROM {{z}} CROSS JOIN {SCOPES} WHERE pos <= w AND (scope = 'full' OR (n0 >= w AND n1 >= w)) GROUP BY id, scope, w"), "z")
_KALMAN = (
    _ARRAYS,
    *_fits("ka", "id, scope, b", "LEN(a) >= 3 AND LEN(b) >= 2"),
    ("kp", "SELECT id, scope, q, v, DBL(LEN(b) - 1) AS n, FILTER(b, q, 1) AS s FROM {ft}"),
    ("kv", "SELECT id, scope, q, v AS before, s.s2 / n - power(s.s1 / n, 2) AS after, sqrt(s.s2 / n) AS rmse FROM {kp}"),
    ("kl", "SELECT id, scope, q, before, after, rmse, CASE WHEN before > 1e-10 AND after > 1e-12 THEN LN(after / (before + 1e-10)) END AS lr FROM {kv}"),
)
_ALL_IDS = ("ids", "SELECT DISTINCT id FROM {seg}")


def _at(scope: str, column: str) -> str:
    return f"max(CASE WHEN scope = '{scope}' THEN {column} END)"


_KF = {"kf_process_var_pre": _at("full", "q"), "kf_innov_var_pre": _at("full", "before"), "kf_innov_var_post": _at("full", "after"), "kf_log_innov_var_ratio": _at("full", "lr"), "kf_rmse_cross_pred": _at("full", "rmse"), "kf_innov_var_cross_pred": _at("full", "after")}
for _w in WINDOWS:
    _KF |= {f"kf_{n}_w{_w}": _at(f"w{_w}", c) for n, c in (("innov_var_pre", "before"), ("innov_var_post", "after"), ("log_innov_var_ratio", "lr"), ("rmse_cross", "rmse"))}

# Moments of a scoped segment: of values, of pairs with the value before, of triples, and against the place t in the window.
_SCOPED = ("zw", f"SELECT id, scope, period, n0, n1, value, CASE WHEN period = 0 THEN least(w, n0) - pos ELSE pos - 1 END AS t, p1, p2 FROM (SELECT *, lag(value) OVER (PARTITION BY id, period ORDER BY seq) AS p1, lag(value, 2) OVER (PARTITION BY id, period ORDER BY seq) AS p2 FROM {{z}}) y CROSS JOIN {SCOPES} WHERE pos <= w AND (scope = 'full' OR (n0 >= w AND n1 >= w)) AND n0 >= 3 AND n1 >= 2")
_PAIR = "CASE WHEN t >= 1 THEN {} END"
_TRIPLE = "CASE WHEN t >= 2 THEN {} END"
_SUMS = {
    "n": "DBL(count(*))", "m": "avg(value)", "vp": "var_pop(value)", "vs": "var_samp(value)",
    "k": f"DBL(count({_PAIR.format('1')}))", "sz": f"sum({_PAIR.format('value')})", "sp": f"sum({_PAIR.format('p1')})", "szz": f"sum({_PAIR.format('value * value')})", "spp": f"sum({_PAIR.format('p1 * p1')})", "szp": f"sum({_PAIR.format('value * p1')})",
    "k2": f"DBL(count({_TRIPLE.format('1')}))", "y": f"sum({_TRIPLE.format('value')})", "a": f"sum({_TRIPLE.format('p1')})", "b": f"sum({_TRIPLE.format('p2')})", "yy": f"sum({_TRIPLE.format('value * value')})", "aa": f"sum({_TRIPLE.format('p1 * p1')})", "bb": f"sum({_TRIPLE.format('p2 * p2')})", "ab": f"sum({_TRIPLE.format('p1 * p2')})", "ay": f"sum({_TRIPLE.format('p1 * value')})", "by_": f"sum({_TRIPLE.format('p2 * value')})",
    "st": "sum(DBL(t))", "stt": "sum(DBL(t) * t)", "s1": "sum(value)", "s2": "sum(value * value)", "stz": "sum(value * t)", "vd": f"var_samp({_PAIR.format('value - p1')})",
}
_MOMENTS = kept(("mo", "SELECT id, scope, period, " + ", ".join(f"{e} AS {n}" for n, e in _SUMS.items()) + " FROM {zw} GROUP BY id, scope, period"))
#: Autoregression of order one, inside the unit circle, and the least-squares line, of each segment.
_FITTED = (
    "fi",
    "SELECT *, CASE WHEN n < 3 OR vp < 1e-10 THEN DBL(0) ELSE greatest(least((szp - m * sz - m * sp + k * m * m) / (n - 1) / vp, 0.999), -0.999) END AS phi, "
    "(n * stz - st * s1) / nullif(n * stt - st * st, 0) AS slope, (s1 - (n * stz - st * s1) / nullif(n * stt - st * st, 0) * st) / n AS level FROM {mo}",
)
#: Both segments side by side.
_SIDES = ("sd", "SELECT p.id, p.scope, " + ", ".join(f"{s}.{c} AS {c}{i}" for i, s in ((0, "p"), (1, "q")) for c in (*_SUMS, "phi", "slope", "level")) + " FROM {fi} p JOIN {fi} q ON p.id = q.id AND p.scope = q.scope AND p.period = 0 AND q.period = 1")


def _ms(phi: str, i: int) -> str:
    """Mean square of one-step errors of a segment."""
    return f"greatest((szz{i} - 2 * {phi} * szp{i} + {phi} * {phi} * spp{i}) / k{i}, 0)"


def _mean(phi: str, i: int) -> str:
    return f"((sz{i} - {phi} * sp{i}) / k{i})"


def _spread(phi: str, i: int) -> str:
    return f"greatest({_ms(phi, i)} - power({_mean(phi, i)}, 2), 0)"


def _off(level: str, slope: str, i: int) -> str:
    """Mean square of a segment's distances from a line."""
    return f"greatest((s2{i} + n{i} * {level} * {level} + {slope} * {slope} * stt{i} - 2 * {level} * s1{i} - 2 * {slope} * stz{i} + 2 * {level} * {slope} * st{i}) / n{i}, 0)"


_RIDGE = (
    ("rg", "SELECT id, phi0, k20, y0, a0, b0, yy0, aa0 + 1e-6 AS aa, bb0 + 1e-6 AS bb, ab0 AS ab, aa0, bb0, ay0, by_0, sqrt(" + _ms("phi0", 0) + ") AS rmse1, " + _spread("phi0", 0) + " AS sp1 FROM {sd} WHERE scope = 'full'"),
    ("rs", "SELECT *, (bb * ay0 - ab * by_0) / (aa * bb - ab * ab) AS g1, (aa * by_0 - ab * ay0) / (aa * bb - ab * ab) AS g2 FROM {rg}"),
    ("ro", "SELECT *, CASE WHEN g1 * g1 + 4 * g2 >= 0 THEN (abs(g1) + sqrt(g1 * g1 + 4 * g2)) / 2 ELSE sqrt(-g2) END AS top, (yy0 - 2 * g1 * ay0 - 2 * g2 * by_0 + g1 * g1 * aa0 + g2 * g2 * bb0 + 2 * g1 * g2 * ab) / k20 AS ms, (y0 - g1 * a0 - g2 * b0) / k20 AS me FROM (SELECT * FROM {rs}) z"),
    ("r2", "SELECT id, CASE WHEN k20 >= 3 THEN CASE WHEN top >= 0.999 THEN phi0 ELSE g1 END END AS phi1, CASE WHEN k20 >= 3 THEN CASE WHEN top >= 0.999 THEN 0 ELSE g2 END END AS phi2, CASE WHEN k20 >= 3 THEN CASE WHEN top >= 0.999 THEN sp1 ELSE greatest(ms - me * me, 0) END END AS spread, CASE WHEN k20 >= 3 THEN CASE WHEN top >= 0.999 THEN rmse1 ELSE sqrt(greatest(ms, 0)) END END AS rmse FROM {ro}"),
)
_BLOCK_COLUMNS = (
    "bc",
    "SELECT id, scope, phi0, phi1, " + _spread("phi0", 0) + " AS rv0, " + _spread("phi1", 1) + " AS rv1, sqrt(" + _ms("phi0", 0) + ") AS rm0, sqrt(" + _ms("phi1", 1) + ") AS rm1, sqrt(" + _ms("phi0", 1) + ") AS rmx, " + _spread("phi0", 1) + " AS rvx, "
    "slope0, slope1, sqrt(" + _off("level0", "slope0", 0) + ") AS to0, sqrt(" + _off("level1", "slope1", 1) + ") AS to1, sqrt(" + _off("level0", "slope0", 1) + ") AS tox, (s11 - n1 * level0 - slope0 * st1) / n1 AS drift FROM {sd}",
)
_AR = {
    "ar1_phi_pre": "phi0", "ar1_phi_post": "phi1", "ar1_delta_phi": "phi1 - phi0", "ar1_resid_var_pre": "rv0", "ar1_resid_var_post": "rv1", "ar1_log_resid_var_ratio": "CASE WHEN rv0 > 1e-10 AND rv1 > 1e-12 THEN LN(rv1 / (rv0 + 1e-10)) END",
    "ar1_rmse_pre": "rm0", "ar1_rmse_post": "rm1", "ar1_rmse_cross_pred": "rmx", "ar1_resid_var_cross_pred": "rvx", "ar1_delta_rmse_cross": "rmx - rm0",
    "trend_slope_pre": "slope0", "trend_slope_post": "slope1", "trend_delta_slope": "slope1 - slope0", "trend_rmse_pre": "to0", "trend_rmse_post": "to1", "trend_rmse_cross": "tox", "trend_mean_error_cross": "drift",
}
_BLOCK = {n: _at("full", e) for n, e in _AR.items()} | {n: f"max({e})" for n, e in (("ar2_phi1_pre", "r.phi1"), ("ar2_phi2_pre", "r.phi2"), ("ar2_resid_var_pre", "r.spread"), ("ar2_rmse_pre", "r.rmse"))}
for _w in WINDOWS:
    _BLOCK |= {f"{n}_w{_w}": _at(f"w{_w}", e) for n, e in (("ar1_phi_pre", "c.phi0"), ("ar1_phi_post", "c.phi1"), ("ar1_delta_phi", "c.phi1 - c.phi0"), ("ar1_rmse_pre", "rm0"), ("ar1_rmse_cross", "rmx"), ("trend_slope_pre", "slope0"), ("trend_slope_post", "slope1"), ("trend_delta_slope", "slope1 - slope0"), ("trend_rmse_cross", "tox"))}
for _n in ("ar1_phi_pre", "ar1_phi_post", "ar1_delta_phi"):
    _BLOCK[_n] = _BLOCK[_n].replace("phi0", "c.phi0").replace("phi1", "c.phi1")
_KFW = {n: e for n, e in _KF.items()}


def _put_together(pairs: dict[str, str], source: str, keys: str = "id") -> str:
    return "SELECT " + ", ".join(["x.id", *(f"R({n}) AS {n}" for n in pairs)]) + f" FROM {{ids}} x LEFT JOIN {{{source}}} y ON x.id = y.id"


# The second variant: noise from moments, samples' variances, windows standardised by themselves.
_E_FULL = ("ef", "SELECT c.id, 'full' AS scope, seq, period, pos, n0, n1, (value - m) / sd AS value, 1073741824 AS w FROM {cz} c JOIN (SELECT id, PRE(avg(value)) AS m, PRE(stddev_samp(value)) AS sd FROM {cz} GROUP BY id) m ON c.id = m.id WHERE n0 >= 3 AND n1 >= 3 AND sd >= 1e-8")
_E_WINDOW = ("ew", f"SELECT s.id, scope, seq, period, pos, value, w FROM {{seg}} s CROSS JOIN {SCOPES} WHERE scope <> 'full' AND pos <= w")
_E_CENTRE = ("ec", "SELECT id, scope, PRE(count(*)) AS n0, POST(count(*)) AS n1, PRE(avg(value)) AS m, PRE(stddev_samp(value)) AS sd FROM {ew} GROUP BY id, scope")
_E_ALL = ("ea", "SELECT id, scope, seq, period, pos, n0, value, w FROM {ef} UNION ALL SELECT e.id, e.scope, seq, period, pos, n0, (value - m) / sd AS value, w FROM {ew} e JOIN {ec} c ON e.id = c.id AND e.scope = c.scope WHERE n0 >= 3 AND n1 >= 3 AND sd >= 1e-8")
_E_SCOPED = ("zw", "SELECT id, scope, period, value, CASE WHEN period = 0 THEN least(w, n0) - pos ELSE pos - 1 END AS t, lag(value) OVER (PARTITION BY id, scope, period ORDER BY seq) AS p1, lag(value, 2) OVER (PARTITION BY id, scope, period ORDER BY seq) AS p2 FROM {ea}")
_E_FITTED = ("fi", "SELECT *, DBL(0) AS slope, DBL(0) AS level, CASE WHEN vs < 1e-10 THEN DBL(0) ELSE (szp - m * sz - m * sp + k * m * m) / k / vs END AS phi FROM {mo}")


def _sample_spread(phi: str, i: int) -> str:
    return f"(k{i} / nullif(k{i} - 1, 0) * {_spread(phi, i)})"


_E_COLUMNS = (
    "bc",
    "SELECT id, scope, phi0, phi1, CASE WHEN vs0 < 1e-10 THEN vs0 ELSE greatest(vs0 * (1 - phi0 * phi0), 0) END AS rv0, CASE WHEN vs1 < 1e-10 THEN vs1 ELSE greatest(vs1 * (1 - phi1 * phi1), 0) END AS rv1, "
    "sqrt(" + _ms("phi0", 0) + ") AS rm0, sqrt(" + _ms("phi1", 1) + ") AS rm1, sqrt(" + _ms("phi0", 1) + ") AS rmx, " + _sample_spread("phi0", 1) + " AS rvx, "
    "vd0 / 2 AS r0, greatest(vs0 - vd0 / 2, vd0 / 20) AS q0, vd1 / 2 AS r1, greatest(vs1 - vd1 / 2, vd1 / 20) AS q1, n0, n1 FROM {sd}",
)
_E_FILTER = (
    spread(("eb", "SELECT id, SERIES(value, seq, period = 0) AS a, SERIES(value, seq, period = 1) AS b FROM {ea} WHERE scope = 'full' GROUP BY id"), "ea"),
    ("eg", "SELECT b.id, LEN(a) - DBL(1) AS n, LEN(b) - DBL(1) AS m, FILTER(a, q0, r0) AS s, FILTER(b, q1, r1) AS u, FILTER(b, q0, r0) AS x FROM {eb} b JOIN {bc} c ON b.id = c.id AND scope = 'full' WHERE r0 > 0 AND r1 > 0 AND n0 > 3 AND n1 > 3"),
    ("ek", "SELECT id, (s.s2 - s.s1 * s.s1 / n) / (n - 1) AS v0, (u.s2 - u.s1 * u.s1 / m) / (m - 1) AS v1, sqrt(s.s2 / n) AS e0, sqrt(x.s2 / m) AS ex FROM {eg}"),
)


def _log(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} > 1e-10 AND {b} > 1e-10 THEN LN({b} / {a}) ELSE 0 END"


_E = {"ar1_phi_pre": "phi0", "ar1_phi_post": "phi1", "delta_ar1_phi": "abs(phi1 - phi0)", "ar1_resid_var_pre": "rv0", "ar1_resid_var_post": "rv1", "log_resid_var_ratio": _log("rv0", "rv1"), "ar1_rmse_pre": "rm0", "ar1_rmse_post": "rm1", "delta_ar1_rmse": "abs(rm1 - rm0)", "rmse_post_pred_by_pre": "rmx", "resid_var_post_pred_by_pre": "rvx"}
_E = {n: _at("full", e) for n, e in _E.items()} | {n: f"max({e})" for n, e in (("kalman_innov_var_pre", "k.v0"), ("kalman_innov_var_post", "k.v1"), ("log_kalman_innov_ratio", _log("k.v0", "k.v1")), ("kalman_rmse_pre", "k.e0"), ("kalman_rmse_post_pred_by_pre", "k.ex"))}
for _w in WINDOWS:
    _E |= {f"{n}_w{_w}": _at(f"w{_w}", e) for n, e in (("ar1_phi_pre", "phi0"), ("ar1_phi_post", "phi1"), ("delta_ar1_phi", "abs(phi1 - phi0)"), ("ar1_rmse_pre", "rm0"), ("rmse_post_pred_by_pre", "rmx"), ("delta_ar1_rmse", "abs(rm1 - rm0)"))}

_GRID_ARRAYS = spread(("ga", "SELECT id, period, SERIES(value, seq, period >= 0) AS a FROM {z} GROUP BY id, period"), "z")
_GRID = {"kf_grid_process_var_pre": "V0(q)", "kf_grid_process_var_post": "V1(q)", "kf_grid_innov_var_pre": "V0(v)", "kf_grid_innov_var_post": "V1(v)"}


def _wide(name: str, pairs: dict[str, str], source: str) -> tuple[str, str]:
    return (name, "SELECT c.id, " + ", ".join(f"{e} AS {n}" for n, e in pairs.items()) + f" FROM {source} GROUP BY c.id")


FAMILIES = [
    family("transform_ewma", _JOINED, _BOTH, _BOTH_STATS, "SELECT " + columns(_EWMA, "id") + " FROM {bs} GROUP BY id"),
    family("kalman_local_level", *_STANDARD, *_KALMAN, _ALL_IDS, _wide("kw", _KF, "{kl} c"), _put_together(_KF, "kw")),
    family("kalman_grid", *_STANDARD, _GRID_ARRAYS, *_fits("ga", "id, period", "LEN(a) >= 3"), _ALL_IDS, _wide("gw", _GRID, "{ft} c"), _put_together(_GRID, "gw")),
    family("ar_kalman_block", *_STANDARD, _SCOPED, _MOMENTS, _FITTED, _SIDES, _BLOCK_COLUMNS, *_RIDGE, _wide("aw", _BLOCK, "{bc} c LEFT JOIN {r2} r ON c.id = r.id"), *_KALMAN, _wide("kw", _KF, "{kl} c"), _ALL_IDS, ("bw", "SELECT x.id, " + ", ".join([*_BLOCK, *_KF]) + " FROM {ids} x LEFT JOIN {aw} a ON x.id = a.id LEFT JOIN {kw} k ON x.id = k.id"), _put_together(_BLOCK | _KF, "bw")),
    family("ar_kalman_estimated", _ENDS, _CLIPPED, _E_FULL, _E_WINDOW, _E_CENTRE, _E_ALL, _E_SCOPED, _MOMENTS, _E_FITTED, _SIDES, _E_COLUMNS, *_E_FILTER, _wide("xw", _E, "{bc} c LEFT JOIN {ek} k ON c.id = k.id"), _ALL_IDS, _put_together(_E, "xw")),
]

"""Tail shape of each segment's own robust z-scores, by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.operators.distances import EPS, curve, localized
from breakwater.operators import pooled
from breakwater.plans.family import columns, family, way

X = {"x": "scoped_suppliers"}
#: Scopes count only where both segments have so many points.
_ENOUGH = ("e", "SELECT id, scope FROM {x} GROUP BY id, scope HAVING sum(CASE WHEN period = 0 THEN 1 ELSE 0 END) >= 10 AND sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) >= 10")
_MED = ("m", "SELECT x.id, x.scope, period, DBL(count(*)) AS n, PCT(value, 0.5) AS med FROM {x} x JOIN {e} e ON x.id = e.id AND x.scope = e.scope GROUP BY x.id, x.scope, period")
_MAD = ("md", "SELECT x.id, x.scope, x.period, max(n) AS n, max(med) AS med, 1.4826 * PCT(abs(value - med), 0.5) AS s FROM {x} x JOIN {m} m ON x.id = m.id AND x.scope = m.scope AND x.period = m.period GROUP BY x.id, x.scope, x.period")
_Z = ("z", "SELECT x.id, x.scope, x.period, n, (value - med) / CASE WHEN s < 1e-12 THEN DBL(1) ELSE s END AS z FROM {x} x JOIN {md} m ON x.id = m.id AND x.scope = m.scope AND x.period = m.period")
SCORES = (_ENOUGH, _MED, _MAD, _Z)

_TOP = (
    "top",
    "SELECT id, scope, period, side, frac, u, rank() OVER (PARTITION BY id, scope, period, side, frac ORDER BY u DESC) AS rk, least(greatest(8, BIG(floor(n * f))), BIG(n) - 1) AS k FROM "
    "(SELECT id, scope, period, n, CASE WHEN side = 'upper' THEN z ELSE -z END AS u, side, frac, f FROM {z} CROSS JOIN (VALUES ('upper', 'q90', 0.10), ('lower', 'q90', 0.10), ('upper', 'q95', 0.05), ('lower', 'q95', 0.05)) AS v(side, frac, f) WHERE n >= 16) y",
)
_HILL = ("hl", "SELECT id, scope, period, side, frac, CASE WHEN avg(LN(u - lo + 1 + 1e-12)) < 1e-12 THEN NULL ELSE 1 / avg(LN(u - lo + 1 + 1e-12)) END AS alpha FROM (SELECT *, min(u) OVER (PARTITION BY id, scope, period, side, frac) AS lo FROM {top} WHERE rk <= k) y GROUP BY id, scope, period, side, frac")
_ALPHA = ("al", "SELECT id, scope, " + ", ".join(f"max(CASE WHEN period = {p} AND side = '{s}' AND frac = '{f}' THEN alpha END) AS a{p}_{f}_{s}" for p in (0, 1) for f in ("q90", "q95") for s in ("upper", "lower")) + " FROM {hl} GROUP BY id, scope", way(lambda have: pooled.tail_shapes(have["x"]).where("greatest(n0, n1) >= 16"), "x"))


def _three(name: str, a: str, b: str, end: str = "") -> dict[str, str]:
    return {f"{name}_delta{end}": f"{b} - {a}", f"{name}_absdelta{end}": f"abs({b} - {a})", f"{name}_ndiff{end}": f"({b} - {a}) / (abs({a}) + abs({b}) + {EPS})"}


_HILLS: dict[str, str] = {}
for _f in ("q90", "q95"):
    _HILLS |= {f"bl_ts_hill_alpha0_{_f}": f"a0_{_f}_upper", f"bl_ts_hill_alpha1_{_f}": f"a1_{_f}_upper"} | _three("bl_ts_hill_alpha", f"a0_{_f}_upper", f"a1_{_f}_upper", f"_{_f}") | _three("bl_ts_hill_alpha", f"a0_{_f}_lower", f"a1_{_f}_lower", f"_{_f}_lower")
_EXCEED = {}
for _t, _n in (("2.0", "t20"), ("2.5", "t25"), ("3.0", "t30")):
    for _side, _c, _e in (("hi", f"z >= {_t}", f"z - {_t}"), ("lo", f"z <= -{_t}", f"-{_t} - z")):
        _EXCEED[f"bl_ts_p_{_side}_delta_{_n}"] = f"POST(avg(CASE WHEN {_c} THEN DBL(1) ELSE 0 END)) - PRE(avg(CASE WHEN {_c} THEN DBL(1) ELSE 0 END))"
        _EXCEED[f"bl_ts_mean_excess_{_side}_delta_{_n}"] = f"coalesce(POST(avg(CASE WHEN {_c} THEN {_e} END)), 0) - coalesce(PRE(avg(CASE WHEN {_c} THEN {_e} END)), 0)"


def _metrics(x: DataFrame) -> DataFrame:
    over = {"hill_alpha_delta_q95": "a{}_q95_upper", "qspace_hi_delta": "hi{}", "qspace_lo_delta": "lo{}", "asym_delta": "as{}"}
    return pooled.tail_shapes(x).select("id", "scope", *[(F.col(c.format(1)) - F.col(c.format(0))).alias(n) for n, c in over.items()])


_QUANT = ("qz", "SELECT id, scope, period, PCT(z, 0.01) AS q01, PCT(z, 0.05) AS q05, PCT(z, 0.5) AS q50, PCT(z, 0.95) AS q95, PCT(z, 0.99) AS q99 FROM {z} GROUP BY id, scope, period")
_SPACE = ("sp", f"SELECT id, scope, V0((q99 - q95) / (q95 - q50 + {EPS})) AS hi0, V1((q99 - q95) / (q95 - q50 + {EPS})) AS hi1, V0((q50 - q05) / (q05 - q01 + {EPS})) AS lo0, V1((q50 - q05) / (q05 - q01 + {EPS})) AS lo1, V0(q99 - q50 - (q50 - q01)) AS as0, V1(q99 - q50 - (q50 - q01)) AS as1 FROM {{qz}} GROUP BY id, scope", way(lambda have: pooled.tail_shapes(have["x"]), "x"))
_METRICS = ("ts", "SELECT s.id, s.scope, a1_q95_upper - a0_q95_upper AS hill_alpha_delta_q95, hi1 - hi0 AS qspace_hi_delta, lo1 - lo0 AS qspace_lo_delta, as1 - as0 AS asym_delta FROM {sp} s LEFT JOIN {al} a ON s.id = a.id AND s.scope = a.scope", way(lambda have: _metrics(have["x"]), "x"))
_ALL = (*SCORES, _TOP, _HILL, _ALPHA, _QUANT, _SPACE, _METRICS)
_FOUR = ("hill_alpha_delta_q95", "qspace_hi_delta", "qspace_lo_delta", "asym_delta")

FAMILIES = [
    family("hill_tail", *SCORES, _TOP, _HILL, _ALPHA, "SELECT " + columns(_HILLS) + " FROM {al}", **X),
    family("exceedance", *SCORES, "SELECT " + columns(_EXCEED) + " FROM {z} GROUP BY id, scope", **X),
    family("quantile_spacing", *SCORES, _QUANT, _SPACE, "SELECT " + columns(_three("bl_ts_qspace_hi", "hi0", "hi1") | _three("bl_ts_qspace_lo", "lo0", "lo1")) + " FROM {sp}", **X),
    family("asymmetry", *SCORES, _QUANT, _SPACE, "SELECT " + columns(_three("bl_ts_asym", "as0", "as1")) + " FROM {sp}", **X),
    family("tail_localization", *_ALL, localized(_FOUR, "bl_ts_loc", "ts"), **X),
    family("tail_curve", *_ALL, curve({m: m for m in _FOUR}, "bl_ts_dod", "ts"), **X),
]

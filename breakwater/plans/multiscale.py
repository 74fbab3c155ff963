"""The full feature matrix: 920 columns of each series, over whole segments and three windows.

Series are dealt by id once. One pass makes the raw statistics of a series in all scopes (``padded``), a row for
each series, and writes them; the features are expressions of that row, most of them the families' own texts with
the columns of a scope put in, so nothing is shuffled, grouped or joined again. These expressions take seconds to
compile in each task: they run over the written rows, in as many tasks as their bytes call for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from breakwater.operators import contrasts, distances, dynamics, padded, spectra, tails
from breakwater.plans import engine
from breakwater.plans.dialect import arguments, render
from breakwater.plans.family import outputs, split
from breakwater.sources import series, tables

#: Groups: families, and columns left out of the matrix.
GROUPS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "base": (("quantile_features", "hist_entropy", "rolling_var_slope", "diff_variance", "energy_v", "wasserstein", "quantile_deltas", "scale_shift", "acf1_shift", "ar1_yw"), ("entropy_pre", "entropy_post")),
    "cv": (("cv_features",), ()),
    "compression": (("compression",), ("lz76_pre", "lz76_post")),
    "cusum": (("cusum_features", "cusum_elbow", "cusum_error", "cusum_boundary_vol"), ()),
    "transforms": (("transform_stats_raw", "transform_stats_cumsum", "transform_stats_diff"), ()),
    "distances": (("boundary_distances", "winsor_distances", "tail_distances", "tail_mass"), ()),
    "disagreement": (("dod_ratios", "agreement", "tail_bulk", "localization", "dod_curve"), ()),
    "tails": (("hill_tail", "exceedance", "quantile_spacing", "asymmetry"), ()),
    "tail_curves": (("tail_localization", "tail_curve"), ()),
}
#: Columns of each group.
COUNTS = {"base": 92, "cv": 88, "compression": 68, "cusum": 100, "transforms": 24, "distances": 168, "disagreement": 152, "tails": 148, "tail_curves": 80}
#: Parts of the pass that each group takes its columns from.
PARTS = {"base": ("moments", "sweeps"), "cv": ("moments",), "compression": ("sizes",), "cusum": ("moments", "sums"), "transforms": ("transforms",), "distances": ("moments", "sweeps"), "disagreement": ("sweeps",), "tails": ("tails",), "tail_curves": ("tails",)}
WINDOWS = tuple(s for s in series.SCOPES if s != "full")

#: Columns of a family's text that have another name in the pass.
_NAMES: dict[str, dict[str, str]] = {
    "rolling_var_slope": {"s": "vs"}, "boundary_distances": {c: f"{c}_raw" for c in ("wass", "ener", "wz", "ez")}, "winsor_distances": {c: f"{c}_wins" for c in ("wass", "ener", "wz", "ez")},
    **{f: {"hi": "chi", "lo": "clo", "sd": "csd"} for f in ("cusum_features", "cusum_boundary_vol")}, "cusum_elbow": {"s0": "e0", "s1": "e1"},
    **{f: {"wassz": "wz_raw", "enez": "ez_raw", "wins_wassz": "wz_wins", "wins_enez": "ez_wins"} for f in ("dod_ratios", "agreement", "localization", "dod_curve")},
    **{f: {"hill_alpha_delta_q95": "hill", "qspace_hi_delta": "space_hi", "qspace_lo_delta": "space_lo", "asym_delta": "asym"} for f in ("tail_localization", "tail_curve")},
}
_BOTH = "mean_0 IS NOT NULL AND mean_1 IS NOT NULL"


def _tail(name: str) -> str:
    """A change of the mass or the mean excess of a tail, by the name of its column."""
    kind, end, q = re.fullmatch(r"bl_t\w+?_(p|mean_excess)_(hi|lo)_delta_(\w+)", name).groups()
    at = f"{kind[0].replace('m', 'e')}_{end}{q[1:] if q[0] == 'q' else '_' + q}"
    return f"CASE WHEN hi0 IS NOT NULL THEN coalesce({at}_1, 0) - coalesce({at}_0, 0) END" if at.startswith("e") and q[0] == "t" else f"{at}_1 - {at}_0"


#: Families whose text sums over points: what the pass has made of them.
_MADE = {
    "energy_v": {"energy": f"CASE WHEN {_BOTH} THEN greatest(2 * area2, 0) END"}, "wasserstein": {"wasserstein": "area"}, "cusum_error": {"cusum_error_wasserstein": "cerr"},
    "tail_mass": {n: _tail(n) for n in distances._MASS}, "exceedance": {n: _tail(n) for n in tails._EXCEED},
}


def _cells(text: str) -> dict[str, str]:
    """Columns that a text makes and what they are; rounding is left to the last step."""
    parts = split(text[len("SELECT ") : text.rindex(" FROM {")])
    return {name: re.sub(r"^R8?\((.*)\)$", r"\1", part[: -len(f" AS {name}")]) for name, part in zip(outputs(text), parts) if part.endswith(f" AS {name}")}


def _over(text: str, scope: str, have: set[str], names: dict[str, str] | None = None) -> str:
    """A text over a row of the pass: V0 and V1 take the columns of a segment, if it is there; a largest value of one row is itself."""

    def put(part: str, end: str) -> str:
        word = lambda m: f"{w}{end}" if f"{(w := (names or {}).get(m[0], m[0]))}{end}" in have else m[0]
        return re.sub(r"[A-Za-z_]\w*", word, part)

    while m := re.search(r"\b(V0|V1|max)\(", text):
        (inner,), end = arguments(text, m.end())
        if m[1] == "max":
            made = f"({inner})"
        else:
            made = f"(CASE WHEN mean_{m[1][1]}__{scope} IS NOT NULL THEN {put(inner, f'_{m[1][1]}__{scope}')} END)"
        text = text[: m.start()] + made + text[end:]
    return put(text, f"__{scope}")


def _steps(parts: set[str]) -> Iterator[list[tuple[str, str, str]]]:
    """What lies between the pass and the features, ``name, scope, text``: columns of one list need those of the lists before."""
    first, second, both = [], [], []
    for s in series.SCOPES:
        if "moments" in parts:
            first += [(f"phi_{p}", s, f"V{p}({dynamics._PHI['yw']})") for p in (0, 1)]
            second += [(f"rv_{p}", s, f"V{p}(CASE WHEN n < 3 THEN DBL(0) ELSE greatest(var1 * (1 - phi * phi), 0) END)") for p in (0, 1)]
            second += [(f"rmse_{p}", s, f"V{p}(CASE WHEN n < 3 THEN DBL(0) ELSE sqrt(greatest((syy - 2 * phi * sxy + phi * phi * sxx) / k, 0)) END)") for p in (0, 1)]
            first += [(c, s, e) for c, e in _cells(contrasts._CVS[1]).items() if c not in ("gmean", "gsd")]
        if "sums" in parts:
            first += [(_NAMES["cusum_elbow"].get(c, c), s, e) for c, e in _cells(dynamics._ELBOW[1]).items()]
        if "sizes" in parts:
            first += [(c, s, re.sub(r"\bs\[(\d)\]", r"z\1", e)) for c, e in _cells(spectra._RATES[1]).items()]
        if "sweeps" in parts:
            for v in padded.VARIANTS:
                first += [(f"wass_{v}", s, f"area_{v}"), (f"ener_{v}", s, f"CASE WHEN s_{v} IS NOT NULL THEN sqrt(greatest(2 * area2_{v}, 0)) END")]
                second += [(f"{z}_{v}", s, f"{c}_{v} / CASE WHEN s_{v} < 1e-12 THEN DBL(1) ELSE s_{v} END") for z, c in (("wz", "wass"), ("ez", "ener"))]
            if "moments" in parts:
                first += [(d, s, f"CASE WHEN s_raw IS NOT NULL THEN V1({c}) - V0({c}) END") for d, c in (("dm", "mean"), ("dmed", "med"))]
        if "tails" in parts:
            first += [("hill", s, "a1_q95_upper - a0_q95_upper"), *((n, s, f"{c}1 - {c}0") for n, c in (("space_hi", "hi"), ("space_lo", "lo"), ("asym", "as")))]
    if "transforms" in parts:
        first += [(c, k, e) for k in ("raw", "cumsum", "diff") for c, e in (("wass", "area"), ("ener", "CASE WHEN area2 IS NOT NULL THEN sqrt(greatest(2 * area2, 0)) END"))]
    yield from (first, second)
    for need, family in (("sweeps", "dod_curve"), ("tails", "tail_curve")):
        for m in _NAMES[family].values() if need in parts else ():
            there = [(f"{m}__{s}", f"LN({series.SCOPES[s]})") for s in WINDOWS]
            count = " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 END" for v, _ in there)
            both += [(f"{m}_k", "curve", count), (f"{m}_y", "curve", f"DIV({' + '.join(f'coalesce({v}, 0)' for v, _ in there)}, {count})"), (f"{m}_x", "curve", f"DIV({' + '.join(f'CASE WHEN {v} IS NULL THEN 0 ELSE {w} END' for v, w in there)}, {count})")]
    yield both
    yield [(name.replace("_k", "_b"), "curve", _slope(name[:-2])) for name, _, _ in both if name.endswith("_k")]


def _slope(m: str) -> str:
    """Slope of a metric's line against the log of the window."""
    of = lambda e: " + ".join(f"coalesce({e.format(v=f'{m}__{s}', x=f'(LN({series.SCOPES[s]}) - {m}_x__curve)')}, 0)" for s in WINDOWS)
    return f"CASE WHEN {m}_k >= 2 THEN DIV({of('{x} * ({v} - ' + m + '_y__curve)')}, {of('CASE WHEN {v} IS NOT NULL THEN {x} * {x} END')}) END"


def _curve(m: str) -> list[str]:
    """The columns of ``distances.curve`` for a metric, in its order."""
    a, b, c = (f"{m}__{s}" for s in WINDOWS)
    sd = f"sqrt(({' + '.join(f'coalesce(({v} - {m}_y) * ({v} - {m}_y), 0)' for v in (a, b, c))}) / {m}_k)"
    size = f"(({' + '.join(f'coalesce(abs({v}), 0)' for v in (a, b, c))}) / {m}_k)"
    low, high = f"coalesce({a}, {b}, {c})", f"coalesce({c}, {b}, {a})"
    few = lambda e: f"CASE WHEN {m}_k >= 2 THEN {e} END"
    return [f"{m}_b", f"{m}_y - {m}_b * {m}_x", few(f"greatest({a}, {b}, {c}) - least({a}, {b}, {c})"), few(sd), few(f"CASE WHEN {size} > {distances.EPS} THEN {sd} / {size} END"), few(f"{high} - {low}"), few(f"CASE WHEN abs({low}) > {distances.EPS} THEN {high} / {low} END"), f"{a} - 2 * {b} + {c}"]


def _features(family: str, have: set[str]) -> Iterator[tuple[str, str]]:
    """Columns of a family, by name, as expressions of a row."""
    text, names = engine.SCOPED[family].steps[-1][1], _NAMES.get(family, {})
    if family in ("dod_curve", "tail_curve"):
        yield from zip(outputs(text)[1:], [_over(e, "curve", have) for m in names.values() for e in _curve(m)])
    elif family.startswith("transform_stats_"):
        yield from ((c, _over(e, family.split("_")[-1], have)) for c, e in _cells(text).items())
    else:
        cells = _MADE.get(family) or _cells(text)
        for s in series.SCOPES:
            if s == "full" and family in engine.WINDOWS_ONLY:
                continue
            for c, e in cells.items():
                e = re.sub(r"max\(CASE WHEN variant = '(\w+)' THEN (\w+) END\)", r"\2_\1", e)
                e = re.sub(r"\b([wf])\.(\w+)", lambda m: f"{names[m[2]]}__{s if m[1] == 'w' else 'full'}", e)
                yield engine.named(c, s), _over(e, s, have, names)


def matrix(table: DataFrame, groups: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """``id`` and the columns of ``groups``, of a table ``id, seq, period, value``; all groups give 920."""
    parts = tuple(p for p in padded.PARTS if any(p in PARTS[g] for g in groups))
    rows = padded.statistics(table, parts)
    with tables.scans(table.sparkSession, series.scans(rows)):
        rows = tables.staged(rows, "statistics")
    for step in _steps(set(parts)):
        have = set(rows.columns)
        rows = rows.selectExpr("*", *[f"{render(_over(e, s, have), 0)} AS {name}__{s}" for name, s, e in step])
    have, found, digits = set(rows.columns), {}, {}
    for group in groups:
        families, without = GROUPS[group]
        made = {}
        for family in families:
            made |= {c: e for c, e in _features(family, have) if c not in made}
        left = {c: e for c, e in made.items() if not any(c == w or c.startswith(f"{w}_w") for w in without)}
        if len(left) != COUNTS[group]:
            raise ValueError(f"group {group} has {len(left)} columns, not {COUNTS[group]}")
        found |= left
        digits |= dict.fromkeys(left, (8, "1e-13") if group == "compression" else (4, "1e-9"))
    # As the macros R and R8, but each value is rounded once, which takes most of the time; a sum with 0 is never -0.
    return rows.selectExpr("id", *[f"CAST(round({render(e, 0)} + {digits[c][1]}, {digits[c][0]}) AS DOUBLE) + CAST(0 AS DOUBLE) AS {c}" for c, e in found.items()])


def feature_matrix_920(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(series.segments(spark, sf_dir))


QUERIES = {"feature_matrix_920": feature_matrix_920}

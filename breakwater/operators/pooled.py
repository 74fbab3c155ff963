"""What needs the sorted values of a series, by a small function of one series at a time.

Spark deals the series over tasks by id, once for all scopes; a task sorts a series and cuts its
scopes from it. The SQL beside each use says what the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.functions import arrays
from breakwater.sources import series, tables

#: Quantiles of a segment.
SHARES = {"q05": 0.05, "q10": 0.1, "q25": 0.25, "med": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}


def quantile(x: np.ndarray, share: float) -> float:
    """Interpolated quantile of sorted values."""
    at = (len(x) - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    return float(x[low]) if x[low] == x[high] else float((high - at) * x[low] + (at - low) * x[high])


def deviation(x: np.ndarray, middle: float) -> float:
    """Median distance from the middle."""
    return quantile(np.sort(np.abs(x - middle)), 0.5)


def by_series(x: DataFrame, function: Callable[[np.ndarray, np.ndarray], Iterator[tuple]], columns: str, joined: bool = False) -> DataFrame:
    """``id, scope`` and ``columns``: the rows that ``function`` makes of the values of both segments in their order, for each scope of ``x``; ``joined``: of all values and which of them are after the split."""
    rows, scopes = series.unscoped(x)
    key = [f for f in rows.schema if f.name == "id"][0]
    schema = f"id {key.dataType.simpleString()}, scope string, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    types = [pa.string(), *[kinds[c.split()[1]] for c in columns.split(", ")]]

    def of_series(table: pa.Table) -> pa.Table:
        order = np.argsort(table["seq"].to_numpy(), kind="stable")
        value, after, pos = table["value"].to_numpy()[order], table["period"].to_numpy()[order] == 1, table["pos"].to_numpy()[order]
        found = []
        for scope, w in ({table["scope"][0].as_py(): 1 << 62} if scopes is None else scopes).items():
            near = pos <= w
            given = (value[near], after[near]) if joined else (value[near & ~after], value[near & after])
            found += [(scope, *r) for r in function(*given)]
        parts = list(zip(*found)) or [()] * len(types)
        ids = pa.array([table["id"][0].as_py()] * len(found), table["id"].type)
        return pa.table([ids, *[pa.array(p, t) for p, t in zip(parts, types)]], names=["id", "scope", *names])

    keys = ["id"] if scopes is not None else ["id", "scope"]
    return rows.select(*keys, "seq", "period", "pos", "value").groupBy(*keys).applyInArrow(of_series, schema)


def once(x: DataFrame, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for ``x``, written the first time, as several families of one matrix use it."""
    made = x.__dict__.setdefault("_once", {})
    if name not in made:
        with tables.scans(x.sparkSession, series.scans(series.unscoped(x)[0])):
            made[name] = tables.staged(make(x), name)
    return made[name]


def apart(pre: np.ndarray, post: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Areas between two distribution functions, plain and squared, and their largest distance; of sorted values."""
    if not len(pre) or not len(post):
        return None, None, None
    grid = np.unique(np.concatenate([pre, post]))
    off = np.searchsorted(pre, grid, "right") / len(pre) - np.searchsorted(post, grid, "right") / len(post)
    gap = np.diff(grid)
    if not len(gap):
        return None, None, 0.0
    return float(np.abs(off[:-1]) @ gap), float((off[:-1] ** 2) @ gap), float(np.abs(off).max())


def compared(x: DataFrame) -> DataFrame:
    """``id, scope, n0, n1, area, area2, ks`` of the two segments as they are."""
    of_scope = lambda a, b: [(float(len(a)), float(len(b)), *apart(np.sort(a), np.sort(b)))] if len(a) + len(b) else []
    return once(x, "compared", lambda x: by_series(x, of_scope, "n0 double, n1 double, area double, area2 double, ks double"))


def cut(x: np.ndarray, variant: str) -> np.ndarray:
    """The part of a segment's sorted values that a variant compares, by the segment's own quantiles."""
    if variant == "raw" or not len(x):
        return x
    share = 0.9 if variant.startswith("q90") else 0.95
    low, high = quantile(x, 0.1 if share == 0.9 else 0.05), quantile(x, share)
    if variant == "wins":
        return np.clip(x, low, high)
    keep = {"upper": x >= high, "lower": x <= low, "both": (x >= high) | (x <= low)}
    return x[keep[variant[4:]]]


def variants_apart(x: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """``id, scope, variant, area, area2, s`` where both segments keep two values: ``s`` is the pooled robust scale."""

    def of_scope(a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        a, b = np.sort(a), np.sort(b)
        for v in variants:
            pre, post = cut(a, v), cut(b, v)
            if len(pre) >= 2 and len(post) >= 2:
                both = np.sort(np.concatenate([pre, post]))
                yield v, *apart(pre, post)[:2], 1.4826 * deviation(both, quantile(both, 0.5))

    return once(x, f"variants{len(variants)}", lambda x: by_series(x, of_scope, "variant string, area double, area2 double, s double"))


_STATISTICS = ("n", "mean", "sd", "sd1", "var1", "var0", "lo", "hi", *SHARES, "m3", "m4", "slope", "dvar", "dvar1", "acov", "ss", "lag_corr", "pcov", "pvar", "syy", "sxy", "sxx", "sy", "sx", "k", "mad")


def _of_segment(x: np.ndarray) -> tuple[float | None, ...]:
    n, v = len(x), np.sort(x)
    off, t, now, prev = x - x.mean(), np.arange(n) - (n - 1) / 2, x[1:], x[:-1]
    ss, step, middle = float(off @ off), now - prev, quantile(v, 0.5)
    variance = lambda y, less: float(((y - y.mean()) ** 2).sum() / (len(y) - less)) if len(y) > less else None
    var1 = ss / (n - 1) if n > 1 else None
    pairs = (None,) * 9
    if n > 1:
        da, db = now - now.mean(), prev - prev.mean()
        both = float(da @ da) * float(db @ db)
        corr = float(da @ db) / both**0.5 if both > 0 else None
        pairs = (corr, float(da @ db) / (n - 1), variance(prev, 1), float(now @ now), float(now @ prev), float(prev @ prev), float(now.sum()), float(prev.sum()), float(n - 1))
    else:
        pairs = (*pairs[:-1], 0.0)
    return (
        float(n), float(x.mean()), (ss / n) ** 0.5, None if var1 is None else var1**0.5, var1, ss / n, float(v[0]), float(v[-1]), *[quantile(v, s) for s in SHARES.values()],
        float((off**3).mean()), float((off**4).mean()), float(t @ off) / float(t @ t) if n > 1 else None, variance(step, 0), variance(step, 1), float(off[1:] @ off[:-1]) if n > 1 else None, ss, *pairs, deviation(v, middle),
    )


def statistics(x: DataFrame) -> DataFrame:
    """``id, scope, period`` and moments, quantiles, lagged sums and the median deviation of each segment, as ``contrasts.STATS``, ``contrasts.MADS`` and ``dynamics`` have them."""
    of_scope = lambda a, b: [(p, *_of_segment(s)) for p, s in ((0, a), (1, b)) if len(s)]
    return once(x, "statistics", lambda x: by_series(x, of_scope, "period int, " + ", ".join(f"{c} double" for c in _STATISTICS)))


def _cusum(x: np.ndarray) -> np.ndarray:
    """Running sums of the deviations from the mean, over their spread if they have one."""
    sums = np.cumsum(x - x.mean())
    spread = sums.std()
    return sums / spread if spread > 1e-10 else sums


_CUSUMS = ("n", "fin", "hi", "lo", "sd", "path", "g1", "g2", "g20", "h1", "h20", "w", "v")


def cusums(x: DataFrame) -> DataFrame:
    """``id, scope, period``: shape of each segment's own running sums, ends of the joined ones, and ``v``, the spread of their steps in the ``w`` points at the split; as ``ct`` and ``vol`` in ``dynamics`` have them."""

    def of_scope(value: np.ndarray, after: np.ndarray) -> Iterator[tuple]:
        whole = _cusum(value) if len(value) else value
        parts = [(p, _cusum(value[side]), whole[side]) for p, side in ((0, ~after), (1, after)) if side.any()]
        w = min([50, *[len(own) // 4 for _, own, _ in parts]])
        for p, own, joint in parts:
            n, steps, k = len(own), np.diff(joint), max(w - 1, 0)
            near, end = steps[:k] if p else steps[n - 1 - k :], min(20, n)
            path = float(np.abs(np.diff(own)).sum()) if n > 1 else None
            ends = (joint[0], joint[1] if n > 1 else None, joint[end - 1], joint[-1], joint[-end])
            yield p, float(n), own[-1], own.max(), own.min(), own.std(), path, *ends, float(w), near.std() if k else None

    return once(x, "cusums", lambda x: by_series(x, of_scope, "period int, " + ", ".join(f"{c} double" for c in _CUSUMS), joined=True))


def cusum_errors(x: DataFrame) -> DataFrame:
    """``id, scope, area`` between the distributions of both segments' running sums off their own lines. One point has no line: it counts, without a value, as in the SQL."""

    def off_line(x: np.ndarray) -> np.ndarray:
        if len(x) < 2:
            return np.empty(0)
        own, t = _cusum(x), np.arange(len(x)) - (len(x) - 1) / 2
        return np.sort(own - own.mean() - (t @ own) / (t @ t) * t)

    def of_scope(a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        pre, post = off_line(a), off_line(b)
        grid = np.unique(np.concatenate([pre, post]))
        if len(grid) < 2 or not len(a) or not len(b):
            return [(None if len(grid) < 2 else float("nan"),)] if len(a) + len(b) else []
        off = np.searchsorted(pre, grid, "right") / len(a) - np.searchsorted(post, grid, "right") / len(b)
        return [(float(np.abs(off[:-1]) @ np.diff(grid)),)]

    return once(x, "cusum_errors", lambda x: by_series(x, of_scope, "area double"))


_FRACTIONS = {"q90": 0.1, "q95": 0.05}
_SIDES = ("upper", "lower")


def hill(z: np.ndarray, side: str, share: float) -> float | None:
    """Tail index of the largest (or smallest) values, ties of the last one included; of sorted values."""
    n = len(z)
    if n < 16:
        return None
    u = z if side == "upper" else -z[::-1]
    low = u[n - min(max(8, int(np.floor(n * share))), n - 1)]
    mean = float(np.log(u[u >= low] - low + 1 + 1e-12).mean())
    return None if mean < 1e-12 else 1 / mean


def tail_shapes(x: DataFrame) -> DataFrame:
    """``id, scope``, sizes, spacings ``hi, lo, as`` and tail indices of both segments' own robust z-scores, where both have ten points."""
    ends = {"hi": lambda q: (q[4] - q[3]) / (q[3] - q[2] + 1e-12), "lo": lambda q: (q[2] - q[1]) / (q[1] - q[0] + 1e-12), "as": lambda q: q[4] - q[2] - (q[2] - q[0])}
    names = ["n0", "n1", *[f"{e}{p}" for e in ends for p in (0, 1)], *[f"a{p}_{f}_{s}" for p in (0, 1) for f in _FRACTIONS for s in _SIDES]]

    def scores(a: np.ndarray) -> np.ndarray:
        a = np.sort(a)
        middle = quantile(a, 0.5)
        s = 1.4826 * deviation(a, middle)
        return (a - middle) / (1.0 if s < 1e-12 else s)

    def of_scope(a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        if min(len(a), len(b)) >= 10:
            zs = scores(a), scores(b)
            qs = [[quantile(z, s) for s in (0.01, 0.05, 0.5, 0.95, 0.99)] for z in zs]
            yield float(len(a)), float(len(b)), *[e(q) for e in ends.values() for q in qs], *[hill(z, s, f) for z in zs for f in _FRACTIONS.values() for s in _SIDES]

    return once(x, "tails", lambda x: by_series(x, of_scope, ", ".join(f"{c} double" for c in names)))


def standard(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both segments by the first one's mean and deviation; zero if it has none."""
    sd = a.std()
    return (np.zeros(len(a)), np.zeros(len(b))) if sd < 1e-10 else ((a - a.mean()) / sd, (b - a.mean()) / sd)


@lru_cache(256)
def _places(n: int, taps: int) -> np.ndarray:
    """Where the values under a filter are, one row for each second place; the array is mirrored at its ends."""
    at = (2 * np.arange((n + taps - 1) // 2)[:, None] + 1 - np.arange(taps) + 2 * n) % (2 * n)
    return np.minimum(at, 2 * n - 1 - at)


def wavelet_energies(x: DataFrame, low: tuple[float, ...], least: int) -> DataFrame:
    """``id, scope, period, e1, e2, e3``: energies of the details of three levels of each standardised segment."""
    taps = np.array(low)
    high = taps[::-1] * (-1.0) ** (np.arange(len(low)) + 1)

    def energies(z: np.ndarray) -> Iterator[float]:
        for _ in range(3):
            near = z[_places(len(z), len(taps))]
            detail, z = near @ high, near @ taps
            yield float(detail @ detail)

    of_scope = lambda a, b: [(p, *energies(z)) for p, z in enumerate(standard(a, b))] if min(len(a), len(b)) >= least else []
    return by_series(x, of_scope, "period int, e1 double, e2 double, e3 double")


def _shape(z: np.ndarray) -> tuple[float, ...]:
    p = arrays.power_of(z)
    k = np.arange(len(p))
    f, q = k * (1.0 / len(z)), p / (p.sum() + 1e-12)
    c, low, e = np.cumsum(q), f <= 0.08, q + 1e-12
    rolled = f[c >= 0.5]
    return tuple(map(float, (
        np.log((q[low].sum() + 1e-12) / (q[~low].sum() + 1e-12)), -(e @ np.log(e)) / np.log(len(q)), q[1:].max(), np.exp(np.log(e).mean()) / e.mean(),
        (np.diff(q) ** 2).mean(), rolled[0] if len(rolled) else f[-1], np.sqrt(((f - f @ q) ** 2) @ q), q[f > 0.15].sum(),
    )))


def spectral_shapes(x: DataFrame, names: list[str], least: int) -> DataFrame:
    """``id, scope, period`` and the shape of each standardised segment's spectrum, in the order of ``spectra.SHAPE``."""
    of_scope = lambda a, b: [(p, *_shape(z)) for p, z in enumerate(standard(a, b))] if min(len(a), len(b)) >= least else []
    return by_series(x, of_scope, "period int, " + ", ".join(f"{n} double" for n in names))


def sizes(x: DataFrame) -> DataFrame:
    """``id, scope, n0, n1``, and ``m, sd`` of the first segment."""
    of = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    n = [F.coalesce(of("n", p), F.lit(0)).cast("bigint").alias(f"n{p}") for p in (0, 1)]
    return statistics(x).groupBy("id", "scope").agg(*n, of("mean", 0).alias("m"), of("sd", 0).alias("sd"))

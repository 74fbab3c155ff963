"""Raw statistics of many series at once: sums, sorted values and counts, from which SQL makes features.

``pooled`` takes one series at a time; where a matrix needs all of them, the segments of many series are
rows of one array, so a call of numpy serves them all and a series is dealt and sorted once. Rows end in NaN.
A column's name ends in its scope (``mean_0__w50``: of the segment before the split).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from breakwater.sources import series

#: What is compared of two segments: all, winsorised, and tails cut at each segment's own quantiles.
VARIANTS = ("raw", "wins", *[f"{q}_{end}" for q in ("q90", "q95") for end in ("upper", "lower", "both")])
#: How many times ``series.POINTS`` are worked on at once: a task is dealt a little more or less than that number, and a small rest costs as many calls as a large one.
AT_ONCE = 2
#: A column: its values, and for which series they are defined.
Column = tuple[np.ndarray, np.ndarray]


def total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, value by value: unlike numpy's own, the same however long the rest of a row is."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


class Rows:
    """Values of many segments in their order, a row each, and how many each has."""

    def __init__(self, values: np.ndarray, owner: np.ndarray, count: int):
        self.n = np.bincount(owner, minlength=count)
        self.x = np.full((count, max(int(self.n.max(initial=0)), 1)), np.nan)
        self.x[owner, np.arange(len(owner)) - (np.cumsum(self.n) - self.n)[owner]] = values
        self.has = np.arange(self.x.shape[1]) < self.n[:, None]

    def mean(self, x: np.ndarray) -> np.ndarray:
        """Means; that of equal values is the value, so that they have no spread."""
        flat = (~self.has | (x == x[:, :1])).all(axis=1)
        return np.where(flat, x[:, 0], total(np.where(self.has, x, 0.0)) / self.n)

    def off(self, x: np.ndarray) -> np.ndarray:
        """Distances from the mean, 0 past the end."""
        return np.where(self.has, x - self.mean(x)[:, None], 0.0)

    def spread(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(total(self.off(x) ** 2) / self.n)


class Near:
    """The points of many series in one scope: both segments, in order and sorted, and all in order."""

    def __init__(self, owner: np.ndarray, value: np.ndarray, after: np.ndarray, count: int):
        self.owner, self.value, self.after, self.count = owner, value, after, count
        self.sides = self.split(value)
        self.sorted = [np.sort(s.x, axis=1) for s in self.sides]
        self.n = [s.n for s in self.sides]

    def split(self, value: np.ndarray) -> list[Rows]:
        return [Rows(value[side], self.owner[side], self.count) for side in (~self.after, self.after)]


def at(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One value of each row."""
    return x[np.arange(len(x)), np.clip(place, 0, x.shape[1] - 1).astype(np.int64)]


def between(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(low == high, low, (np.ceil(place) - place) * low + (place - np.floor(place)) * high)


def quantile(x: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Interpolated quantiles of sorted rows."""
    place = np.maximum((n - 1) * share, 0.0)
    return between(at(x, np.floor(place)), at(x, np.ceil(place)), place)


def deviation(x: np.ndarray, n: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Median distance from the middle."""
    return quantile(np.sort(np.abs(x - middle[:, None]), axis=1), n, 0.5)


class Sweep:
    """Both segments' sorted values merged, and the gap from each to the next."""

    def __init__(self, pre: np.ndarray, post: np.ndarray):
        both = np.concatenate([pre, post], axis=1)
        order = np.argsort(both, axis=1)
        self.value = np.take_along_axis(both, order, axis=1)
        real = ~np.isnan(self.value)
        self.sides = [real & (order < pre.shape[1]), real & (order >= pre.shape[1])]
        self.n = np.count_nonzero(real, axis=1)
        now, after = self.value[:, :-1], self.value[:, 1:]
        self.gap = np.where(real[:, 1:] & (now != after), after - now, 0.0)

    def areas(self, n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Areas between the distributions, plain and squared, and where there are two values."""
        below = [np.cumsum(side[:, :-1], axis=1) / k[:, None] for side, k in zip(self.sides, n)]
        off = np.abs(below[0] - below[1])
        area = off * self.gap
        return total(area), total(off * area), self.gap.any(axis=1)

    def scale(self) -> np.ndarray:
        """Robust scale of the values of both segments."""
        return 1.4826 * deviation(self.value, self.n, quantile(self.value, self.n, 0.5))


def _entropy(s: Rows, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Entropy of a histogram of 20 bins from the smallest value to the largest."""
    flat, width = low == high, (high - low) / 20
    bins = np.where(flat[:, None], 10, np.clip(np.nan_to_num(np.floor((s.x - low[:, None]) / width[:, None])), 0, 19)).astype(np.int64)
    k = np.bincount((np.arange(len(bins))[:, None] * 20 + bins)[s.has], minlength=20 * len(bins)).reshape(-1, 20)
    share = k / (s.n * np.where(flat, 1 / 20, width))[:, None]
    return -total(np.where(k > 0, share * np.log(share), 0.0))


def _volatility(s: Rows, w: int = 50) -> np.ndarray:
    """Slope of the variances of ``w`` points in a row, without its sign."""
    m = max(s.x.shape[1] - w + 1, 0)
    parts = [s.x[:, j : j + m] for j in range(w)]
    mean = sum(parts) / w
    variance = sum((p - mean) ** 2 for p in parts) / (w - 1)
    k = np.maximum(s.n - w + 1, 0)[:, None]
    t = np.where(np.arange(m) < k, np.arange(m) - (k - 1) / 2, 0.0)
    return np.abs(total(t * np.where(np.arange(m) < k, variance, 0.0)) / total(t * t))


def moments(near: Near) -> Iterator[tuple[str, Column]]:
    """Moments, quantiles and lagged sums of each segment, as ``contrasts`` and ``dynamics`` have them."""
    for p, (s, v) in enumerate(zip(near.sides, near.sorted)):
        n, off, some, two = s.n, s.off(s.x), s.n > 0, s.n > 1
        now, prev, pair = s.x[:, 1:], s.x[:, :-1], s.has[:, 1:]
        paired = lambda x: total(np.where(pair, x, 0.0))  # noqa: E731, B023
        ss, med, low, high = total(off * off), quantile(v, n, 0.5), v[:, 0], at(v, n - 1)
        step = now - prev
        found = {"n": n, "mean": s.mean(s.x), "sd": np.sqrt(ss / n), "var0": ss / n, "ss": ss, "med": med, "mad": deviation(v, n, med), "h": _entropy(s, low, high)}
        found |= {q: quantile(v, n, share) for q, share in (("q10", 0.1), ("q25", 0.25), ("q75", 0.75), ("q90", 0.9))}
        pairs = {"var1": ss / (n - 1), "acov": total(off[:, 1:] * off[:, :-1]), "dvar": paired((step - (paired(step) / (n - 1))[:, None]) ** 2) / (n - 1), "syy": paired(now * now), "sxy": paired(now * prev), "sxx": paired(prev * prev), "k": n - 1}
        yield from ((f"{c}_{p}", (x, some)) for c, x in found.items())
        yield from ((f"{c}_{p}", (x, two)) for c, x in pairs.items())
    yield "vs", (_volatility(near.sides[1]), near.n[1] >= 100)
    whole = Rows(near.value, near.owner, near.count)
    yield "gmean", (whole.mean(whole.x), whole.n > 0)
    yield "gsd", (whole.spread(whole.x), whole.n > 0)


def sweeps(near: Near) -> Iterator[tuple[str, Column]]:
    """Areas between the segments and pooled scales, as they are and by variant; mass and mean of their common tails."""
    pre, post = near.sorted
    n, sweep = near.n, Sweep(pre, post)
    both = (n[0] > 0) & (n[1] > 0)
    q = {(p, s): quantile(v, n[p], s)[:, None] for p, v in enumerate(near.sorted) for s in (0.05, 0.1, 0.9, 0.95)}
    for variant in VARIANTS:
        of, sizes = sweep, n
        if variant == "wins":
            of = Sweep(*[np.clip(v, q[p, 0.05], q[p, 0.95]) for p, v in enumerate(near.sorted)])
        elif variant != "raw":
            high, low = (0.9, 0.1) if variant.startswith("q90") else (0.95, 0.05)
            ends = {"upper": lambda v, p: v >= q[p, high], "lower": lambda v, p: v <= q[p, low], "both": lambda v, p: (v >= q[p, high]) | (v <= q[p, low])}  # noqa: B023
            kept = [ends[variant[4:]](v, p) for p, v in enumerate(near.sorted)]
            rows = [Rows(v[k], np.nonzero(k)[0], near.count) for v, k in zip(near.sorted, kept)]
            of, sizes = Sweep(*[r.x for r in rows]), [r.n for r in rows]
        area, area2, apart = of.areas(sizes)
        two = (sizes[0] >= 2) & (sizes[1] >= 2)
        if variant == "raw":
            yield "area", (area, both & apart)
            yield "area2", (area2, both & apart)
        yield f"area_{variant}", (area, two & apart)
        yield f"area2_{variant}", (area2, two & apart)
        yield f"s_{variant}", (of.scale(), two)
    for name, share in (("90", 0.9), ("95", 0.95)):
        for end, place, beyond in (("hi", share, np.greater_equal), ("lo", 0.1 if name == "90" else 0.05, np.less_equal)):
            limit = quantile(sweep.value, sweep.n, place)[:, None]
            for p, v in enumerate(near.sorted):
                far = beyond(v, limit)
                k = np.count_nonzero(far, axis=1)
                yield f"p_{end}{name}_{p}", (k / n[p], n[p] > 0)
                yield f"e_{end}{name}_{p}", (total(np.where(far, v, 0.0)) / k, k > 0)


def _hill(z: np.ndarray, n: np.ndarray, side: str, share: float) -> Column:
    k = np.minimum(np.maximum(8, np.floor(n * share)), n - 1)
    low = at(z, n - k if side == "upper" else k - 1)[:, None]
    far, over = (z >= low, z - low) if side == "upper" else (z <= low, low - z)
    mean = total(np.log(over + 1 + 1e-12, where=far, out=np.zeros_like(z))) / np.count_nonzero(far, axis=1)
    return 1 / mean, (n >= 16) & ~(mean < 1e-12)


def tails(near: Near) -> Iterator[tuple[str, Column]]:
    """Spacings, tail indices and mass far out of each segment's own robust z-scores, where both have ten points."""
    enough = np.minimum(*near.n) >= 10
    for p, (v, n) in enumerate(zip(near.sorted, near.n)):
        middle = quantile(v, n, 0.5)
        s = 1.4826 * deviation(v, n, middle)
        z = (v - middle[:, None]) / np.where(s < 1e-12, 1.0, s)[:, None]
        q = [quantile(z, n, share) for share in (0.01, 0.05, 0.5, 0.95, 0.99)]
        yield f"hi{p}", ((q[4] - q[3]) / (q[3] - q[2] + 1e-12), enough)
        yield f"lo{p}", ((q[2] - q[1]) / (q[1] - q[0] + 1e-12), enough)
        yield f"as{p}", (q[4] - q[2] - (q[2] - q[0]), enough)
        for name, share in (("q90", 0.1), ("q95", 0.05)):
            for side in ("upper", "lower"):
                alpha, there = _hill(z, n, side, share)
                yield f"a{p}_{name}_{side}", (alpha, there & enough)
        for t, name in ((2.0, "t20"), (2.5, "t25"), (3.0, "t30")):
            for end, far, over in (("hi", z >= t, z - t), ("lo", z <= -t, -t - z)):
                k = np.count_nonzero(far, axis=1)
                yield f"p_{end}_{name}_{p}", (k / n, enough)
                yield f"e_{end}_{name}_{p}", (total(np.where(far, over, 0.0)) / k, enough & (k > 0))


def _summed(rows: Rows) -> np.ndarray:
    """Running sums of the deviations from the mean, over their spread if they have one."""
    sums = np.cumsum(rows.off(rows.x), axis=1)
    spread = rows.spread(sums)
    return sums / np.where(spread > 1e-10, spread, 1.0)[:, None]


def sums(near: Near) -> Iterator[tuple[str, Column]]:
    """Shape of each segment's own running sums, ends of the joined ones and the spread of their steps at the split; area between the own ones off their lines."""
    whole = Rows(near.value, near.owner, near.count)
    joint = near.split(_summed(whole)[whole.has])
    w = np.minimum(50, np.minimum(*[np.where(n > 0, n // 4, 50) for n in near.n]))
    k, lines = np.maximum(w - 1, 0), []
    for p, (s, j) in enumerate(zip(near.sides, joint)):
        n, own, some = s.n, _summed(s), s.n > 0
        path = total(np.where(s.has[:, 1:], np.abs(np.diff(own, axis=1)), 0.0))
        end, places = np.minimum(20, n), np.arange(s.x.shape[1] - 1)
        steps, first = np.diff(j.x, axis=1), (np.zeros_like(n) if p else n - 1 - k)[:, None]
        close = (places >= first) & (places < first + k[:, None])
        mean = total(np.where(close, steps, 0.0)) / k
        spread = np.sqrt(total(np.where(close, (steps - mean[:, None]) ** 2, 0.0)) / k)
        found = {"fin": at(own, n - 1), "chi": np.where(s.has, own, -np.inf).max(axis=1), "clo": np.where(s.has, own, np.inf).min(axis=1), "csd": s.spread(own), "g1": j.x[:, 0], "g20": at(j.x, end - 1), "h1": at(j.x, n - 1), "h20": at(j.x, n - end)}
        yield from ((f"{c}_{p}", (x, some)) for c, x in found.items())
        yield f"path_{p}", (path, n > 1)
        yield f"g2_{p}", (at(j.x, np.ones_like(n)), n > 1)
        yield f"v_{p}", (spread, some & (k > 0))
        t = np.where(s.has, np.arange(s.x.shape[1]) - (n[:, None] - 1) / 2, 0.0)
        slope = total(t * np.where(s.has, own, 0.0)) / total(t * t)
        lines.append(np.sort(np.where(s.has & (n > 1)[:, None], s.off(own) - slope[:, None] * t, np.nan), axis=1))
    yield "w", (w, np.ones(near.count, bool))
    of = Sweep(*lines)
    area, _, apart = of.areas(near.n)
    yield "cerr", (area, apart)


def sizes(near: Near) -> Iterator[tuple[str, Column]]:
    """Bytes, deflated in single precision: whole segments (2), halves (4), joined, the surroundings of the split (2) and these joined."""
    pre, post = (near.value[side].astype(np.float32).tobytes() for side in (~near.after, near.after))
    (n0, n1), found = near.n, np.empty((near.count, 10))
    close = np.minimum(100, np.minimum(n0 // 4, n1 // 4))
    ends = [np.cumsum(n) * 4 for n in near.n]
    for i, (e0, e1, c) in enumerate(zip(*ends, close * 4)):
        a, b = pre[e0 - 4 * n0[i] : e0], post[e1 - 4 * n1[i] : e1]
        m0, m1 = n0[i] // 2 * 4, n1[i] // 2 * 4
        last, first = a[len(a) - c :], b[:c]
        found[i] = [len(zlib.compress(x, 9)) for x in (a, b, a[:m0], a[m0:], b[:m1], b[m1:], a + b, last, first, last + first)]
    yield from ((f"z{k}", (found[:, k], np.ones(near.count, bool))) for k in range(10))
    yield from ((c, (x, np.ones(near.count, bool))) for c, x in (("near", close), ("n0", n0), ("n1", n1)))


def transforms(near: Near) -> Iterator[tuple[str, Column]]:
    """Moments, quantiles and areas of the series, its running sums and its steps."""
    whole = Rows(near.value, near.owner, near.count)
    later = whole.has.copy()
    later[:, 0] = False
    made = {"raw": (whole.x, whole.has), "cumsum": (np.cumsum(whole.x, axis=1), whole.has), "diff": (np.diff(whole.x, axis=1, prepend=0.0), later)}
    for kind, (x, there) in made.items():
        some = there[whole.has]
        of = near if kind == "raw" else Near(near.owner[some], x[there], near.after[some], near.count)
        for p, (s, v) in enumerate(zip(of.sides, of.sorted)):
            found = {"mean": s.mean(s.x), "sd": s.spread(s.x)} | {c: quantile(v, s.n, share) for c, share in (("med", 0.5), ("q10", 0.1), ("q90", 0.9))}
            yield from ((f"{c}_{p}__{kind}", (y, s.n > 0)) for c, y in found.items())
        sweep = Sweep(*of.sorted)
        area, area2, apart = sweep.areas(of.n)
        both = (of.n[0] > 0) & (of.n[1] > 0)
        yield f"area__{kind}", (area, both & apart)
        yield f"area2__{kind}", (np.where(apart, area2, 0.0), np.where(apart, both, sweep.n > 0))


#: What a pass can take of each scope; ``transforms`` is of whole series alone.
PARTS: dict[str, Callable[[Near], Iterator[tuple[str, Column]]]] = {f.__name__: f for f in (moments, sweeps, tails, sums, sizes, transforms)}


def _columns(owner: np.ndarray, value: np.ndarray, after: np.ndarray, count: int, parts: tuple[str, ...], scopes: dict[str, int]) -> Iterator[tuple[str, Column]]:
    """All columns of ``count`` series, whose points are in order."""
    before = np.where(after, 0, 1)
    first = np.searchsorted(owner, np.arange(count))
    run = np.cumsum(after) - (np.cumsum(after)[first] - after[first])[owner]
    left = np.bincount(owner, before, count)[owner] - (np.cumsum(before) - (np.cumsum(before)[first] - before[first])[owner])
    pos = np.where(after, run, left + 1)
    with np.errstate(all="ignore"):
        for scope, w in scopes.items():
            there = pos <= w
            near = Near(owner[there], value[there], after[there], count)
            for part in parts:
                if part != "transforms":
                    yield from ((f"{name}__{scope}", c) for name, c in PARTS[part](near))
                elif scope == "full":
                    yield from transforms(near)


def _made(table: pa.Table, parts: tuple[str, ...], scopes: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The columns of whole series, one after the other; series of like length at a time, so that few values are padding."""
    ids = table["id"].combine_chunks()
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    value, after, seq = table["value"].to_numpy(), table["period"].to_numpy() == 1, table["seq"].to_numpy()
    if ((np.diff(seq) < 0) & (np.diff(code) == 0)).any():
        order = np.lexsort((seq, code))
        value, after = value[order], after[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    owner, lengths = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(code))), np.diff(starts, append=len(code))
    kind = np.frexp(lengths)[1]
    for k in np.unique(kind):
        mine = kind == k
        rows, count = mine[owner], int(mine.sum())
        found = _columns((np.cumsum(mine) - 1)[owner[rows]], value[rows], after[rows], count, parts, scopes)
        columns = {name: pa.array(x.astype(np.float64), mask=~there) for name, (x, there) in found}
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts[mine])), *columns.values()], names=["id", *columns])


def statistics(table: DataFrame, parts: tuple[str, ...] = tuple(PARTS), scopes: dict[str, int] | None = None) -> DataFrame:
    """A row for each series of a table ``id, seq, period, value``: its ``parts`` in each scope. One shuffle, by id."""
    scopes, least = dict(scopes or series.SCOPES), AT_ONCE * series.POINTS
    rows = series.together(table)
    one = np.zeros(2, np.int64)
    names = [name for name, _ in _columns(one, one * 1.0, np.array([False, True]), 1, parts, scopes)]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, points, most = [], 0, least
        for batch in batches:
            held, points = [*held, batch], points + batch.num_rows
            if points >= most:
                have = pa.Table.from_batches(held)
                code = have["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(np.diff(code, prepend=-1))[-1])
                if cut:
                    yield from _made(have.slice(0, cut), parts, scopes)
                held, points = have.slice(cut).to_batches(), have.num_rows - cut
                most = max(least, 2 * points)
        if points:
            yield from _made(pa.Table.from_batches(held), parts, scopes)

    key = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(of_task, f"id {key}, " + ", ".join(f"{n} double" for n in names))
    made._points = rows._points
    return made

"""Statistics of a pair of segments in numpy, which the families in SQL are tested against.

Each function takes the values before and after the boundary, in order, and returns a
dictionary with the same keys for any input; a value that is not defined is NaN (null in
Spark).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd

NAN = float("nan")


# Standardising.


def standardized(x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both segments by the first one's mean and deviation; zeros if that is constant."""
    sd = x0.std() if len(x0) else 0.0
    if not sd >= 1e-10:
        return np.zeros(len(x0)), np.zeros(len(x1))
    return (x0 - x0.mean()) / sd, (x1 - x0.mean()) / sd


def clipped(x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`standardized`, after clipping both to the first one's 1% and 99% quantiles."""
    low, high = np.quantile(x0, [0.01, 0.99])
    return standardized(np.clip(x0, low, high), np.clip(x1, low, high))


# Spectrum.


def _spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
    return np.fft.rfftfreq(len(x)), power / (power.sum() + 1e-12)


def _spectral_shape(x: np.ndarray) -> dict[str, float]:
    f, p = _spectrum(x)
    floor = p + 1e-12
    past = np.flatnonzero(np.cumsum(p) >= 0.5)
    centre = (f * p).sum()
    return {
        "log_low_high": math.log((p[f <= 0.08].sum() + 1e-12) / (p[f > 0.08].sum() + 1e-12)),
        "spec_entropy": float(-(floor * np.log(floor)).sum() / math.log(len(p))),
        "peak_ratio": float(p[1:].max()),
        "flatness": float(np.exp(np.log(floor).mean()) / floor.mean()),
        "flux": float((np.diff(p) ** 2).mean()),
        "rolloff50": float(f[past[0]] if len(past) else f[-1]),
        "bandwidth": float(np.sqrt((((f - centre) ** 2) * p).sum())),
        "hf_power": float(p[f > 0.15].sum()),
    }


def spectral(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Shape of the two windowed power spectra and its changes; zeros below 8 (16) points."""
    names = ("log_low_high", "spec_entropy", "peak_ratio", "flatness", "flux", "rolloff50", "bandwidth", "hf_power")
    short = min(len(x0), len(x1))
    if short >= 8:
        a, b = standardized(x0, x1)
        pre, post = _spectral_shape(a), _spectral_shape(b)
    else:
        pre = post = dict.fromkeys(names, 0.0)
    out = {}
    for k in names[:2]:
        out |= {f"{k}_pre": pre[k], f"{k}_post": post[k]}
    return out | {f"delta_{k}": post[k] - pre[k] if k in names[:2] or short >= 16 else 0.0 for k in names}


def spectral_distance(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Distances of the two amplitude spectra, as far as both go."""
    names = ("spectral_l1_distance", "spectral_kl_divergence", "spectral_dominant_freq_shift", "spectral_low_freq_ratio")
    amplitude = [np.abs(np.fft.fft(x))[: len(x) // 2] if len(x) > 1 else np.empty(0) for x in (x0, x1)]
    n = min(map(len, amplitude))
    if n == 0:
        return dict(zip(names, (0.0, 0.0, 0.0, 1.0)))
    p, q = ((a / (a.sum() + 1e-8))[:n] for a in amplitude)
    low = n // 4
    values = (np.abs(p - q).sum(), ((p + 1e-8) * np.log((p + 1e-8) / (q + 1e-8))).sum(), abs(int(q.argmax()) - int(p.argmax())) / n, (q[:low] ** 2).sum() / ((p[:low] ** 2).sum() + 1e-8))
    return dict(zip(names, map(float, values)))


# Wavelets.

#: The low-pass decomposition filter with four vanishing moments.
DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])


def _analyse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step with half-point symmetric extension: approximation and detail."""
    taps = len(DB4)
    reach = np.concatenate([np.arange(len(x)), np.arange(len(x))[::-1]])
    at = np.arange(-(taps - 1), len(x) + taps - 1)
    ext = x[reach[at % len(reach)]]
    high = DB4[::-1] * (-1.0) ** np.arange(1, taps + 1)
    return np.convolve(ext, DB4, "valid")[1::2], np.convolve(ext, high, "valid")[1::2]


def wavelet_details(x: np.ndarray, level: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """Approximation, and details from the finest to the coarsest level."""
    details = []
    for _ in range(level):
        x, d = _analyse(x)
        details.append(d)
    return x, details


def haar_details(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same with the two-point filter, padded with zeros to a power of two, to the last level."""
    size = 1 << max(0, (len(x) - 1).bit_length())
    x, details = np.concatenate([x, np.zeros(size - len(x))]), []
    while len(x) > 1:
        details.append((x[0::2] - x[1::2]) / math.sqrt(2))
        x = (x[0::2] + x[1::2]) / math.sqrt(2)
    return x, details


def wavelet(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Energy of three detail levels: entropy, shares of the finest and coarsest, log changes; zeros below 16 points."""
    side: list[dict] = []
    enough = min(len(x0), len(x1)) >= 16
    for x in standardized(x0, x1) if enough else ():
        e = np.array([(d**2).sum() for d in wavelet_details(x)[1]])
        share = e / (e.sum() + 1e-12)
        side.append({"entropy": float(-(share * np.log(share + 1e-12)).sum() / math.log(3)), "low_energy_share": float(share[-1]), "high_energy_share": float(share[0]), "e": np.log(e + 1e-12)})
    if not enough:
        side = [{"entropy": 0.0, "low_energy_share": 0.0, "high_energy_share": 0.0, "e": np.zeros(3)}] * 2
    out = {f"wav_{k}_{s}": side[i][k] for k in ("entropy", "low_energy_share", "high_energy_share") for i, s in ((0, "pre"), (1, "post"))}
    out |= {f"delta_wav_{k}": side[1][k] - side[0][k] for k in ("entropy", "low_energy_share", "high_energy_share")}
    return out | {f"delta_wav_energy_l{i + 1}": float(side[1]["e"][i] - side[0]["e"][i]) for i in range(3)}


def haar(x0: np.ndarray, x1: np.ndarray, levels: int = 5) -> dict[str, float]:
    """Shares of detail energy of the finest two-point levels, and their changes; zeros where a level is missing."""
    sides = []
    for x in standardized(x0, x1):
        e = np.array([(d**2).sum() for d in haar_details(x)[1][:levels]])
        sides.append(np.pad(e / (e.sum() + 1e-12), (0, levels - len(e))))
    out = {f"haar_share_l{i + 1}_{s}": float(sides[k][i]) for i in range(levels) for k, s in ((0, "pre"), (1, "post"))}
    return out | {f"delta_haar_share_l{i + 1}": float(sides[1][i] - sides[0][i]) for i in range(levels)}


def wavelet_levels(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Energy, spread, size and entropy of each level (a, then d1 the coarsest) as ratio, difference and change."""
    sides = []
    for x in (x0, x1):
        x = np.pad(x, (0, max(0, 8 - len(x))), mode="edge") if len(x) else np.zeros(8)
        a, details = wavelet_details(x)
        levels = {"a": a} | {f"d{i + 1}": d for i, d in enumerate(details[::-1])}
        total = sum((c**2).sum() for c in levels.values())
        s = {}
        for k, c in levels.items():
            p = c**2 / (c**2).sum() if (c**2).sum() else np.zeros(1)
            s |= {f"{k}_energy": (c**2).sum(), f"{k}_std": c.std(), f"{k}_mean_abs": np.abs(c).mean(), f"{k}_entropy": -(p[p > 0] * np.log(p[p > 0])).sum(), f"{k}_energy_pct": (c**2).sum() / (total + 1e-8)}
        sides.append(s | {"total_energy": total})
    out = {}
    for k, a in sides[0].items():
        b = sides[1][k]
        out |= {f"wavelet_{k}_ratio": float(b / (a + 1e-8)), f"wavelet_{k}_diff": float(b - a), f"wavelet_{k}_abs_change": float(abs(b - a))}
    return out | {f"wavelet_{k}_energy_shift": float(sides[1][f"{k}_energy_pct"] - sides[0][f"{k}_energy_pct"]) for k in ("a", "d1", "d2", "d3")}


# Compression.


def _deflated(x: np.ndarray) -> int:
    return len(zlib.compress(x.astype(np.float32).tobytes(), 9))


def _ratio(x: np.ndarray) -> float:
    return _deflated(x) / (4 * len(x)) if len(x) else 1.0


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0
    small, large = sorted((_deflated(a), _deflated(b)))
    return min(1.0, max(0.0, (_deflated(np.concatenate([a, b])) - small) / large))


def lz76(x: np.ndarray) -> int:
    """Phrases of the Lempel-Ziv parsing of the signs around the median."""
    s = "".join("1" if v > m else "0" for m in [np.median(x) if len(x) else 0.0] for v in x)
    count, at, n = 0, 0, len(s)
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        count, at = count + 1, at + size
    return count


def compression(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Deflate ratios, compression distances and Lempel-Ziv counts.

    ``lz_complexity_*`` is 1 by definition (the parsing it names never starts a new phrase);
    ``lz76_*`` is the true count.
    """
    pre, post = _ratio(x0), _ratio(x1)
    near = min(100, len(x0) // 4, len(x1) // 4)
    whole = _distance(x0, x1)
    uneven = [abs(_ratio(x[: len(x) // 2]) - _ratio(x[len(x) // 2 :])) if len(x) >= 100 else 0.0 for x in (x0, x1)]
    density = [1 / (len(x) + 1) for x in (x0, x1)]
    z = [lz76(x) for x in (x0, x1)]
    return {
        "zlib_pre": pre, "zlib_post": post, "zlib_diff": post - pre, "zlib_ratio": post / (pre + 1e-8), "compressibility_increase": pre - post,
        "lz_complexity_pre": 1.0, "lz_complexity_post": 1.0, "lz_complexity_diff": 0.0, "lz_complexity_ratio": 1 / (1 + 1e-8),
        "lz_density_pre": density[0], "lz_density_post": density[1], "lz_density_diff": density[1] - density[0],
        "ncd_pre_post": whole, "ncd_boundary": _distance(x0[len(x0) - near :], x1[:near]) if near > 10 else whole,
        "zlib_pre_consistency": uneven[0], "zlib_post_consistency": uneven[1], "zlib_consistency_change": uneven[1] - uneven[0],
        "lz76_pre": float(z[0]), "lz76_post": float(z[1]),
    }


# Change points under the squared-error cost.


def _costs(x: np.ndarray) -> Callable:
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    return lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)


def pelt(x: np.ndarray, penalty: float = 3.0, least: int = 2, jump: int = 5) -> list[int]:
    """Ends of the segments that minimise cost plus penalty, on a grid, with pruning."""
    n, cost = len(x), _costs(x)
    ends = [*range(jump, n, jump), n]
    best, last, alive = {0: 0.0}, {}, [0]
    for t in ends:
        old = np.array([a for a in alive if t - a >= least])
        if not len(old):
            continue
        value = np.array([best[a] for a in old]) + cost(old, t) + penalty
        k = int(value.argmin())
        best[t], last[t] = float(value[k]), int(old[k])
        alive = [a for a, v in zip(old.tolist(), value) if v - penalty <= best[t]] + [a for a in alive if t - a < least] + [t]
    out, t = [], n
    while t in last:
        out.append(t)
        t = last[t]
    return out[::-1] or [n]


def change_points(x0: np.ndarray, x1: np.ndarray, longest: int | None = None) -> dict[str, float]:
    """Where three searches put a change in the joined series, against the boundary.

    Series of every length are searched; with ``longest`` the first search leaves out longer ones.
    """
    x = np.concatenate([x0, x1])
    n, true = len(x), len(x0) / max(1, len(x0) + len(x1))
    ends = pelt(x) if 4 <= n <= (longest or n) else [n]
    gaps = np.diff(ends)
    first = ends[0] / n if len(ends) > 1 else 0.5
    cost = _costs(x) if n else None
    grid = np.array([k for k in range(5, n, 5) if k >= 2 and n - k >= 2])
    split = grid[(cost(0, grid) + cost(grid, n)).argmin()] / n if len(grid) else 0.5
    width = max(5, min(50, n // 3))
    half = width // 2
    mid = np.array([k for k in range(5, n, 5) if k >= half and k + half <= n])
    slide = mid[(cost(mid - half, mid + half) - cost(mid - half, mid) - cost(mid, mid + half)).argmax()] / n if len(mid) else 0.5
    return {
        "pelt_l2_n_changepoints": float(len(ends) - 1), "pelt_l2_first_cp_pos": first, "pelt_l2_avg_distance": float(gaps.mean() / n) if len(ends) > 2 else 1.0,
        "binseg_l2_cp_pos": float(split), "binseg_l2_cp_from_mid": float(abs(split - 0.5)), "window_l2_cp_pos": float(slide), "cp_actual_pos": true,
        "pelt_l2_first_cp_pos_error": abs(first - true), "binseg_l2_cp_pos_error": float(abs(split - true)), "window_l2_cp_pos_error": float(abs(slide - true)),
    }


# Exponential smoothing and the local-level filter.


def ewma(x: np.ndarray, alpha: float = 2 / 21) -> np.ndarray:
    out = np.empty(len(x))
    level = x[0] if len(x) else 0.0
    for i, v in enumerate(x):
        level = level + alpha * (v - level) if i else v
        out[i] = level
    return out


def smoothed(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Contrasts of the smoothed joined series and of the residuals over their smoothed spread."""
    x = np.concatenate([x0, x1])
    level = ewma(x)
    rest = np.full(len(x), NAN)
    if len(x) > 1:
        spread = pd.Series(x).ewm(alpha=2 / 21, adjust=False).std().to_numpy()
        rest = (x - level) / (spread + 1e-8)
    out = {}
    for name, v in (("ewma", level), ("residual", rest)):
        a, b = v[: len(x0)], v[len(x0) :]
        a, b = a[~np.isnan(a)], b[~np.isnan(b)]
        fine = len(a) >= 5 and len(b) >= 5
        out |= {f"mean_diff_{name}": float(b.mean() - a.mean()) if fine else NAN, f"std_ratio_{name}": float(b.std() / (a.std() + 1e-8)) if fine else NAN, f"median_diff_{name}": float(np.median(b) - np.median(a)) if fine else NAN}
    return out


def innovations(x: np.ndarray, q: float, r: float = 1.0) -> np.ndarray:
    """One-step errors of a local-level filter that starts at the first value."""
    level, *rest = x.tolist()
    p, out = r, []
    for v in rest:
        p += q
        gain = p / (p + r)
        error = v - level
        out.append(error)
        level += gain * error
        p *= 1 - gain
    return np.array(out)


def _fitted(x: np.ndarray) -> tuple[float, float]:
    """Process variance of a grid with the least Gaussian loss, and its innovation variance."""
    best = (math.inf, NAN, NAN)
    for q in np.logspace(-3, 0, 5):
        e = innovations(x, q)
        v = float(e.var())
        if v > 0:
            best = min(best, (0.5 * float((e**2).sum()) / v + 0.5 * len(e) * math.log(v), float(q), v))
    return best[1], best[2]


def kalman(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Local-level filter fitted before and run after the boundary, full and by window."""
    a, b = clipped(x0, x1) if len(x0) >= 3 else (x0, x1)
    out: dict[str, float] = {}
    for w in (None, 25, 50, 100):
        p, s = (a, b) if w is None else (a[-w:], b[:w])
        end = "" if w is None else f"_w{w}"
        q = before = after = rmse = NAN
        if len(p) >= 3 and len(s) >= 2 and (w is None or min(len(a), len(b)) >= w):
            q, before = _fitted(p)
            if not math.isnan(q):
                e = innovations(s, q)
                after, rmse = float(e.var()), float(np.sqrt((e**2).mean()))
        log = math.log(after / (before + 1e-10)) if before > 1e-10 and after > 0 else NAN
        if w is None:
            out |= {"kf_process_var_pre": q, "kf_innov_var_pre": before, "kf_innov_var_post": after, "kf_log_innov_var_ratio": log, "kf_rmse_cross_pred": rmse, "kf_innov_var_cross_pred": after}
        else:
            out |= {f"kf_innov_var_pre{end}": before, f"kf_innov_var_post{end}": after, f"kf_log_innov_var_ratio{end}": log, f"kf_rmse_cross{end}": rmse}
    return out


def _lag_one(x: np.ndarray) -> float:
    """Autocovariance at one step over the variance, kept inside the unit circle; 0 for a constant."""
    spread = float(x.var())
    if len(x) < 3 or spread < 1e-10:
        return 0.0
    c = x - x.mean()
    return float(np.clip((c[1:] * c[:-1]).sum() / (len(x) - 1) / spread, -0.999, 0.999))


def _errors(x: np.ndarray, phi: float) -> tuple[float, float]:
    e = x[1:] - phi * x[:-1]
    return float(np.sqrt((e**2).mean())), float(e.var())


def _second_order(x: np.ndarray, phi: float) -> tuple[float, float, float, float]:
    """Two coefficients by ridge least squares, error variance and error; of the first order if that is unstable."""
    if len(x) < 5:
        return (NAN,) * 4
    lags, y = np.stack([x[1:-1], x[:-2]], axis=1), x[2:]
    g = np.linalg.solve(lags.T @ lags + 1e-6 * np.eye(2), lags.T @ y)
    if np.abs(np.roots([1, -g[0], -g[1]])).max() >= 0.999:
        rmse, spread = _errors(x, phi)
        return phi, 0.0, spread, rmse
    e = y - lags @ g
    return float(g[0]), float(g[1]), float(e.var()), float(np.sqrt((e**2).mean()))


def _line(x: np.ndarray) -> tuple[float, float, float]:
    """Level, slope and error of the least-squares line over 0, 1, .."""
    if len(x) < 2:
        return (NAN,) * 3
    t = np.arange(len(x)) - (len(x) - 1) / 2
    slope = float((t * x).sum() / (t * t).sum())
    level = float(x.mean()) - slope * (len(x) - 1) / 2
    return level, slope, float(np.sqrt((_off_line(x, level, slope) ** 2).mean()))


def _off_line(x: np.ndarray, level: float, slope: float) -> np.ndarray:
    return x - level - slope * np.arange(len(x))


def ar_kalman_block(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """All 67 statistics of autoregression (30), local-level filter (18) and trend (19), full and at windows of 25, 50 and 100.

    Both segments are clipped and standardised by the first. Nothing is defined for fewer than
    three points before or two after, nor a window for segments shorter than it.
    """
    out: dict[str, float] = {}
    fine = len(x0) >= 3 and len(x1) >= 2
    a, b = clipped(x0, x1) if fine else (x0, x1)
    for w in (None, 25, 50, 100):
        end = "" if w is None else f"_w{w}"
        held = fine and (w is None or min(len(a), len(b)) >= w)
        p, s = (a, b) if w is None else (a[-w:], b[:w])
        phi, own, after, own_after, across = NAN, (NAN, NAN), NAN, (NAN, NAN), (NAN, NAN)
        line, line_after, cross, drift = (NAN,) * 3, (NAN,) * 3, NAN, NAN
        if held:
            phi, after = _lag_one(p), _lag_one(s)
            own, own_after, across = _errors(p, phi), _errors(s, after), _errors(s, phi)
            line, line_after = _line(p), _line(s)
            rest = _off_line(s, *line[:2])
            cross, drift = float(np.sqrt((rest**2).mean())), float(rest.mean())
        if w is None:
            ratio = math.log(own_after[1] / (own[1] + 1e-10)) if own[1] > 1e-10 and own_after[1] > 0 else NAN
            out |= {"ar1_phi_pre": phi, "ar1_phi_post": after, "ar1_delta_phi": after - phi, "ar1_resid_var_pre": own[1], "ar1_resid_var_post": own_after[1], "ar1_log_resid_var_ratio": ratio}
            out |= {"ar1_rmse_pre": own[0], "ar1_rmse_post": own_after[0], "ar1_rmse_cross_pred": across[0], "ar1_resid_var_cross_pred": across[1], "ar1_delta_rmse_cross": across[0] - own[0]}
            out |= dict(zip(("ar2_phi1_pre", "ar2_phi2_pre", "ar2_resid_var_pre", "ar2_rmse_pre"), _second_order(a, phi) if held else (NAN,) * 4))
            out |= {"trend_slope_pre": line[1], "trend_slope_post": line_after[1], "trend_delta_slope": line_after[1] - line[1], "trend_rmse_pre": line[2], "trend_rmse_post": line_after[2], "trend_rmse_cross": cross, "trend_mean_error_cross": drift}
        else:
            out |= {f"ar1_phi_pre{end}": phi, f"ar1_phi_post{end}": after, f"ar1_delta_phi{end}": after - phi, f"ar1_rmse_pre{end}": own[0], f"ar1_rmse_cross{end}": across[0]}
            out |= {f"trend_slope_pre{end}": line[1], f"trend_slope_post{end}": line_after[1], f"trend_delta_slope{end}": line_after[1] - line[1], f"trend_rmse_cross{end}": cross}
    return out | (kalman(x0, x1) if fine else dict.fromkeys(kalman(np.arange(4.0), np.arange(4.0)), NAN))


def kalman_grid(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """The process variance that each segment by itself would choose, and its innovation variance."""
    a, b = clipped(x0, x1) if len(x0) >= 3 else (x0, x1)
    fits = [_fitted(x) if len(x) >= 3 else (NAN, NAN) for x in (a, b)]
    return {f"kf_{k}_{s}": fits[i][j] for j, k in enumerate(("grid_process_var", "grid_innov_var")) for i, s in ((0, "pre"), (1, "post"))}


def _ar1(x: np.ndarray) -> tuple[float, float, float]:
    """Yule-Walker coefficient, residual variance and one-step error of a segment."""
    centred = x - x.mean()
    g0 = float(x.var(ddof=1))
    if g0 < 1e-10:
        return 0.0, g0, _one_step(x, 0.0)[0]
    phi = float((centred[1:] * centred[:-1]).mean() / g0)
    return phi, max(0.0, g0 * (1 - phi * phi)), _one_step(x, phi)[0]


def _one_step(x: np.ndarray, phi: float) -> tuple[float, float]:
    error = x[1:] - phi * x[:-1]
    return float(np.sqrt((error**2).mean())), float(error.var(ddof=1)) if len(error) > 1 else NAN


def _moments(x: np.ndarray) -> tuple[float, float]:
    """Process and observation variance from the spread of values and of steps."""
    r = float(np.diff(x).var(ddof=1)) / 2
    return max(float(x.var(ddof=1)) - r, r / 10), r


def ar_kalman(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """Autoregression and a local-level filter with estimated noise, before, after and across, and by window.

    Not defined for a segment below three points or a constant first segment.
    """

    def prepared(a: np.ndarray, b: np.ndarray, clip: bool) -> tuple[np.ndarray, np.ndarray] | None:
        if min(len(a), len(b)) < 3:
            return None
        if clip:
            low, high = np.quantile(a, [0.01, 0.99])
            a, b = np.clip(a, low, high), np.clip(b, low, high)
        sd = a.std(ddof=1)
        return None if sd < 1e-8 else ((a - a.mean()) / sd, (b - a.mean()) / sd)

    log = lambda a, b: math.log(b / a) if min(a, b) > 1e-10 else 0.0
    out: dict[str, float] = {}
    full = prepared(x0, x1, True)
    pre = post = (NAN,) * 3
    cross, filtered = (NAN, NAN), [NAN] * 5
    if full:
        a, b = full
        pre, post, cross = _ar1(a), _ar1(b), _one_step(b, _ar1(a)[0])
        noise = [_moments(x) for x in full]
        if noise[0][1] > 0 and noise[1][1] > 0 and min(len(a), len(b)) > 3:
            e, own, over = innovations(a, *noise[0]), innovations(b, *noise[1]), innovations(b, *noise[0])
            v, w = float(e.var(ddof=1)), float(own.var(ddof=1))
            filtered = [v, w, log(v, w), float(np.sqrt((e**2).mean())), float(np.sqrt((over**2).mean()))]
    out |= {"ar1_phi_pre": pre[0], "ar1_phi_post": post[0], "delta_ar1_phi": abs(post[0] - pre[0]), "ar1_resid_var_pre": pre[1], "ar1_resid_var_post": post[1], "log_resid_var_ratio": log(pre[1], post[1]) if full else NAN}
    out |= {"ar1_rmse_pre": pre[2], "ar1_rmse_post": post[2], "delta_ar1_rmse": abs(post[2] - pre[2]), "rmse_post_pred_by_pre": cross[0], "resid_var_post_pred_by_pre": cross[1]}
    out |= dict(zip(("kalman_innov_var_pre", "kalman_innov_var_post", "log_kalman_innov_ratio", "kalman_rmse_pre", "kalman_rmse_post_pred_by_pre"), filtered))
    for w in (25, 50, 100):
        near = prepared(x0[-w:], x1[:w], False)
        p, q, c = (_ar1(near[0]), _ar1(near[1]), _one_step(near[1], _ar1(near[0])[0])[0]) if near else ((NAN,) * 3, (NAN,) * 3, NAN)
        out |= {f"ar1_phi_pre_w{w}": p[0], f"ar1_phi_post_w{w}": q[0], f"delta_ar1_phi_w{w}": abs(q[0] - p[0]), f"ar1_rmse_pre_w{w}": p[2], f"rmse_post_pred_by_pre_w{w}": c, f"delta_ar1_rmse_w{w}": abs(q[2] - p[2])}
    return out


# Probabilities of the two-sample tests.


def cvm_tail(t: float) -> float:
    """Upper tail of the limiting Cramér-von Mises distribution, by inverting its characteristic function.

    The squared statistic is a weighted sum of chi-squares with weights 1 / (k pi)^2, so
    P(T > t) = 1/2 + 1/pi * integral of sin(theta(u)) / (u rho(u)).
    """
    u = (np.arange(4000) + 0.5) * 0.05
    weight = 1 / (math.pi * np.arange(1, 400)) ** 2
    turn = 0.5 * np.arctan(np.outer(u, weight)).sum(axis=1) - 0.5 * t * u
    size = np.exp(0.25 * np.log1p(np.outer(u, weight) ** 2).sum(axis=1))
    return float(min(1.0, max(0.0, 0.5 + (np.sin(turn) / (u * size)).sum() * 0.05 / math.pi)))


def _limit(t: float, n: int, m: int) -> float:
    """The statistic brought to the limit's mean 1/6 and variance 1/45."""
    total = n + m
    mean = (1 + 1 / total) / 6
    spread = (total + 1) * (4 * n * m * total - 3 * (n * n + m * m) - 2 * n * m) / (45 * total**2 * 4 * n * m)
    return 1 / 6 + (t - mean) / math.sqrt(45 * spread)


def cvm_statistic(x0: np.ndarray, x1: np.ndarray) -> float:
    """Two-sample statistic with mid-ranks."""
    n, m = len(x0), len(x1)
    both = np.sort(np.concatenate([x0, x1]))
    total = 0.0
    for x, size in ((np.sort(x0), n), (np.sort(x1), m)):
        rank = (np.searchsorted(both, x, "left") + np.searchsorted(both, x, "right") + 1) / 2
        total += size * ((rank - np.arange(1, size + 1)) ** 2).sum()
    return float(total / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov(d: float, n: int, m: int) -> float:
    """Asymptotic series; exact tables are not used."""
    t = d * math.sqrt(n * m / (n + m))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    f = d
    for k in range(1, 400):
        for num in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


def f_share(f: float, n: float, m: float) -> float:
    return beta_share(n / 2, m / 2, n * f / (n * f + m)) if f > 0 else 0.0


def test_probabilities(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """p-values of the variance ratio, Levene, Kolmogorov-Smirnov, rank-sum, Mood and Cramér-von Mises tests."""
    names = ("f_test_p", "levene_p", "ks_p", "wilcoxon_pval", "mood_pval", "cvm_pval")
    n, m = len(x0), len(x1)
    if min(n, m) < 3:
        return dict.fromkeys(names, NAN)
    v0, v1 = x0.var(ddof=1), x1.var(ddof=1)
    share = f_share(v0 / v1, n - 1, m - 1) if v1 > 0 else NAN
    z = [np.abs(x - np.median(x)) for x in (x0, x1)]
    mean = np.concatenate(z).mean()
    within = sum(((a - a.mean()) ** 2).sum() for a in z)
    levene = (n + m - 2) * sum(len(a) * (a.mean() - mean) ** 2 for a in z) / within if within > 0 else NAN
    both = np.concatenate([x0, x1])
    ordered = np.sort(both)
    low, high = np.searchsorted(ordered, both, "left"), np.searchsorted(ordered, both, "right")
    rank, total = (low + high + 1) / 2, n + m
    gap = np.abs(np.searchsorted(np.sort(x0), ordered, "right") / n - np.searchsorted(np.sort(x1), ordered, "right") / m).max()
    w = (rank[:n].sum() - n * (total + 1) / 2) / math.sqrt(n * m * (total + 1) / 12)
    mood = (((rank[:n] - (total + 1) / 2) ** 2).sum() - n * (total**2 - 1) / 12) / math.sqrt(n * m * (total + 1) * (total + 2) * (total - 2) / 180)
    values = (2 * min(share, 1 - share), 1 - f_share(levene, 1, total - 2), kolmogorov(float(gap), n, m), normal_tail(w), normal_tail(mood), cvm_tail(_limit(cvm_statistic(x0, x1), n, m)))
    return dict(zip(names, map(float, values)))


# Reconstruction of sliding windows.


def reconstruction(x0: np.ndarray, x1: np.ndarray, size: int = 20, stride: int = 5, kept: int = 5) -> dict[str, float]:
    """Error of rebuilding windows from the leading components of the first segment's windows.

    The linear counterpart of a narrow autoencoder trained on the first segment, without its
    random start.
    """
    a, b = standardized(x0, x1)
    if not len(a) or not len(b):
        return dict.fromkeys(("ae_recon_error_pre", "ae_recon_error_post", "ae_recon_error_ratio", "ae_recon_error_diff"), NAN)

    def windows(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, (0, max(0, size - len(x))), mode="edge")
        return np.lib.stride_tricks.sliding_window_view(x, size)[::stride]

    train = windows(a)
    mean = train.mean(axis=0)
    _, spread, basis = np.linalg.svd(train - mean, full_matrices=False)
    basis = basis[:kept][spread[:kept] > 1e-9 * (spread[0] + 1e-9)]
    error = [float((((w - mean) - (w - mean) @ basis.T @ basis) ** 2).mean()) for w in (train, windows(b))]
    return {"ae_recon_error_pre": error[0], "ae_recon_error_post": error[1], "ae_recon_error_ratio": error[1] / (error[0] + 1e-8), "ae_recon_error_diff": error[1] - error[0]}


#: Families by the name of their query.
FUNCTIONS: dict[str, Callable[[np.ndarray, np.ndarray], dict[str, float]]] = {
    "spectral": spectral,
    "spectral_advanced": spectral_distance,
    "wavelet": wavelet,
    "wavelet_levels": wavelet_levels,
    "haar_dwt": haar,
    "compression": compression,
    "pelt": change_points,
    "transform_ewma": smoothed,
    "kalman_local_level": kalman,
    "kalman_grid": kalman_grid,
    "ar_kalman_block": ar_kalman_block,
    "ar_kalman_estimated": ar_kalman,
    "test_pvalues": test_probabilities,
    "autoencoder_substitute": reconstruction,
}

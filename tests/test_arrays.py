"""The numpy statistics, which those in SQL are compared with, against slow derivations from their definitions."""

from __future__ import annotations

import cmath
import itertools
import math

import numpy as np
import pytest

from . import numpy_series as arrays

RNG = np.random.default_rng(11)
X0, X1 = RNG.normal(size=61), RNG.normal(0.7, 1.8, size=74).round(2)


def scaled(x0, x1):
    return [(x - x0.mean()) / x0.std() for x in (x0, x1)]


def power(x):
    """Shares of the Hann-windowed power spectrum, by the sums of its definition."""
    n = len(x)
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    p = [abs(sum(x[i] * w[i] * cmath.exp(-2j * math.pi * k * i / n) for i in range(n))) ** 2 for k in range(n // 2 + 1)]
    return [k / n for k in range(n // 2 + 1)], [v / sum(p) for v in p]


def test_spectral():
    got = arrays.spectral(X0, X1)
    shapes = []
    for x in scaled(X0, X1):
        f, p = power(x)
        total, half = 0.0, f[-1]
        for k, v in zip(f, p):
            total += v
            if total >= 0.5:
                half = k
                break
        centre = sum(a * b for a, b in zip(f, p))
        shapes.append(
            {
                "log_low_high": math.log(sum(b for a, b in zip(f, p) if a <= 0.08) / sum(b for a, b in zip(f, p) if a > 0.08)),
                "spec_entropy": -sum(v * math.log(v) for v in p) / math.log(len(p)),
                "peak_ratio": max(p[1:]),
                "flatness": math.exp(sum(map(math.log, p)) / len(p)) * len(p),
                "flux": sum((b - a) ** 2 for a, b in zip(p, p[1:])) / (len(p) - 1),
                "rolloff50": half,
                "bandwidth": math.sqrt(sum((a - centre) ** 2 * b for a, b in zip(f, p))),
                "hf_power": sum(b for a, b in zip(f, p) if a > 0.15),
            }
        )
    for k in shapes[0]:
        assert got[f"delta_{k}"] == pytest.approx(shapes[1][k] - shapes[0][k], rel=1e-4, abs=1e-6)
    assert got["spec_entropy_pre"] == pytest.approx(shapes[0]["spec_entropy"], rel=1e-4)


def test_spectral_distance():
    got = arrays.spectral_distance(X0, X1)
    n = min(len(X0), len(X1)) // 2
    sides = []
    for x in (X0, X1):
        a = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / len(x)) for i, v in enumerate(x))) for k in range(len(x) // 2)]
        sides.append([v / sum(a) for v in a][:n])
    p, q = sides
    assert got["spectral_l1_distance"] == pytest.approx(sum(abs(a - b) for a, b in zip(p, q)), abs=1e-6)
    assert got["spectral_kl_divergence"] == pytest.approx(sum(a * math.log(a / b) for a, b in zip(p, q)), abs=1e-4)
    assert got["spectral_dominant_freq_shift"] == pytest.approx(abs(p.index(max(p)) - q.index(max(q))) / n)
    assert got["spectral_low_freq_ratio"] == pytest.approx(sum(v * v for v in q[: n // 4]) / sum(v * v for v in p[: n // 4]), rel=1e-4)


def test_wavelets_by_their_sums():
    """Each coefficient is the filter against the series mirrored at both ends."""
    x, taps = X0, arrays.DB4
    mirrored = lambda i: x[i if 0 <= i < len(x) else -1 - i if i < 0 else 2 * len(x) - 1 - i]
    low = [sum(taps[j] * mirrored(2 * k + 1 - j) for j in range(8)) for k in range((len(x) + 7) // 2)]
    high = [sum((-1) ** (j + 1) * taps[7 - j] * mirrored(2 * k + 1 - j) for j in range(8)) for k in range((len(x) + 7) // 2)]
    approximation, detail = arrays._analyse(x)
    assert np.allclose(approximation, low)
    assert np.allclose(np.abs(detail), np.abs(high))
    energies = []
    for side in scaled(X0, X1):
        e = [float((d**2).sum()) for d in arrays.wavelet_details(side)[1]]
        share = [v / sum(e) for v in e]
        energies.append((-sum(v * math.log(v) for v in share) / math.log(3), share[-1], e))
    got = arrays.wavelet(X0, X1)
    assert got["delta_wav_entropy"] == pytest.approx(energies[1][0] - energies[0][0], abs=1e-6)
    assert got["wav_low_energy_share_post"] == pytest.approx(energies[1][1])
    assert got["delta_wav_energy_l2"] == pytest.approx(math.log(energies[1][2][1] / energies[0][2][1]))


def test_wavelet_levels():
    got = arrays.wavelet_levels(X0, X1)
    sides = [arrays.wavelet_details(x) for x in (X0, X1)]
    assert len(got) == 67
    assert got["wavelet_d1_energy_diff"] == pytest.approx((sides[1][1][2] ** 2).sum() - (sides[0][1][2] ** 2).sum())
    assert got["wavelet_a_std_ratio"] == pytest.approx(np.std(sides[1][0]) / np.std(sides[0][0]), rel=1e-6)
    total = [(a**2).sum() + sum((d**2).sum() for d in ds) for a, ds in sides]
    assert got["wavelet_d3_energy_shift"] == pytest.approx((sides[1][1][0] ** 2).sum() / total[1] - (sides[0][1][0] ** 2).sum() / total[0])


def test_haar():
    """A detail at level l is the difference of the means of two halves of 2 ** l points, times their root."""
    got = arrays.haar(X0, X1, 3)
    for i, side in enumerate(scaled(X0, X1)):
        x = np.concatenate([side, np.zeros((1 << math.ceil(math.log2(len(side)))) - len(side))])
        e = []
        for level in (1, 2, 3):
            w = 1 << level
            blocks = x.reshape(-1, w)
            e.append(((blocks[:, : w // 2].sum(axis=1) - blocks[:, w // 2 :].sum(axis=1)) ** 2).sum() / w)
        for level in (1, 2, 3):
            assert got[f"haar_share_l{level}_{('pre', 'post')[i]}"] == pytest.approx(e[level - 1] / sum(e))


def test_compression():
    import zlib

    size = lambda x: len(zlib.compress(np.asarray(x, "<f4").tobytes(), 9))
    got = arrays.compression(X0, X1)
    a, b = size(X0), size(X1)
    assert got["zlib_pre"] == a / (4 * len(X0)) and got["zlib_post"] == b / (4 * len(X1))
    assert got["ncd_pre_post"] == pytest.approx(min(1, max(0, (size([*X0, *X1]) - min(a, b)) / max(a, b))))
    near = min(len(X0), len(X1)) // 4
    c, d = size(X0[-near:]), size(X1[:near])
    assert got["ncd_boundary"] == pytest.approx(min(1, max(0, (size([*X0[-near:], *X1[:near]]) - min(c, d)) / max(c, d))))


@pytest.mark.parametrize("seed", range(6))
def test_pelt_finds_the_cheapest_segments(seed):
    """Against all subsets of the grid; also for series beyond 500 points, that a cap would leave out."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 1, 12) for m in rng.normal(0, 3, 4)])
    cost = lambda cut: sum(((s := x[a:b]) - s.mean()).dot(s - s.mean()) + 3.0 for a, b in zip((0, *cut), (*cut, len(x))))
    grid = range(5, len(x), 5)
    best = min(cost(c) for k in range(len(grid) + 1) for c in itertools.combinations(grid, k))
    assert cost(tuple(arrays.pelt(x)[:-1])) == pytest.approx(best)
    long = np.concatenate([rng.normal(0, 0.1, 400), rng.normal(9, 0.1, 400)])
    assert arrays.change_points(long[:400], long[400:])["pelt_l2_first_cp_pos"] == pytest.approx(0.5)
    assert arrays.change_points(long[:400], long[400:], longest=500)["pelt_l2_n_changepoints"] == 0


def test_split_and_window_searches():
    x = np.concatenate([X0, X1])
    n, loss = len(x), lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    got = arrays.change_points(X0, X1)
    assert got["binseg_l2_cp_pos"] == pytest.approx(min(range(5, n, 5), key=lambda k: loss(0, k) + loss(k, n)) / n)
    half = max(5, min(50, n // 3)) // 2
    assert got["window_l2_cp_pos"] == pytest.approx(max((k for k in range(5, n, 5) if k >= half and k + half <= n), key=lambda k: loss(k - half, k + half) - loss(k - half, k) - loss(k, k + half)) / n)
    assert got["cp_actual_pos"] == len(X0) / n


def test_smoothing():
    x, alpha = np.concatenate([X0, X1]), 2 / 21
    level = [sum(alpha * (1 - alpha) ** (i - j) * x[j] for j in range(1, i + 1)) + (1 - alpha) ** i * x[0] for i in range(len(x))]
    got = arrays.smoothed(X0, X1)
    assert got["mean_diff_ewma"] == pytest.approx(np.mean(level[len(X0) :]) - np.mean(level[: len(X0)]))
    assert got["median_diff_ewma"] == pytest.approx(np.median(level[len(X0) :]) - np.median(level[: len(X0)]))


def test_innovations_are_errors_of_the_best_linear_prediction():
    """Conditional means of the joint normal distribution, by solving its equations."""
    x, q = X0[:14], 0.3
    got = arrays.innovations(x, q)
    # Level at time t given the first value: variance 1 + t q; observations add 1.
    for t in range(1, len(x)):
        past = x[1:t] - x[0]
        k = t - 1
        cov = np.array([[1 + (min(i, j) + 1) * q for j in range(k)] for i in range(k)]) + np.eye(k)
        cross = np.array([1 + (i + 1) * q for i in range(k)])
        predicted = x[0] + (cross @ np.linalg.solve(cov, past) if k else 0.0)
        assert got[t - 1] == pytest.approx(x[t] - predicted)


def test_grid_takes_the_likeliest_variance():
    a, b = arrays.clipped(X0, X1)
    got = arrays.kalman_grid(X0, X1)
    for x, end in ((a, "pre"), (b, "post")):
        loss = {}
        for q in np.logspace(-3, 0, 5):
            e = arrays.innovations(x, q)
            loss[q] = 0.5 * (e**2).sum() / e.var() + 0.5 * len(e) * math.log(e.var())
        assert got[f"kf_grid_process_var_{end}"] == pytest.approx(min(loss, key=loss.get))


def test_estimated_block():
    got = arrays.ar_kalman(X0, X1)
    low, high = np.quantile(X0, [0.01, 0.99])
    a, b = (np.clip(x, low, high) for x in (X0, X1))
    a, b = (a - a.mean()) / a.std(ddof=1), (b - a.mean()) / a.std(ddof=1)
    assert len(got) == 34
    phi = sum((a[i] - a.mean()) * (a[i - 1] - a.mean()) for i in range(1, len(a))) / (len(a) - 1) / a.var(ddof=1)
    assert got["ar1_phi_pre"] == pytest.approx(phi)
    assert got["rmse_post_pred_by_pre"] == pytest.approx(math.sqrt(sum((b[i] - phi * b[i - 1]) ** 2 for i in range(1, len(b))) / (len(b) - 1)))


def test_reconstruction_is_that_of_leading_components():
    a, b = scaled(X0, X1)
    windows = [np.array([x[i : i + 20] for i in range(0, len(x) - 19, 5)]) for x in (a, b)]
    mean = windows[0].mean(axis=0)
    _, vectors = np.linalg.eigh((windows[0] - mean).T @ (windows[0] - mean))
    keep = vectors[:, -5:]
    errors = [float((((w - mean) - (w - mean) @ keep @ keep.T) ** 2).mean()) for w in windows]
    got = arrays.reconstruction(X0, X1)
    assert got["ae_recon_error_pre"] == pytest.approx(errors[0]) and got["ae_recon_error_post"] == pytest.approx(errors[1])

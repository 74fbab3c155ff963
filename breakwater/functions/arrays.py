"""The few functions of an array that Spark SQL has no primitive for, each a small Arrow function.

All else about a series is SQL over its rows: these give a spectrum, the size of a deflated
array, the phrases of a parsing, and the error of a reconstruction.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def power_of(x: np.ndarray) -> np.ndarray:
    """Squared amplitudes of a segment under a Hann window, from frequency 0 to one half."""
    return np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2


def amplitude_of(x: np.ndarray) -> np.ndarray:
    """Amplitudes of a segment's frequencies below one half."""
    return np.abs(np.fft.fft(x))[: len(x) // 2] if len(x) > 1 else np.empty(0)


def deflated_of(x: np.ndarray) -> int:
    """Bytes of a segment in single precision, deflated at the highest level."""
    return len(zlib.compress(np.asarray(x, np.float32).tobytes(), 9))


def phrases_of(x: np.ndarray) -> int:
    """Phrases of the Lempel-Ziv parsing of the signs around the median."""
    s = "".join("1" if v > m else "0" for m in [np.median(x) if len(x) else 0.0] for v in x)
    count, at = 0, 0
    while at < len(s):
        size = 1
        while at + size <= len(s) and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        count, at = count + 1, at + size
    return count


def rebuilt_of(pre: np.ndarray, post: np.ndarray, size: int = 20, stride: int = 5, kept: int = 5) -> list[float]:
    """Mean squared errors of rebuilding both segments' windows from the leading components of the first one's.

    The linear counterpart of a narrow autoencoder trained on the first segment, without its
    random start.
    """
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, size - len(x))), mode="edge"), size)[::stride]
    train, other = cut(pre), cut(post)
    mean = train.mean(axis=0)
    _, spread, basis = np.linalg.svd(train - mean, full_matrices=False)
    basis = basis[:kept][spread[:kept] > 1e-9 * (spread[0] + 1e-9)]  # directions that the windows have
    return [float((((w - mean) - (w - mean) @ basis.T @ basis) ** 2).mean()) for w in (train, other)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def power(xs: pd.Series) -> pd.Series:
    return xs.map(power_of)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def amplitude(xs: pd.Series) -> pd.Series:
    return xs.map(amplitude_of)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def deflated(parts: pd.Series) -> pd.Series:
    """Sizes of the arrays in an array."""
    return parts.map(lambda ps: [deflated_of(p) for p in ps])


@F.pandas_udf(T.IntegerType())
def phrases(xs: pd.Series) -> pd.Series:
    return xs.map(phrases_of)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rebuilt(pre: pd.Series, post: pd.Series) -> pd.Series:
    return pd.Series([rebuilt_of(a, b) for a, b in zip(pre, post)])

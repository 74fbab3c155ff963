"""Feature functions of users, over any transform of a series, from Python and from SQL.

A function takes the values before and after the boundary as two arrays and returns numbers by
name. It is registered as a table function with a declared schema, so SQL calls it in a
lateral join; what it lacks, or what is not finite, is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakwater.operators import dynamics
from breakwater.sources import series

TRANSFORMS = ("raw", "diff", "cumsum")


def register(spark: SparkSession, name: str, function: Callable[[np.ndarray, np.ndarray], dict[str, float]], fields: tuple[str, ...]) -> None:
    """Makes ``name(x0, x1)`` a table function of one row with ``fields``, doubles.

    Null arrays and values that are null or NaN are left out before the call; if a side has no
    value left, all fields are null and the function is not called.
    """

    class Call:
        def eval(self, x0: list, x1: list) -> Iterator[tuple]:
            a, b = (np.array([v for v in x or [] if v is not None and v == v], float) for x in (x0, x1))
            found = function(a, b) if len(a) and len(b) else {}
            yield tuple(float(found[f]) if found.get(f) is not None and math.isfinite(found[f]) else None for f in fields)

    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])
    spark.udtf.register(name, F.udtf(Call, returnType=schema))


def segment_arrays(table: DataFrame, transforms: tuple[str, ...] = TRANSFORMS) -> DataFrame:
    """``id, transform, x0, x1``: both segments of each series under each transform, in order. A row holds one series."""
    segs = series.with_positions(table)
    rows = reduce(DataFrame.unionByName, [dynamics.transformed(segs, t).select("id", F.lit(t).alias("transform"), "seq", "period", "value") for t in transforms])
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("period") == k, F.struct("seq", F.col("value").cast("double").alias("v"))))), lambda p: p["v"])
    return rows.groupBy("id", "transform").agg(side(0).alias("x0"), side(1).alias("x1"))


def user_features(table: DataFrame, name: str, fields: tuple[str, ...], transforms: tuple[str, ...] = TRANSFORMS) -> DataFrame:
    """``id`` and ``<field>_<transform>`` of a registered function, for each series of ``table(id, seq, period, value)``."""
    arrays = segment_arrays(table, transforms)
    long = table.sparkSession.sql(f"SELECT a.id, a.transform, f.* FROM {{arrays}} a, LATERAL {name}(a.x0, a.x1) f", arrays=arrays)
    return long.groupBy("id").agg(*[F.max(F.when(F.col("transform") == t, F.col(f))).alias(f"{f}_{t}") for t in transforms for f in fields])


def swing(x0: np.ndarray, x1: np.ndarray) -> dict[str, float]:
    """An example: how much further the second segment swings, and how much of it leaves the first one's range."""
    low, high = x0.min(), x0.max()
    return {"swing": (x1.max() - x1.min()) / (high - low) if high > low else math.nan, "outside": float(((x1 < low) | (x1 > high)).mean())}


def user_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, "swing", swing, ("swing", "outside"))
    found = user_features(series.segments(spark, sf_dir), "swing", ("swing", "outside"))
    return found.select("id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in found.columns if c != "id"])


def _oracle() -> str:
    parts = []
    for t in TRANSFORMS:
        text = dynamics._TRANSFORMS[t].replace("{seg}", "seg")
        parts.append(f"SELECT id, '{t}' AS transform, period, value FROM ({text}) x")
    columns = ", ".join(f"max(CASE WHEN transform = '{t}' THEN round({c} + 1e-9, 4) END) AS {c}_{t}" for t in TRANSFORMS for c in ("swing", "outside"))
    return (
        f"WITH seg AS ({series.segments_sql()}), r AS ({' UNION ALL '.join(parts)}), "
        "e AS (SELECT id, transform, min(value) FILTER (WHERE period = 0) AS lo, max(value) FILTER (WHERE period = 0) AS hi, max(value) FILTER (WHERE period = 1) - min(value) FILTER (WHERE period = 1) AS w FROM r GROUP BY id, transform), "
        "f AS (SELECT r.id, r.transform, max(CASE WHEN hi > lo THEN w / (hi - lo) END) AS swing, avg(CASE WHEN value < lo OR value > hi THEN 1.0 ELSE 0.0 END) AS outside FROM r JOIN e ON r.id = e.id AND r.transform = e.transform WHERE period = 1 GROUP BY r.id, r.transform) "
        f"SELECT id, {columns} FROM f GROUP BY id"
    )


QUERIES = {"user_swing": user_swing}
ORACLES = {"user_swing": _oracle()}

"""Operations on wide feature matrices: ``id`` and a column for each feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.operators import gram


def names(wide: DataFrame, keys: tuple[str, ...] = ("id", "y", "fold")) -> list[str]:
    return [c for c in wide.columns if c not in keys]


def stacked(wide: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """``id, feature, value`` of a wide matrix, in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in columns])
    return wide.select("id", F.explode(pairs).alias("x")).select("id", "x.feature", "x.value")


def finite(wide: DataFrame) -> DataFrame:
    """Infinite values become 0 and NaN becomes null, in all feature columns."""
    clean = lambda c: F.when(F.isnan(c), None).when(F.abs(c) == float("inf"), 0.0).otherwise(F.col(c))
    return wide.select(*[c for c in wide.columns if c not in names(wide)], *[clean(c).alias(c) for c in names(wide)])


def medians(wide: DataFrame, accuracy: int = 10_000) -> dict[str, float]:
    """The median of each feature, 0 for one without values; one row leaves the executors."""
    if not names(wide):
        return {}
    row = wide.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in names(wide)]).first()
    return {c: 0.0 if row[c] is None else float(row[c]) for c in names(wide)}


def constant(wide: DataFrame) -> list[str]:
    """Features with at most one value among all rows (nulls aside)."""
    if not names(wide):
        return []
    row = wide.agg(*[F.min(c).alias(f"a_{c}") for c in names(wide)], *[F.max(c).alias(f"b_{c}") for c in names(wide)]).first()
    return [c for c in names(wide) if row[f"a_{c}"] == row[f"b_{c}"]]


def aligned(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The keys and exactly ``columns``, in their order; missing ones are null."""
    have = set(wide.columns)
    return wide.select(*[c for c in wide.columns if c not in names(wide)], *[(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in columns])


def reindexed(wide: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each ``id`` of ``ids``, with nulls where the matrix has none."""
    return ids.select("id").distinct().join(wide, "id", "left")


def check(wide: DataFrame, expected: list[str]) -> DataFrame:
    """The matrix itself; fails if an expected column is missing."""
    missing = sorted(set(expected) - set(wide.columns))
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return wide


def save_features(wide: DataFrame, path: str) -> None:
    """Writes the matrix as Parquet; :func:`breakwater.sources.series.read_series` reads it back."""
    wide.write.mode("overwrite").parquet(path)


def correlated(wide: DataFrame, columns: list[str], limit: float) -> list[str]:
    """``columns`` without those whose correlation with an earlier one kept is above ``limit``.

    One scan of the rows, whatever the number of columns; only names of pairs above the limit leave the executors.
    """
    return unrelated(gram.correlations(wide, columns), columns, limit)


def unrelated(pairs: DataFrame, columns: list[str], limit: float) -> list[str]:
    """``columns`` without those that ``pairs(a, b, r)`` relates above ``limit`` to an earlier one kept."""
    above = pairs.where(F.abs("r") > limit).select("a", "b").collect()
    close: dict[str, set[str]] = {}
    for r in above:
        close.setdefault(r["b"], set()).add(r["a"])
    kept: list[str] = []
    for c in columns:
        if close.get(c, set()).isdisjoint(kept):
            kept.append(c)
    return kept


#: How two columns make one.
COMBINED = {
    "mul": lambda a, b: a * b, "sqmul": lambda a, b: a * a * b, "div": lambda a, b: F.try_divide(a, b + 1e-8), "add": lambda a, b: a + b, "sub": lambda a, b: a - b,
    "ratio": lambda a, b: F.try_divide(a, F.abs(a) + F.abs(b) + 1e-8), "harmonic": lambda a, b: F.try_divide(2 * a * b, a + b + 1e-8),
}


def combinations(columns: list[str], most: int = 5000, kinds: tuple[str, ...] = tuple(COMBINED)) -> list[tuple[str, str, str]]:
    """``kind, a, b`` of each combination of two columns, pair by pair, at most ``most``."""
    return [(k, a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] for k in kinds][:most]


def combined(wide: DataFrame, made: list[tuple[str, str, str]], name: str = "block") -> DataFrame:
    """``wide`` with one array column: the combinations ``made``, in their order.

    The plan has one expression for each kind, over index arrays, however many thousands of
    combinations there are. A value that is not defined is null.
    """
    columns = list(dict.fromkeys(c for _, a, b in made for c in (a, b)))
    at = {c: i for i, c in enumerate(columns)}
    rows = wide.withColumn("_x", F.array(*[F.col(c).cast("double") for c in columns]))
    parts, order = [], []
    with_values = lambda how: lambda i, j: how(F.get("_x", i), F.get("_x", j))
    for kind, how in COMBINED.items():
        own = [(i, at[a], at[b]) for i, (k, a, b) in enumerate(made) if k == kind]
        if own:
            order += [i for i, _, _ in own]
            parts.append(F.zip_with(F.lit([a for _, a, _ in own]), F.lit([b for _, _, b in own]), with_values(how)))
    if not parts:
        return wide.withColumn(name, F.array().cast("array<double>"))
    back = sorted(range(len(order)), key=order.__getitem__)
    rows = rows.withColumn("_parts", F.concat(*parts))
    return rows.withColumn(name, F.transform(F.lit(back), lambda i: F.get("_parts", i))).drop("_x", "_parts")


def interactions(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The matrix with product, difference and ratio of each pair of columns."""
    made = lambda a, b: [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}"), (F.col(a) - F.col(b)).alias(f"{a}_minus_{b}"), F.try_divide(F.col(a), F.abs(F.col(b)) + 1e-8).alias(f"{a}_over_{b}")]
    return wide.select("*", *reduce(list.__add__, [made(a, b) for a, b in pairs], []))

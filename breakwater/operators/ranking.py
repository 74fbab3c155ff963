"""Ranks, running counts, quantiles and row numbers of groups of any size.

A window over a whole group is one task, however many executors there are. Here rows are first
counted by distinct value; the distinct values are cut at approximate quantiles into ranges
that keep the order, running sums are taken inside each range, and the sums of the ranges
before it (a small table) are added. So a group is spread over ``CUTS`` tasks, and a value that
fills a third of all rows is one row.

The counts by value are written to the shared folder before they are used three times, so a
plan with several sweeps stays as large as its last step.

Keys name columns of a matrix (features, folds, classes), so their number doesn't grow with
the rows, and tables of one row for each key and range are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakwater.sources import tables

#: Ranges that a group's values are cut into.
CUTS = 64


def dealt(each: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``each`` with ``_range``, the number of the range that the value falls into, among about ``CUTS`` of its key."""
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = each.groupBy(*keys).agg(F.percentile_approx(value, shares, F.lit(20 * CUTS)).alias("_cuts"))
    return each.join(F.broadcast(cuts), keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def swept(df: DataFrame, keys: list[str], value: str, **weights: Column) -> DataFrame:
    """A row for each key and distinct value: for each weight its sum ``w``, and ``w_below`` and ``w_total``.

    ``w_below`` sums over smaller values of the key, ``w_total`` over all. Null values are left
    out; an empty table gives an empty result.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    each = dealt(tables.staged(counts, "sweep"), keys, value)
    before = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = each.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_in_{n}") for n in weights])
    ranges = each.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_all_{n}") for n in weights])
    earlier, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    ranges = ranges.select(*keys, "_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in weights], *[F.sum(f"_all_{n}").over(whole).alias(f"{n}_total") for n in weights])
    both = inside.join(F.broadcast(ranges), [*keys, "_range"])
    return both.select(*keys, value, *weights, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"{n}_below") for n in weights], *[f"{n}_total" for n in weights])


def _looked_up(df: DataFrame, places: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with the columns of ``places`` of its key and value; rows without a value are spread over tasks."""
    spread = df.withColumn("_spread", F.when(F.col(value).isNull(), F.xxhash64(*df.columns)).otherwise(F.lit(0)))
    return spread.join(places.withColumn("_spread", F.lit(0).cast("long")), [*keys, value, "_spread"], "left")


def ranked(df: DataFrame, keys: list[str], value: str, name: str = "r") -> DataFrame:
    """``df`` with the average-tie rank of each value over the number of values; 0.5 where it is null."""
    places = swept(df, keys, value, _n=F.lit(1))
    share = (F.col("_n_below") + (F.col("_n") + 1) / 2) / F.col("_n_total")
    return _looked_up(df, places.select(*keys, value, share.alias(name)), keys, value).select(*df.columns, F.coalesce(name, F.lit(0.5)).alias(name))


def area(df: DataFrame, keys: list[str], value: str, y: str = "y") -> DataFrame:
    """``auc, n`` for each key: Mann-Whitney with mid-ranks; 0.5 where only one class has values."""
    places = swept(df, keys, value, pos=F.col(y).cast("long"), neg=1 - F.col(y).cast("long"))
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.first("pos_total").cast("double") * F.first("neg_total")
    return places.groupBy(*keys).agg(F.coalesce(F.try_divide(won, pairs), F.lit(0.5)).alias("auc"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def from_sweep(places: DataFrame, keys: list[str], value: str, shares: dict[str, float], weight: str = "n") -> DataFrame:
    """Interpolated quantiles of each key, exact, from its sweep."""
    total = F.col(f"{weight}_total")
    out = []
    for name, share in shares.items():
        at = (total - 1) * share
        low, part = F.floor(at), at - F.floor(at)
        # The largest value that no more than so many values are below is the one at that place.
        first = F.max(F.when((F.col(f"{weight}_below") <= low) & (F.col(weight) > 0), F.col(value)))
        second = F.max(F.when((F.col(f"{weight}_below") <= F.least(low + 1, total - 1)) & (F.col(weight) > 0), F.col(value)))
        out.append((first + F.max(part) * (second - first)).alias(name))
    return places.where(total > 0).groupBy(*keys).agg(*out)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The keys and a column for each share: interpolated quantiles, exact, of the values that are not null."""
    return from_sweep(swept(df, keys, value, n=F.lit(1)), keys, value, shares)


def held_out(df: DataFrame, keys: list[str], value: str, fold: str, folds: int, name: str = "r") -> DataFrame:
    """``df`` with the share of the other folds' values that are not above the row's; 0.5 where there is none.

    One sweep counts all folds beside each other, so rows are not repeated for each fold.
    """
    places = swept(df, keys, value, **{f"w{k}": (F.col(fold) == k).cast("long") for k in range(folds)})

    def others(k: int, column: str) -> Column:
        return reduce(Column.__add__, [F.col(column.format(j)) for j in range(folds) if j != k])

    shares = [F.try_divide((others(k, "w{}_below") + others(k, "w{}")).cast("double"), others(k, "w{}_total")).alias(f"_s{k}") for k in range(folds)]
    own = F.coalesce(*[F.when(F.col(fold) == k, F.col(f"_s{k}")) for k in range(folds)], F.lit(0.5))
    return _looked_up(df, places.select(*keys, value, *shares), keys, value).select(*df.columns, own.alias(name))


def against(df: DataFrame, train: DataFrame, keys: list[str], value: str, name: str = "r") -> DataFrame:
    """``df`` with the share of ``train``'s values of the key that are not above the row's; 0.5 where there is none."""
    both = train.select(*keys, value, F.lit(1).alias("_t")).union(df.select(*keys, value, F.lit(0).alias("_t")))
    places = swept(both, keys, value, _n=F.col("_t"))
    share = F.try_divide((F.col("_n_below") + F.col("_n")).cast("double"), F.col("_n_total"))
    return _looked_up(df, places.select(*keys, value, share.alias(name)), keys, value).select(*df.columns, F.coalesce(name, F.lit(0.5)).alias(name))


def numbered(df: DataFrame, keys: list[str], digest: str, order: list[str], name: str = "at") -> DataFrame:
    """``df`` with the number of each row in its key, from 0, by a hexadecimal digest and then ``order``; and ``<name>_of``, how many there are."""
    spread = df.withColumn("_range", F.substring(digest, 1, 2))
    inside = Window.partitionBy(*keys, "_range").orderBy(digest, *order)
    ranges = spread.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_of"))
    both = spread.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(ranges), [*keys, "_range"])
    return both.select(*df.columns, (F.col("_off") + F.col("_at") - 1).alias(name), f"{name}_of")

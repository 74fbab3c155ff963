"""Mutual information of a column with a discrete label by nearest neighbours.

For each value the distance to its k-th nearest neighbour of the same class is taken, and all
values of the column that are nearer are counted. Values are swept in ranges, as in
``ranking``: a value is one row for each class however often it occurs, a range is one task,
and the few values at the ends of the ranges before and after it are handed to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakwater.operators import ranking
from breakwater.sources import tables

NEIGHBOURS = 3
#: Distances that differ by less than this share are equal, so that rounding decides nothing.
SLACK = 1e-9


def digamma(x: Column) -> Column:
    """Digamma of a positive number, to about 1e-10: six steps up, then the asymptotic series."""
    up = x + 6
    steps = sum((1 / (x + i) for i in range(6)), F.lit(0.0))
    square = 1 / (up * up)
    return F.ln(up) - 0.5 / up - square * (1 / 12 - square * (1 / 120 - square / 252)) - steps


def _ends(keys: list[str], k: int, value: str, dealt: DataFrame) -> DataFrame:
    """For each key and range the last ``k`` values before the range and the first ``k`` after it: ``_left, _right``."""
    item = F.struct(F.col(value).alias("v"), F.col("n"))
    nearest = lambda order: F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    edge = dealt.select(*keys, "_range", item.alias("x"), nearest(F.asc(value)).alias("up"), nearest(F.desc(value)).alias("down")).where(f"up <= {k} or down <= {k}")
    sides = edge.groupBy(*keys, "_range").agg(*[F.array_sort(F.collect_list(F.when(F.col(c) <= k, F.col("x")))).alias(c) for c in ("up", "down")])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    left, right = F.flatten(F.collect_list("down").over(earlier)), F.flatten(F.collect_list("up").over(later))
    return sides.select(*keys, "_range", F.slice(F.array_sort(left), F.greatest(F.size(left) - k + 1, F.lit(1)), k).alias("_left"), F.slice(F.array_sort(right), 1, k).alias("_right"))


def _distance(k: int) -> Column:
    """The distance of the k-th neighbour; null if an equal value is that."""
    # A value's own repetitions come first, at distance 0; then the values on both sides by distance.
    need = F.least(F.lit(k), F.col("size") - 1) - (F.col("n") - 1)
    side = lambda xs: F.transform(xs, lambda x: F.struct(F.abs(x["v"] - F.col("value")).alias("d"), x["n"].alias("n")))
    start = F.struct(need.cast("long").alias("need"), F.lit(None).cast("double").alias("r"))
    step = lambda acc, x: F.when(acc["need"] <= 0, acc).otherwise(F.struct((acc["need"] - x["n"]).alias("need"), x["d"].alias("r")))
    return F.aggregate(F.array_sort(F.concat(side(F.col("_left")), side(F.col("_right")))), start, step)["r"]


def knn_information(long: DataFrame, k: int = NEIGHBOURS, label: str = "y") -> DataFrame:
    """``feature, mi`` of ``long(feature, value, y)``: at least 0, in nats.

    Rows with a null or NaN value or a null label are left out, likewise classes of one row; a class of up to
    ``k`` rows takes its farthest row. Equal values are at distance 0: where the k-th
    neighbour is one, all equal values are counted. No noise is added to break ties. A feature
    without a class of two rows has 0; an empty table gives an empty result.
    """
    rows = long.select("feature", F.col(label).alias("y"), F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value) and y is not null")
    each = tables.staged(rows.groupBy("feature", "y", "value").agg(F.count("*").alias("n")), "values")
    sizes = each.groupBy("feature", "y").agg(F.sum("n").alias("size"))  # a row for each feature and class
    used = each.join(F.broadcast(sizes.where("size > 1")), ["feature", "y"])
    dealt = tables.staged(ranking.dealt(used, ["feature"], "value"), "ranges")
    keys = ["feature", "y"]
    inside = Window.partitionBy(*keys, "_range").orderBy("value")
    item = F.struct(F.col("value").alias("v"), F.col("n"))
    own = dealt.select("*", F.collect_list(item).over(inside.rowsBetween(-k, -1)).alias("_l"), F.collect_list(item).over(inside.rowsBetween(1, k)).alias("_r"))
    near = own.join(F.broadcast(_ends(keys, k, "value", dealt)), [*keys, "_range"])
    left, right = F.concat("_left", "_l"), F.concat("_r", "_right")
    near = near.select("feature", "y", "value", "n", "size", F.slice(left, F.greatest(F.size(left) - k + 1, F.lit(1)), k).alias("_left"), F.slice(right, 1, k).alias("_right"))
    inner = F.when(F.col("r") > 0, F.col("r") * (1 - SLACK))
    reach = near.withColumn("r", _distance(k)).select("feature", "y", "value", "n", "size", "r", (F.col("value") - inner).alias("lo"), (F.col("value") + inner).alias("hi"))
    reach = tables.staged(reach, "reach")
    # Both ends are looked up in one sweep over values and ends.
    points = reach.select("feature", "value", "n")
    for end in ("lo", "hi"):
        points = points.union(reach.where("r > 0").select("feature", F.col(end), F.lit(0).cast("long")))
    places = tables.staged(ranking.swept(points, ["feature"], "value", _n=F.col("n")).select("feature", "value", "_n", "_n_below"), "places")
    at = lambda end, count: places.select("feature", F.col("value").alias(end), count.alias(f"n_{end}"))
    found = reach.join(at("value", F.col("_n")), ["feature", "value"]).join(at("lo", F.col("_n_below") + F.col("_n")), ["feature", "lo"], "left").join(at("hi", F.col("_n_below")), ["feature", "hi"], "left")
    m = F.when(F.col("r") > 0, F.col("n_hi") - F.col("n_lo")).otherwise(F.col("n_value")).cast("double")
    term = digamma(F.least(F.lit(k), F.col("size") - 1).cast("double")) - digamma(F.col("size").cast("double")) - digamma(m)
    mean = found.groupBy("feature").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * term) / F.sum("n")).alias("s"))
    mi = F.greatest(digamma(F.col("total").cast("double")) + F.col("s"), F.lit(0.0))
    return sizes.select("feature").distinct().join(mean.select("feature", mi.alias("mi")), "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))


#: Digamma in SQL, as above.
PSI = "(LN({0} + 6) - DBL(0.5) / ({0} + 6) - (DBL(1) / 12 - (DBL(1) / 120 - DBL(1) / 252 / power({0} + 6, 2)) / power({0} + 6, 2)) / power({0} + 6, 2) - 1 / {0} - 1 / ({0} + 1) - 1 / ({0} + 2) - 1 / ({0} + 3) - 1 / ({0} + 4) - 1 / ({0} + 5))"
#: Steps over ``iy(id, feature, y, value)`` that end in ``nm(feature, mi)``; their SQL compares all pairs of rows, as the definition has it.
STEPS = (
    ("kp", "SELECT a.id, a.feature, a.y, a.value, abs(b.value - a.value) AS d, row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(b.value - a.value)) AS place FROM {iy} a JOIN {iy} b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id"),
    ("kr", f"SELECT id, feature, y, value, max(CASE WHEN place <= {NEIGHBOURS} THEN d END) AS r, DBL(least(count(*), {NEIGHBOURS})) AS k, DBL(count(*) + 1) AS size FROM {{kp}} GROUP BY id, feature, y, value"),
    ("km", f"SELECT a.id, a.feature, a.k, a.size, DBL(count(*)) AS m FROM {{kr}} a JOIN {{kr}} b ON a.feature = b.feature AND (CASE WHEN a.r > 0 THEN abs(b.value - a.value) < a.r * (1 - {SLACK!r}) ELSE b.value = a.value END) GROUP BY a.id, a.feature, a.k, a.size"),
    ("nm", f"SELECT feature, greatest({PSI.format('DBL(count(*))')} + avg({PSI.format('k')} - {PSI.format('size')} - {PSI.format('m')}), 0) AS mi FROM {{km}} GROUP BY feature", lambda have: knn_information(have["iy"])),
)

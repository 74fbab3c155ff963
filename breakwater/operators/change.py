"""Where three searches put a change in a joined series, under the squared-error cost.

All of them need only running sums of the series and its squares. The penalised search keeps,
in one fold over a grid, the starts of a last segment that can still be best; the oracle tries
all starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.operators.filters import _let
from breakwater.plans.family import columns, family, spread

PENALTY, LEAST, JUMP = 3.0, 2, 5

_JOINED = ("jo", "SELECT id, seq, period, count(*) OVER (PARTITION BY id) AS n, value - avg(value) OVER (PARTITION BY id) AS value FROM {seg}")
#: Running sums up to and with a point.
_SUMS = ("su", "SELECT id, seq, period, n, sum(value) OVER (PARTITION BY id ORDER BY seq) AS s, sum(value * value) OVER (PARTITION BY id ORDER BY seq) AS q FROM {jo}")
_ENDS = ("en", "SELECT id, DBL(max(n)) AS n, DBL(sum(CASE WHEN period = 0 THEN 1 ELSE 0 END)) AS n0, MAXBY(s, seq) AS sn, MAXBY(q, seq) AS qn, greatest(5, least(50, floor(max(n) / 3))) AS width FROM {su} GROUP BY id")
_SPLIT = ("sp", f"SELECT u.id, MINBY(seq, round(q - s * s / seq + (qn - q) - (sn - s) * (sn - s) / (e.n - seq), 9) + seq * 1e-12) / DBL(max(e.n)) AS split FROM {{su}} u JOIN {{en}} e ON u.id = e.id WHERE seq % {JUMP} = 0 AND seq < e.n AND e.n - seq >= {LEAST} GROUP BY u.id")
_SLIDE = (
    ("sl", f"SELECT u.id, u.seq, u.s, u.q, floor(width / 2) AS h, e.n FROM {{su}} u JOIN {{en}} e ON u.id = e.id WHERE seq % {JUMP} = 0 AND seq < e.n AND seq >= floor(width / 2) AND seq + floor(width / 2) <= e.n"),
    ("sm", "SELECT m.id, m.seq, m.n, h, m.s - coalesce(a.s, 0) AS sa, b.s - m.s AS sb FROM {sl} m LEFT JOIN {su} a ON m.id = a.id AND a.seq = m.seq - h JOIN {su} b ON m.id = b.id AND b.seq = m.seq + h"),
    # Squares cancel: what a cut gains is the squared sums of both halves over their size, less those of the whole.
    ("sd", "SELECT id, MAXBY(seq, round(sa * sa / h + sb * sb / h - (sa + sb) * (sa + sb) / (2 * h), 9) - seq * 1e-12) / DBL(max(n)) AS slide FROM {sm} GROUP BY id"),
)
_ARRAYS = spread(("ar", "SELECT id, BIG(max(n)) AS n, SERIES(s, seq, n >= 1) AS s, SERIES(q, seq, n >= 1) AS q FROM {su} GROUP BY id"), "su")


def _searched(series: DataFrame) -> DataFrame:
    """``id, ends, first``: how many segments the cheapest partition has, and where the first ends."""
    n = F.col("n")
    at = lambda c, i: F.when(i == 0, F.lit(0.0)).otherwise(F.get(c, (i - 1).cast("int")))
    cost = lambda a, t: at("q", t) - at("q", a) - F.pow(at("s", t) - at("s", a), F.lit(2)) / (t - a)
    grid = F.concat(F.filter(F.sequence(F.lit(JUMP).cast("long"), F.greatest(n, F.lit(JUMP)), F.lit(JUMP).cast("long")), lambda t: t < n), F.array(n))
    state = "struct<alive:array<struct<a:bigint,f:double>>,out:array<struct<t:bigint,a:bigint>>>"
    start = F.struct(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("f"))).alias("alive"), F.array().cast("array<struct<t:bigint,a:bigint>>").alias("out")).cast(state)

    def step(acc: Column, t: Column) -> Column:
        tried = F.transform(F.filter(acc["alive"], lambda c: t - c["a"] >= LEAST), lambda c: F.struct((c["f"] + cost(c["a"], t)).alias("v"), c["a"].alias("a")))

        def chosen(values: Column) -> Column:
            def ended(best: Column) -> Column:
                total = best["v"] + PENALTY
                # Starts that cost more than ending here can't become best, as long as a segment may start here.
                young = F.filter(acc["alive"], lambda c: t - c["a"] < LEAST)
                left = F.transform(F.filter(values, lambda x: (x["v"] <= total) | (n - t < LEAST)), lambda x: F.struct(x["a"].alias("a"), (x["v"] - cost(x["a"], t)).alias("f")))
                return F.struct(F.concat(left, young, F.array(F.struct(t.alias("a"), total.alias("f")))).alias("alive"), F.concat(acc["out"], F.array(F.struct(t.alias("t"), best["a"].alias("a")))).alias("out")).cast(state)

            return _let(F.array_min(values), ended)

        return _let(tried, chosen)

    found = series.withColumn("out", F.aggregate(grid, start, step)["out"])
    back = F.aggregate(F.reverse("out"), F.struct(n.alias("at"), F.lit(0).cast("long").alias("ends"), n.alias("first")), lambda acc, o: F.when(o["t"] == acc["at"], F.struct(o["a"].alias("at"), (acc["ends"] + 1).alias("ends"), o["t"].alias("first"))).otherwise(acc))
    return found.withColumn("b", back).select("id", F.when(n >= 4, F.col("b.ends")).otherwise(1).alias("ends"), F.when(n >= 4, F.col("b.first")).otherwise(n).alias("first"))


_LISTS = ("li", f"SELECT id, n, list_prepend(0, s) AS s, list_prepend(0, q) AS q, list_append(list_filter(range({JUMP}, n, {JUMP}), lambda t : t < n), n) AS t FROM {{ar}} WHERE n >= 4", lambda have: None)
_BEST = (
    "be",
    "SELECT id, s, q, t, 1 AS i, [CAST(0 AS DOUBLE)] AS best, [CAST(0 AS BIGINT)] AS prev FROM {li} UNION ALL SELECT id, s, q, t, i + 1, list_append(best, m.v), list_append(prev, m.j) FROM (SELECT *, list_min(list_transform(list_filter(range(0, i), lambda j : t[i] - (CASE WHEN j = 0 THEN 0 ELSE t[j] END) >= 2), "
    "lambda j : {'v': best[j + 1] + PEN + q[t[i] + 1] - q[(CASE WHEN j = 0 THEN 0 ELSE t[j] END) + 1] - power(s[t[i] + 1] - s[(CASE WHEN j = 0 THEN 0 ELSE t[j] END) + 1], 2) / (t[i] - (CASE WHEN j = 0 THEN 0 ELSE t[j] END)), 'j': j})) AS m FROM {be} WHERE i <= len(t)) z".replace("PEN", str(PENALTY)),
    lambda have: None,
)
_BACK = ("bk", "SELECT id, t, prev, CAST(len(t) AS BIGINT) AS i FROM {be} WHERE i = len(t) + 1 UNION ALL SELECT id, t, prev, prev[i + 1] AS i FROM {bk} WHERE prev[i + 1] > 0", lambda have: None)
_FOUND = ("pe", "SELECT a.id, coalesce(count(k.id), 0) + CASE WHEN count(k.id) = 0 THEN 1 ELSE 0 END AS ends, coalesce(min(k.t[k.i]), max(a.n)) AS first FROM {ar} a LEFT JOIN {bk} k ON a.id = k.id GROUP BY a.id", lambda have: _searched(have["ar"]))
_ALL = ("al", "SELECT e.id, DBL(p.ends - 1) AS cps, CASE WHEN p.ends > 1 THEN p.first / n ELSE DBL(0.5) END AS first, CASE WHEN p.ends > 2 THEN (n - p.first) / (p.ends - 1) / n ELSE DBL(1) END AS apart, coalesce(split, 0.5) AS split, coalesce(slide, 0.5) AS slide, n0 / n AS truth FROM {en} e JOIN {pe} p ON e.id = p.id LEFT JOIN {sp} s ON e.id = s.id LEFT JOIN {sd} d ON e.id = d.id")
_COLUMNS = {
    "pelt_l2_n_changepoints": "cps", "pelt_l2_first_cp_pos": "first", "pelt_l2_avg_distance": "apart", "binseg_l2_cp_pos": "split", "binseg_l2_cp_from_mid": "abs(split - 0.5)", "window_l2_cp_pos": "slide", "cp_actual_pos": "truth",
    "pelt_l2_first_cp_pos_error": "abs(first - truth)", "binseg_l2_cp_pos_error": "abs(split - truth)", "window_l2_cp_pos_error": "abs(slide - truth)",
}

FAMILIES = [family("pelt", _JOINED, _SUMS, _ENDS, _SPLIT, *_SLIDE, _ARRAYS, _LISTS, _BEST, _BACK, _FOUND, _ALL, "SELECT " + columns(_COLUMNS, "id") + " FROM {al}")]

"""Operators on the feature matrix: ranks, imputation, scores, selection and their evaluation.

A feature matrix is long, ``id, feature, value``. Ranks, counts and quantiles of a feature come
from ``ranking``, which spreads a feature over many tasks; the SQL text beside each says what
they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.operators import gram, neighbours, ranking
from breakwater.operators.frames import stacked
from breakwater.plans.family import columns, family, kept


def _holed(wide: DataFrame) -> DataFrame:
    holes = F.array(*[F.lit(n) for n in NAMES])
    hole = F.col("feature").eqNullSafe(F.get(holes, (F.col("id") % 17).cast("int")))
    return stacked(wide, NAMES).withColumn("value", F.when(~hole, F.col("value")))


def _components(vectors: DataFrame) -> DataFrame:
    """``i, j, r`` of each pair of places of ``embedding``; shorter vectors lack the last ones."""
    dims = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    padded = F.transform(F.sequence(F.lit(0), F.lit(max(dims, 1) - 1)), lambda i: F.get("embedding", i).cast("double"))
    found = gram.correlations(vectors.where("embedding is not null"), [str(i) for i in range(dims)], padded)
    return found.select(F.col("a").cast("bigint").alias("i"), F.col("b").cast("bigint").alias("j"), "r")


def _busy(wide: DataFrame) -> DataFrame:
    return wide.crossJoin(F.broadcast(wide.agg(F.avg("n").alias("mean_n")))).select("id", F.when(F.col("n") > F.col("mean_n"), 1).otherwise(0).alias("y"))


def _binned(rows: DataFrame, bins: int = 8) -> DataFrame:
    """``feature, y, bin, k``: counts in bins of equal ranks; equal values share a bin."""
    places = ranking.swept(rows, ["feature"], "value", pos=F.col("y").cast("long"), neg=1 - F.col("y").cast("long"))
    low, total = F.col("pos_below") + F.col("neg_below"), F.col("pos_total") + F.col("neg_total")
    both = F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("k")), F.struct(F.lit(0).alias("y"), F.col("neg").alias("k")))
    cells = places.select("feature", F.floor(bins * low / total).alias("bin"), F.explode(both).alias("c")).where("c.k > 0")
    return cells.groupBy("feature", F.col("c.y").alias("y"), "bin").agg(F.sum("c.k").cast("double").alias("k"))


def _correlated(rows: DataFrame) -> DataFrame:
    """``fa, fb, r`` of each pair of features, by name."""
    wide = rows.groupBy("id").pivot("feature", sorted(NAMES)).agg(F.first("value"))
    return gram.correlations(wide, sorted(NAMES)).select(F.col("a").alias("fa"), F.col("b").alias("fb"), "r")


def _summary(rows: DataFrame) -> DataFrame:
    places = ranking.swept(rows, ["y"], "score", n=F.lit(1))
    ends = places.groupBy("y").agg(F.sum("n").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    return ends.join(ranking.from_sweep(places, ["y"], "score", {"q25": 0.25, "med": 0.5, "q75": 0.75}), "y")


def _dealt(labels: DataFrame) -> DataFrame:
    """Rows of each class in the order of a digest of the id: ``id, y, at, at_of``."""
    digest = F.md5((F.col("id") * 1000 + 42).cast("string"))
    return ranking.numbered(labels.withColumn("_d", digest), ["y"], "_d", ["id"]).drop("_d")

#: Eight features of each user series, long, with missing values; the label is a busy user.
_WIDE = kept(("wide", "SELECT id, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, POST(avg(value)) - PRE(avg(value)) AS shift, DIV(POST(var_samp(value)), PRE(var_samp(value))) AS vr, POST(max(value)) - PRE(max(value)) AS top, DBL(count(*)) AS n FROM {seg} GROUP BY id"))
FOLDS, QUARTILES = 5, {"q1": 0.25, "q2": 0.5, "q3": 0.75}
NAMES = ("mean", "sd", "lo", "hi", "shift", "vr", "top")
_LONG = ("f", " UNION ALL ".join(f"SELECT id, '{c}' AS feature, CASE WHEN id % 17 = {k} THEN NULL ELSE {c} END AS value FROM {{wide}}" for k, c in enumerate(NAMES)), lambda have: _holed(have["wide"]))
_LABEL = ("lab", "SELECT id, CASE WHEN n > PCTN THEN 1 ELSE 0 END AS y FROM {wide}".replace("PCTN", "avgn").replace("FROM {wide}", "FROM (SELECT id, n, avg(n) OVER () AS avgn FROM {wide}) z"), lambda have: _busy(have["wide"]))
_FOLDS = kept(("fold", "SELECT id, y, BIG((row_number() OVER (PARTITION BY y ORDER BY MD5(id * 1000 + 42), id) - 1) % 5) AS fold FROM {lab}", lambda have: _dealt(have["lab"]).select("id", "y", (F.col("at") % FOLDS).alias("fold"))))
_BASE = (_WIDE, _LONG, _LABEL)
IN = {"seg": "seg_users"}
#: Average-tie rank over the number of values; missing is 0.5.
_RANK = ("rk", "SELECT id, feature, value, CASE WHEN value IS NULL THEN DBL(0.5) ELSE (rank() OVER (PARTITION BY feature ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY feature, value) - 1) / DBL(2)) / count(value) OVER (PARTITION BY feature) END AS r FROM {f}", lambda have: ranking.ranked(have["f"].select("id", "feature", "value"), ["feature"], "value"))
#: Mann-Whitney with mid-ranks; one class only, or no value: 0.5.
_AUC = "coalesce(DIV(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / DBL(2), sum(y) * DBL(sum(1 - y))), 0.5)"


def _auc(source: str, value: str, keys: str) -> tuple:
    """Step ``a``: AUC of a value by keys."""
    return ("a", f"SELECT {keys}, {_AUC} AS auc, BIG(count(*)) AS n FROM (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / DBL(2) AS r FROM {{{source}}} WHERE {value} IS NOT NULL) z GROUP BY {keys}", lambda have: ranking.area(have[source], keys.split(", "), value))


_WITH_Y = ("fy", "SELECT f.id, feature, value, y, fold FROM {f} f JOIN {fold} l ON f.id = l.id")
#: Each value against the training rows of each fold: the share of training values not above it.
_NORMALIZED = (
    ("ks", "SELECT DISTINCT fold AS k FROM {fold}"),
    ("tv", "SELECT k, id, feature, value, y, fold, CASE WHEN fold <> k AND value IS NOT NULL THEN 1 ELSE 0 END AS train FROM {fy} CROSS JOIN {ks}"),
    (
        "nr",
        "SELECT k, id, feature, value, y, fold, train, CASE WHEN value IS NULL OR total = 0 THEN DBL(0.5) ELSE below / DBL(total) END AS r FROM (SELECT *, sum(train) OVER (PARTITION BY k, feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below, sum(train) OVER (PARTITION BY k, feature) AS total FROM {tv}) z WHERE fold = k",
        lambda have: ranking.held_out(have["fy"], ["feature"], "value", "fold", FOLDS).withColumn("k", F.col("fold")),
    ),
)
_QUART = ("qs", "SELECT feature, PCT(value, 0.25) AS q1, PCT(value, 0.5) AS q2, PCT(value, 0.75) AS q3 FROM {f} WHERE value IS NOT NULL GROUP BY feature", lambda have: ranking.quantiles(have["f"], ["feature"], "value", QUARTILES))
_IMPUTED = kept(("im", "SELECT f.id, f.feature, coalesce(f.value, q2, 0) AS value FROM {f} f LEFT JOIN {qs} q ON f.feature = q.feature"))
_PAIRED = ("pr", "SELECT a.id, a.feature AS fa, b.feature AS fb, a.value AS u, b.value AS v FROM {im} a JOIN {im} b ON a.id = b.id AND a.feature < b.feature")
_CORR = kept(("cm", "SELECT fa, fb, corr(u, v) AS r FROM {pr} GROUP BY fa, fb", lambda have: _correlated(have["im"])))
_Y_IM = ("iy", "SELECT i.id, i.feature, i.value, y, fold FROM {im} i JOIN {fold} l ON i.id = l.id")
_BINNED = ("bn", "SELECT feature, y, bin, DBL(count(*)) AS k FROM (SELECT feature, y, floor(8 * (rank() OVER (PARTITION BY feature ORDER BY value) - 1) / DBL(count(*) OVER (PARTITION BY feature))) AS bin FROM {iy}) z GROUP BY feature, y, bin", lambda have: _binned(have["iy"]))
_MI = kept(("mi", "SELECT feature, sum(k / n * LN(k * n / (kb * ky))) AS mi FROM (SELECT feature, k, sum(k) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature, bin) AS kb, sum(k) OVER (PARTITION BY feature, y) AS ky FROM {bn}) z GROUP BY feature"))
_SCORE = ("sc", "SELECT r.id, round(avg(r), 9) AS score FROM {rk} r GROUP BY r.id")
_SCORED = ("sy", "SELECT s.id, score, y, fold, 1 AS one FROM {sc} s JOIN {fold} l ON s.id = l.id")
_ALL = (*_BASE, _FOLDS, _QUART, _IMPUTED, _Y_IM)

# Baseline of the supplier series: robust contrasts, ranked and averaged.
CONTRASTS = ("mean_delta", "median_delta", "std_logratio", "mad_logratio", "iqr_logratio")


def _at(x, share: float):
    """Interpolated quantile of a sorted array; null if it is empty."""
    place = (F.size(x) - 1) * share
    low, high = F.get(x, F.floor(place).cast("int")), F.get(x, F.ceil(place).cast("int"))
    return low + (place - F.floor(place)) * (high - low)


def _distances(x: str, centre: str):
    return F.sort_array(F.transform(x, lambda v: F.abs(v - F.col(centre))))


def _contrasts(seg: DataFrame) -> DataFrame:
    """The five contrasts of each series, from one sorted array of each segment: one exchange, by id."""
    value = lambda k: F.when(F.col("period") == k, F.col("value"))
    one = seg.groupBy("id").agg(*[f(value(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("x", lambda v: F.sort_array(F.collect_list(v))))])
    one = one.select("*", *[_at(F.col(f"x{k}"), 0.5).alias(f"med{k}") for k in (0, 1)])
    one = one.select("*", *[(_at(F.col(f"x{k}"), 0.75) - _at(F.col(f"x{k}"), 0.25)).alias(f"iqr{k}") for k in (0, 1)], *[_distances(f"x{k}", f"med{k}").alias(f"d{k}") for k in (0, 1)])
    one = one.select("*", *[_at(F.col(f"d{k}"), 0.5).alias(f"mad{k}") for k in (0, 1)])
    ratio = lambda n: F.abs(F.ln((F.col(f"{n}1") + 1e-8) / (F.col(f"{n}0") + 1e-8)))
    return one.select("id", F.abs(F.col("mean1") - F.col("mean0")).alias("mean_delta"), F.abs(F.col("med1") - F.col("med0")).alias("median_delta"), ratio("sd").alias("std_logratio"), ratio("mad").alias("mad_logratio"), ratio("iqr").alias("iqr_logratio"))


_SUP = (
    ("b0", "SELECT id, period, avg(value) AS mean, stddev_pop(value) AS sd, PCT(value, 0.5) AS med, PCT(value, 0.25) AS q25, PCT(value, 0.75) AS q75 FROM {seg} GROUP BY id, period"),
    ("b1", "SELECT s.id, s.period, PCT(abs(value - med), 0.5) AS mad FROM {seg} s JOIN {b0} b ON s.id = b.id AND s.period = b.period GROUP BY s.id, s.period"),
    ("b2", "SELECT b.id, abs(V1(mean) - V0(mean)) AS mean_delta, abs(V1(med) - V0(med)) AS median_delta, abs(LN((V1(sd) + 1e-8) / (V0(sd) + 1e-8))) AS std_logratio, abs(LN((V1(mad) + 1e-8) / (V0(mad) + 1e-8))) AS mad_logratio, abs(LN((V1(q75 - q25) + 1e-8) / (V0(q75 - q25) + 1e-8))) AS iqr_logratio FROM (SELECT x.*, mad FROM {b0} x JOIN {b1} m ON x.id = m.id AND x.period = m.period) b GROUP BY b.id", lambda have: _contrasts(have["seg"])),
    ("f", " UNION ALL ".join(f"SELECT id, '{c}' AS feature, {c} AS value FROM {{b2}}" for c in CONTRASTS), lambda have: stacked(have["b2"], CONTRASTS)),
)

#: Correlations of all components of the embeddings, in one scan.
_COMPONENTS = ("gc", "SELECT i, j, corr(embedding[i + 1], embedding[j + 1]) AS r FROM {embeddings} CROSS JOIN (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM {embeddings}))) AS i) x CROSS JOIN (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM {embeddings}))) AS j) y WHERE i < j GROUP BY i, j", lambda have: _components(have["embeddings"]))

FAMILIES = [
    family("baseline_score", *_SUP, _RANK, "SELECT id, R(avg(r)) AS score FROM {rk} GROUP BY id", seg="seg_suppliers"),
    family("rank_pct", *_BASE, _RANK, "SELECT id, feature, R(r) AS r FROM {rk}", **IN),
    family("aggregate_features", *_BASE, _RANK, "SELECT id, R(avg(r)) AS score FROM {rk} GROUP BY id", **IN),
    family("stratified_folds", *_BASE, _FOLDS, "SELECT id, y, fold FROM {fold}", **IN),
    family("stratified_split", *_BASE, ("sp", "SELECT id, y, CASE WHEN (row_number() OVER (PARTITION BY y ORDER BY MD5(id * 1000 + 42), id) - 1) < floor(count(*) OVER (PARTITION BY y) * 0.2) THEN 1 ELSE 0 END AS test FROM {lab}", lambda have: _dealt(have["lab"]).select("id", "y", F.when(F.col("at") < F.floor(F.col("at_of") * 0.2), 1).otherwise(0).alias("test"))), "SELECT id, y, test FROM {sp}", **IN),
    family("median_impute", *_BASE, _QUART, _IMPUTED, "SELECT id, feature, R(value) AS value FROM {im}", **IN),
    family("rank_normalizer", *_BASE, _FOLDS, _WITH_Y, *_NORMALIZED, "SELECT k, id, feature, R(r) AS r FROM {nr} WHERE fold = k", **IN),
    family("feature_auc", *_BASE, _FOLDS, _WITH_Y, _auc("fy", "value", "feature"), "SELECT feature, R(auc) AS auc, R(greatest(auc, 1 - auc)) AS oriented_auc, n FROM {a}", **IN),
    family("feature_diagnostics", *_BASE, _FOLDS, _WITH_Y, "SELECT feature, R(avg(CASE WHEN value IS NULL THEN DBL(1) ELSE DBL(0) END)) AS missing, R(abs(corr(value, DBL(y)))) AS abs_corr FROM {fy} GROUP BY feature", **IN),
    family("score_auc", *_BASE, _RANK, _FOLDS, _SCORE, _SCORED, _auc("sy", "score", "one"), "SELECT one, R(auc) AS auc, n FROM {a}", **IN),
    family("evaluation_summary", *_BASE, _RANK, _FOLDS, _SCORE, _SCORED, ("su", "SELECT y, count(*) AS n, min(score) AS lo, PCT(score, 0.25) AS q25, PCT(score, 0.5) AS med, PCT(score, 0.75) AS q75, max(score) AS hi FROM {sy} GROUP BY y", lambda have: _summary(have["sy"])), "SELECT y, BIG(n) AS n, R(lo) AS lo, R(q25) AS q25, R(med) AS med, R(q75) AS q75, R(hi) AS hi FROM {su}", **IN),
    family("cv_auc_rank_mean", *_BASE, _FOLDS, _WITH_Y, *_NORMALIZED, ("ms", "SELECT k, id, max(y) AS y, round(avg(r), 9) AS score FROM {nr} WHERE fold = k GROUP BY k, id"), _auc("ms", "score", "k"), "SELECT k, R(auc) AS auc, n FROM {a}", **IN),
    family("oriented_topk", *_BASE, _FOLDS, _WITH_Y, _auc("fy", "value", "feature"), "SELECT feature, R(greatest(auc, 1 - auc)) AS oriented_auc, CASE WHEN auc < 0.5 THEN -1 ELSE 1 END AS direction FROM {a} ORDER BY greatest(auc, 1 - auc) DESC, feature LIMIT 4", **IN),
    family("auc_selection_sweep", *_BASE, _FOLDS, _WITH_Y, _auc("fy", "value", "feature"), "SELECT DBL(t) AS threshold, BIG(sum(CASE WHEN greatest(auc, 1 - auc) >= t THEN 1 ELSE 0 END)) AS n_features FROM {a} CROSS JOIN (VALUES (0.50), (0.52), (0.54), (0.56), (0.58), (0.60)) AS v(t) GROUP BY t", **IN),
    family("interactions", *_ALL, _PAIRED, "SELECT id, fa, fb, " + ", ".join(f"R({e}) AS {n}" for n, e in (("mul", "u * v / 1000"), ("sqmul", "u * u * v / 1000000"), ("divide", "DIV(u, v + 1e-8)"), ("added", "u + v"), ("sub", "u - v"), ("ratio", "DIV(u, abs(u) + abs(v) + 1e-8)"), ("harmonic", "DIV(2 * u * v, u + v + 1e-8)"))) + " FROM {pr} WHERE abs(v) > 0.001 AND abs(u + v) > 0.001", **IN),
    family("differentiation", *_ALL, "SELECT id, feature, R(power(value, 3) / 1000000) AS cube, R(LN(abs(value) + 1)) AS log1, R(1 / (abs(value) + 1)) AS reciprocal, R(sin(value)) AS sine, R(cos(value)) AS cosine, R(sqrt(abs(value))) AS root FROM {im}", **IN),
    family("corr_matrix", *_ALL, _PAIRED, _CORR, "SELECT fa, fb, R(r) AS r FROM {cm}", **IN),
    family("gram_correlation", _COMPONENTS, "SELECT i, j, R(r) AS r FROM {gc}", embeddings="embeddings"),
    family("corr_filter", *_ALL, _PAIRED, _CORR, _BINNED, _MI, ("hi", "SELECT fa, fb FROM {cm} WHERE abs(r) > 0.5"), "SELECT m.feature, R(m.mi) AS mi FROM {mi} m WHERE m.feature NOT IN (SELECT CASE WHEN a.mi >= b.mi THEN h.fb ELSE h.fa END FROM {hi} h JOIN {mi} a ON h.fa = a.feature JOIN {mi} b ON h.fb = b.feature)", **IN),
    family("knn_mi", *_ALL, *neighbours.STEPS, "SELECT feature, R(mi) AS mi FROM {nm}", **IN),
    family("binned_mi", *_ALL, _BINNED, _MI, "SELECT feature, R(mi) AS mi FROM {mi}", **IN),
    family("stability_rank", *_ALL, ("ks", "SELECT DISTINCT fold AS k FROM {fold}"), ("tr", "SELECT k, feature, value, y FROM {iy} CROSS JOIN {ks} WHERE fold <> k"), _auc("tr", "value", "k, feature"), "SELECT feature, R(avg(abs(auc - 0.5)) / (1 + DIV(stddev_pop(abs(auc - 0.5)), avg(abs(auc - 0.5)) + 1e-12))) AS stability FROM {a} GROUP BY feature", **IN),
    family("weight_grid", *_BASE, _RANK, _FOLDS, ("ab", "SELECT r.id, y, max(CASE WHEN feature = 'mean' THEN r END) AS a, max(CASE WHEN feature = 'hi' THEN r END) AS b, max(CASE WHEN feature = 'sd' THEN r END) AS c FROM {rk} r JOIN {fold} l ON r.id = l.id GROUP BY r.id, y"), ("gs", "SELECT id, y, i * 10 + j AS w, (i * a + j * b + (10 - i - j) * c) / 10 AS score FROM {ab} CROSS JOIN (VALUES (0), (2), (4), (6), (8), (10)) AS p(i) CROSS JOIN (VALUES (0), (2), (4), (6), (8), (10)) AS q(j) WHERE i + j <= 10"), ("gr", "SELECT id, y, w, round(score, 9) AS score FROM {gs}"), _auc("gr", "score", "w"), "SELECT w, R(auc) AS auc FROM {a}", **IN),
]

"""The engine's programming interface: features of a series table, baseline scores, training and inference."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakwater.operators import change, contrasts, distances, dynamics, filters, frames, learning, likelihood, probabilities, ranking, spectra, tails
from breakwater.plans.family import outputs
from breakwater.sources import series, tables

#: Families with a row for each series, or each series and scope, by name.
SCOPED = {f.name: f for m in (contrasts, distances, tails, dynamics, filters, spectra, change, probabilities) for f in [*m.FAMILIES, *getattr(m, "PLAIN", [])] if list(f.inputs) in (["x"], ["seg"])}
#: Families that compare a window with whole segments.
WINDOWS_ONLY = ("localization", "tail_localization")
DEFAULT = ("quantile_features", "quantile_deltas", "scale_shift", "acf1_shift", "wasserstein", "energy_v", "cv_features", "cusum_features", "ar1_yw")


#: Accounts of suppliers below this sum make a label.
BELOW = 3000
#: The column of a learned aggregation's score.
META = "meta_agg_score"
#: Families of the break likelihood's statistics.
BREAK_FAMILIES = ("ar1_yw", "energy_v", "wasserstein", "acf1_shift", "scale_shift", "spectral", "wavelet")


def named(statistic: str, scope: str) -> str:
    return statistic if scope == "full" else f"{statistic}_{scope}"


def features(table: DataFrame, families: tuple[str, ...] = DEFAULT, scopes: dict[str, int] | None = None) -> DataFrame:
    """Wide features of a table ``id, seq, period, value``: ``id`` and a column for each statistic and scope.

    Names end in the window (``energy_w50``), those of whole segments have no end.

    Each family is one plan over the same scoped segments; the results are co-partitioned by
    id, so the joins that put them side by side shuffle only their own small rows. A name
    that two families share is kept from the first.
    """
    scopes = scopes or series.SCOPES
    return features_of(series.scoped(tables.staged(series.with_positions(table), "segments"), scopes), families)


def features_of(x: DataFrame, families: tuple[str, ...] = DEFAULT) -> DataFrame:
    """The features of scoped segments; what several families, or calls, take from ``x`` is made once."""
    spark, (segs, scopes) = x.sparkSession, series.unscoped(x)
    parts, seen = [], set()
    for name in families:
        got = SCOPED[name].apply(spark, {"x": x, "seg": segs})
        names = [c for c in got.columns if c not in ("id", "scope") and c not in seen]
        seen |= set(names)
        if names and "scope" not in got.columns:
            parts.append(got.select("id", *names))
        elif names:
            windows = [s for s in scopes if not (s == "full" and name in WINDOWS_ONLY)]
            parts.append(got.groupBy("id").agg(*[F.max(F.when(F.col("scope") == s, F.col(c))).alias(named(c, s)) for s in windows for c in names]))
    return reduce(lambda a, b: a.join(b, "id", "full_outer"), parts)


def features_sql(families: tuple[str, ...] = DEFAULT) -> str:
    """The same matrix of the supplier series in DuckDB's SQL."""
    parts, seen, names = [], set(), ["id"]
    for k, name in enumerate(families):
        f = SCOPED[name]
        found = outputs(f.steps[-1][1])
        fresh = [c for c in found if c not in ("id", "scope") and c not in seen]
        seen |= set(fresh)
        if "scope" in found:
            pairs = {named(c, s): f"max(CASE WHEN scope = '{s}' THEN {c} END)" for s in series.SCOPES if not (s == "full" and name in WINDOWS_ONLY) for c in fresh}
        else:
            pairs = {c: f"max({c})" for c in fresh}
        names += pairs
        parts.append(f"(SELECT id, {', '.join(f'{e} AS {n}' for n, e in pairs.items())} FROM ({f.oracle()}) q{k} GROUP BY id) p{k}")
    return f"SELECT {', '.join(names)} FROM {parts[0]} " + " ".join(f"FULL JOIN {p} USING (id)" for p in parts[1:])


def rank_mean(wide: DataFrame) -> DataFrame:
    """``id, score``: mean over features of the average-tie rank share; a missing value counts 0.5."""
    long = frames.stacked(wide, frames.names(wide))
    return ranking.ranked(long, ["feature"], "value").groupBy("id").agg(F.avg("r").alias("score"))


def baseline(table: DataFrame, families: tuple[str, ...] = DEFAULT) -> DataFrame:
    """Scores of series without any training."""
    return rank_mean(features(table, families))


@dataclass
class Bundle:
    """A trained model with what its inputs need: families, columns in order, training medians, and the aggregator whose score is one of the columns, if any."""

    model: PipelineModel
    families: tuple[str, ...]
    columns: list[str]
    medians: dict[str, float]
    aggregator: learning.LearnedAggregator | None = None

    def inputs(self, table: DataFrame) -> DataFrame:
        """Features of any series table as the model takes them: the same columns, missing values at their medians."""
        wide = frames.finite(features(table, self.families))
        if self.aggregator is not None:
            wide = tables.staged(wide, "features")
            wide = wide.join(self.aggregator.transform(wide, META), "id", "left")
        return frames.aligned(wide, self.columns).fillna(self.medians)

    def save(self, path: str) -> None:
        """Writes the bundle to a folder, over an older one."""
        self.model.write().overwrite().save(f"{path}/model")
        if self.aggregator is not None:
            self.aggregator.save(f"{path}/aggregator")
        spark = SparkSession.getActiveSession()
        state = json.dumps({"families": self.families, "columns": self.columns, "medians": self.medians, "aggregator": self.aggregator is not None})
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        aggregator = learning.LearnedAggregator.load(f"{path}/aggregator") if state.get("aggregator") else None
        return cls(PipelineModel.load(f"{path}/model"), tuple(state["families"]), state["columns"], state["medians"], aggregator)


def train(table: DataFrame, labels: DataFrame, families: tuple[str, ...] = DEFAULT, columns: list[str] | None = None, aggregated: bool = False, top: int = 40) -> Bundle:
    """Boosted trees on the features of labelled series ``labels(id, y)``.

    Constant columns are dropped and missing values set to the training medians; with
    ``columns`` (such as a selection's) only those are used, and each must be there. If ``aggregated``,
    the score of a learned aggregation is one more column: in training each row has the score
    of a model of the other folds, in inference that of a model of all training rows.
    """
    wide = frames.finite(features(table, families))
    if columns is not None:
        wide = frames.aligned(frames.check(wide, columns), columns)
    labelled = labels.select("id", F.col("y").cast("double").alias("y"))
    wide = tables.staged(wide.join(labelled.select("id"), "id", "left_semi"), "features")
    wide = wide.drop(*frames.constant(wide))
    aggregator = None
    if aggregated:
        scores = learning.learned_aggregation(wide, labelled, top).select("id", F.col("meta_agg_score").alias(META))
        aggregator = learning.LearnedAggregator.fit(wide, labelled, top)
        wide = tables.staged(wide.join(scores, "id", "left"), "features")
    middle = frames.medians(wide)
    data = wide.fillna(middle).join(labelled, "id")
    return Bundle(learning.boosted(list(middle)).fit(data), tuple(families), list(middle), middle, aggregator)


def infer(table: DataFrame, bundle: Bundle | None = None, families: tuple[str, ...] = DEFAULT) -> DataFrame:
    """``id, score``: by a trained bundle, else the baseline."""
    if bundle is None:
        return baseline(table, families)
    from pyspark.ml.functions import vector_to_array

    got = bundle.model.transform(bundle.inputs(table))
    return got.select("id", F.element_at(vector_to_array("probability"), 2).alias("score"))


def ar_kalman_scores(table: DataFrame, labels: DataFrame | None = None, top: int | None = None, mode: str = "rank_mean", folds: int = 5) -> DataFrame:
    """``id, score``: mean rank of the autoregression, filter and trend block.

    With ``labels(id, y)`` a labelled row is scored by the other folds alone: their columns'
    areas under the curve turn each column so that larger values mean a break, the ``top``
    columns (none: all) are taken, and their ranks among the other folds' values are averaged, or (``logistic``)
    weighed by a logistic model whose penalty those folds choose. Rows without a label are left out then.
    """
    if mode not in ("rank_mean", "logistic"):
        raise ValueError("mode is rank_mean or logistic")
    wide = frames.finite(features(table, ("ar_kalman_block",)))
    if labels is None:
        return rank_mean(wide)
    labelled = tables.staged(learning.folded(labels.select("id", F.col("y").cast("double").alias("y")), folds), "folds")
    wide = tables.staged(wide, "block")
    if mode == "logistic":
        return learning.learned_aggregation(wide, labelled, top or len(frames.names(wide)), 1.0, folds, learning.logistic_cv).select("id", F.col("meta_agg_score").alias("score"))
    long = tables.staged(frames.stacked(wide, frames.names(wide)).join(labelled, "id"), "long")
    # One row for each fold and feature: the area of the other folds.
    seen = long.crossJoin(F.broadcast(labelled.select(F.col("fold").alias("k")).distinct())).where("fold <> k")
    areas = ranking.area(seen, ["k", "feature"], "value")
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round(F.greatest("auc", 1 - F.col("auc")), 9)), "feature"))
    chosen = areas.withColumn("place", place).where(F.col("place") <= (top or 1 << 30)).select(F.col("k").alias("fold"), "feature", "auc")
    ranks = ranking.held_out(long, ["feature"], "value", "fold", folds).join(F.broadcast(chosen), ["fold", "feature"])
    return ranks.groupBy("id").agg(F.avg(F.when(F.col("auc") < 0.5, 1 - F.col("r")).otherwise(F.col("r"))).alias("score"))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide features of the supplier series."""
    return features(series.segments(spark, sf_dir))


BASELINE = ("quantile_deltas", "wasserstein", "ks_stat")


def engine_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(baseline(series.segments(spark, sf_dir), BASELINE), "score")


def _rounded(scores: DataFrame, name: str) -> DataFrame:
    return scores.select(*[c for c in scores.columns if c != name], F.round(F.col(name) + 1e-9, 4).alias(name))


def owing(spark: SparkSession, sf_dir: str, below: float) -> DataFrame:
    """Suppliers whose account is below a sum, as labels."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < below).cast("int").alias("y"))


def ar_kalman_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose account is low as labels; the ten best columns of the other folds."""
    return _rounded(ar_kalman_scores(series.segments(spark, sf_dir), owing(spark, sf_dir, BELOW), 10), "score")


def _break_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.staged(frames.finite(features(series.segments(spark, sf_dir), BREAK_FAMILIES)), "break")


def break_likelihood_49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weighted statistics, fitted on and applied to the supplier series."""
    wide = _break_matrix(spark, sf_dir)
    return _rounded(likelihood.BreakLikelihood().fit(wide).transform(wide), "break_likelihood")


def break_likelihood_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(likelihood.stateless(_break_matrix(spark, sf_dir)), "break_likelihood")


def break_likelihood_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(likelihood.stateless(_break_matrix(spark, sf_dir), "zscore_logit"), "break_likelihood")


def break_likelihood_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold scored by medians and quartile ranges of the other folds."""
    wide = _break_matrix(spark, sf_dir)
    folds = tables.staged(learning.folded(owing(spark, sf_dir, BELOW)), "folds").select("id", "fold")
    data = tables.staged(wide.join(folds, "id"), "break")
    parts = []
    for k in range(learning.FOLDS):
        made = likelihood.BreakLikelihood("zscore_logit").fit(data.where(F.col("fold") != k).drop("fold"))
        parts.append(made.transform(data.where(F.col("fold") == k).drop("fold")))
    return _rounded(reduce(DataFrame.union, parts), "break_likelihood")


def learned_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = frames.finite(features(series.segments(spark, sf_dir), ("quantile_deltas", "ks_stat", "scale_shift")))
    return learning.learned_aggregation(wide, owing(spark, sf_dir, BELOW))


QUERIES = {
    "feature_matrix": feature_matrix, "engine_baseline": engine_baseline, "ar_kalman_scorer": ar_kalman_scorer, "learned_aggregation": learned_aggregation,
    "break_likelihood_49": break_likelihood_49, "break_likelihood_rank": break_likelihood_rank, "break_likelihood_z": break_likelihood_z, "break_likelihood_fitted": break_likelihood_fitted,
}


def _long_sql(wide: str, names: list[str]) -> str:
    return f"WITH wide AS ({wide}), f AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM wide" for n in names) + ")"


#: Average-tie rank as a share, and the share of values that are not above; 0.5 where there is none.
_TIED = "CASE WHEN value IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY feature ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0) / count(value) OVER (PARTITION BY feature) END"
_NOT_ABOVE = "CASE WHEN value IS NULL THEN 0.5 ELSE count(value) OVER (PARTITION BY feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count(value) OVER (PARTITION BY feature) AS DOUBLE) END"


def _likelihood_sql(kind: str) -> str:
    """The four queries of the break likelihood by plain windows and quantiles."""
    weights, total = likelihood.WEIGHTS, sum(likelihood.WEIGHTS.values())
    start = _long_sql(features_sql(BREAK_FAMILIES), list(weights))
    w = "CASE feature " + " ".join(f"WHEN '{c}' THEN {v!r}" for c, v in weights.items()) + " END"
    if kind in ("rank", "49"):
        r = _TIED if kind == "rank" else _NOT_ABOVE
        return f"{start} SELECT id, round(sum(w * r) / {total!r} + 1e-9, 4) AS break_likelihood FROM (SELECT id, {w} AS w, {r} AS r FROM f) z GROUP BY id"
    quartiles = ", ".join(f"quantile_cont(value, {s}) AS q{i}" for i, s in ((1, 0.25), (2, 0.5), (3, 0.75)))
    if kind == "z":
        z = "CASE WHEN value IS NULL OR q3 - q1 <= 1e-12 THEN 0 ELSE greatest(least((value - q2) / (q3 - q1), 6), -6) END"
        return f"{start} SELECT f.id, round(1 / (1 + exp(-sum({w.replace('feature', 'f.feature')} * {z}) / {total!r})) + 1e-9, 4) AS break_likelihood FROM f JOIN (SELECT feature, {quartiles} FROM f WHERE value IS NOT NULL GROUP BY feature) q ON f.feature = q.feature GROUP BY f.id"
    folds = f"SELECT id, (row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', CAST(id AS VARCHAR), '{learning.SEED}')), id) - 1) % {learning.FOLDS} AS fold FROM (SELECT s_suppkey AS id, CASE WHEN s_acctbal < {BELOW} THEN 1 ELSE 0 END AS y FROM supplier) s"
    z = "CASE WHEN value IS NULL THEN 0 ELSE (value - q2) / CASE WHEN q3 - q1 <= 1e-12 THEN 1 ELSE q3 - q1 END END"
    return f"{start}, o AS ({folds}), q AS (SELECT k, feature, {quartiles} FROM f JOIN o ON f.id = o.id CROSS JOIN range({learning.FOLDS}) t(k) WHERE fold <> k AND value IS NOT NULL GROUP BY k, feature) SELECT f.id, round(1 / (1 + exp(-sum({w.replace('feature', 'f.feature')} * {z}) / {total!r})) + 1e-9, 4) AS break_likelihood FROM f JOIN o ON f.id = o.id JOIN q ON q.k = o.fold AND q.feature = f.feature GROUP BY f.id"


def _baseline_sql() -> str:
    names = [named(c, s) for f in BASELINE for c in outputs(SCOPED[f].steps[-1][1]) if c not in ("id", "scope") for s in series.SCOPES]
    return f"{_long_sql(features_sql(BASELINE), names)} SELECT id, round(avg(r) + 1e-9, 4) AS score FROM (SELECT id, {_TIED} AS r FROM f) z GROUP BY id"


def _scorer_sql(top: int = 10, folds: int = 5) -> str:
    """The scorer by plain windows, and shares by comparing rows."""
    names = outputs(SCOPED["ar_kalman_block"].steps[-1][1])[1:]
    return f"""{_long_sql(features_sql(("ar_kalman_block",)), names)},
o AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', CAST(id AS VARCHAR), '{learning.SEED}')), id) - 1) % {folds} AS fold FROM (SELECT s_suppkey AS id, CASE WHEN s_acctbal < {BELOW} THEN 1 ELSE 0 END AS y FROM supplier) s),
l AS (SELECT f.id, feature, value, y, fold FROM f JOIN o ON f.id = o.id),
s AS (SELECT k, feature, value, y FROM l CROSS JOIN range({folds}) t(k) WHERE fold <> k AND value IS NOT NULL),
a AS (SELECT k, feature, coalesce((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 0.5) AS auc FROM (SELECT *, rank() OVER (PARTITION BY k, feature ORDER BY value) + (count(*) OVER (PARTITION BY k, feature, value) - 1) / 2.0 AS r FROM s) z GROUP BY k, feature),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(greatest(auc, 1 - auc), 9) DESC, feature) AS place FROM a),
h AS (SELECT l.id, l.feature, l.fold, l.value, avg(CASE WHEN s.value <= l.value THEN 1.0 ELSE 0.0 END) AS r FROM l JOIN c ON c.k = l.fold AND c.feature = l.feature AND c.place <= {top} JOIN s ON s.k = l.fold AND s.feature = l.feature GROUP BY l.id, l.feature, l.fold, l.value)
SELECT id, round(avg(CASE WHEN auc < 0.5 THEN 1 - r ELSE r END) + 1e-9, 4) AS score FROM (SELECT h.id, auc, CASE WHEN h.value IS NULL THEN 0.5 ELSE r END AS r FROM h JOIN c ON c.k = h.fold AND c.feature = h.feature) z GROUP BY id"""


ORACLES = {"ar_kalman_scorer": _scorer_sql(), "feature_matrix": features_sql(), "engine_baseline": _baseline_sql(), **{f"break_likelihood_{k}": _likelihood_sql(k) for k in ("49", "rank", "z", "fitted")}}

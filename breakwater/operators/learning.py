"""Learned aggregation of a feature matrix with pyspark.ml, all fits inside folds.

Substitutes are named as such: gradient-boosted trees of Spark for other libraries' trees.
Models are trained on features averaged by rank, imputed with training medians, and never on
the rows they score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.operators import boosting, frames, gram, ranking
from breakwater.operators.estimators import RankNormalizer
from breakwater.sources import tables

SEED, FOLDS = 42, 3


def matrix_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, y, f0..``: all components of the embeddings and whether the label is below 3."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null and label is not null")
    dims = e.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    return e.select(F.col("vec_id").alias("id"), (F.col("label") < 3).cast("double").alias("y"), *[F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"f{i}") for i in range(dims)])


def folded(df: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds ``fold``: a class's rows dealt evenly, in an order that only depends on id and seed."""
    digest = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed)))
    dealt = ranking.numbered(df.withColumn("_digest", digest), ["y"], "_digest", ["id"])
    return dealt.select(*df.columns, (F.col("at") % folds).cast("int").alias("fold"))


def labelled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with its folds, written once for all fits on it."""
    return tables.staged(folded(matrix_of(spark, sf_dir)), "matrix")


def leafwise_scores(spark: SparkSession, sf_dir: str, settings: boosting.Settings = boosting.Settings(trees=8, leaves=15, l2=1.0, l1=0.1, rows=0.8, columns=0.5, patience=3)) -> DataFrame:
    """``id, y, fold, score``: boosted trees grown leaf by leaf, out of fold."""
    df = labelled_matrix(spark, sf_dir)
    columns = features(df)
    parts = []
    for k in range(FOLDS):
        model = boosting.fit(df.where(F.col("fold") != k), columns, settings)
        own = df.where(F.col("fold") == k)
        parts.append(own.select("id", "y", "fold").join(model.score(own), "id"))
    return reduce(DataFrame.union, parts)


def features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("id", "y", "fold")]


def logistic(columns: list[str], reg: float = 0.01) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", regParam=reg)])


def logistic_cv(columns: list[str], folds: int = 2) -> CrossValidator:
    """Logistic regression with its penalty chosen by area under the curve."""
    model = logistic(columns)
    grid = ParamGridBuilder().addGrid(model.getStages()[-1].regParam, [0.1, 0.01]).build()
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y", numBins=0), numFolds=folds, seed=SEED, parallelism=4)


def boosted(columns: list[str], depth: int = 3, rounds: int = 15, sampling: float = 0.8, seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", maxDepth=depth, maxIter=rounds, stepSize=0.1, subsamplingRate=sampling, seed=seed)])


def forest(columns: list[str], seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=5, seed=seed)])


def scored(model, df: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(df).select("id", "y", "fold", F.element_at(vector_to_array("probability"), 2).alias(name))


def out_of_fold(df: DataFrame, make, name: str = "score", folds: int = FOLDS) -> DataFrame:
    """``id, y, fold, <name>``: each row scored by a model of the other folds."""
    parts = [scored(make(features(df)).fit(df.where(F.col("fold") != k)), df.where(F.col("fold") == k), name) for k in range(folds)]
    return reduce(DataFrame.union, parts)


def logistic_cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out_of_fold(labelled_matrix(spark, sf_dir), logistic_cv)


def gbt_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of differently grown boosted trees, out of fold."""
    df = labelled_matrix(spark, sf_dir)
    kinds = [dict(depth=2), dict(depth=3, seed=1), dict(depth=3, sampling=0.6, seed=2)]
    runs = [out_of_fold(df, lambda c, kw=kw: boosted(c, **kw)) for kw in kinds]
    return reduce(DataFrame.union, runs).groupBy("id", "y", "fold").agg(F.avg("score").alias("score"))


def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores, calibrated by a monotone map that is fitted on the other folds' scores."""
    raw = tables.staged(out_of_fold(labelled_matrix(spark, sf_dir), logistic), "scores")
    parts = []
    for k in range(FOLDS):
        fit = IsotonicRegression(featuresCol="score", labelCol="y", predictionCol="calibrated").fit(raw.where(F.col("fold") != k))
        parts.append(fit.transform(raw.where(F.col("fold") == k)).select("id", "y", "fold", "score", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("calibrated")))
    return reduce(DataFrame.union, parts)


def oof_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees, a forest and logistic regression out of fold; a logistic model of their scores, out of fold too."""
    df = labelled_matrix(spark, sf_dir)
    base = None
    for name, make in (("gbt", boosted), ("forest", forest), ("logistic", logistic)):
        one = out_of_fold(df, make, name)
        base = one if base is None else base.join(one.select("id", name), "id")
    return out_of_fold(tables.staged(base, "scores"), logistic, "stacked")


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature, importance`` of boosted trees, largest first."""
    df = labelled_matrix(spark, sf_dir)
    model = boosted(features(df)).fit(df).stages[-1]
    rows = sorted(zip(features(df), map(float, model.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def recursive_elimination(spark: SparkSession, sf_dir: str, keep: int = 8, step: int = 14) -> DataFrame:
    """``round, feature``: features left after each round that drops the ``step`` least important."""
    df = labelled_matrix(spark, sf_dir)
    left, rows, k = features(df), [], 0
    while len(left) > keep:
        model = boosted(left, rounds=5).fit(df).stages[-1]
        order = sorted(zip(map(float, model.featureImportances.toArray()), left))
        left = [f for _, f in order[min(step, len(left) - keep) :]]
        k += 1
        rows += [(k, f) for f in sorted(left)]
    return spark.createDataFrame(rows, "round int, feature string")


class LearnedAggregator:
    """A model of a feature matrix that is fitted on some of its rows and scores any: ``id, <name>``.

    Values become shares of the fitted rows' values not above them (0.5 where missing), the
    ``top`` features by area under the curve are taken, those correlated above ``limit`` with a
    better one dropped, and a logistic model (or ``make(columns)``) is trained.
    """

    def __init__(self, columns: list[str], model: PipelineModel):
        self.columns, self.model = columns, model

    @classmethod
    def fit(cls, wide: DataFrame, labels: DataFrame, top: int = 40, limit: float = 0.98, make=None) -> LearnedAggregator:
        """On the rows of ``wide`` that ``labels(id, y)`` has."""
        data = tables.staged(wide.join(labels.select("id", F.col("y").cast("double").alias("y")), "id"), "fitted")
        long = frames.stacked(data, frames.names(data)).join(data.select("id", "y"), "id")
        best = ranking.area(long, ["feature"], "value").orderBy(F.desc(F.greatest("auc", 1 - F.col("auc"))), "feature").limit(top)
        order = [r["feature"] for r in best.collect()]  # at most ``top`` names
        ranks = RankNormalizer(inputCols=order).fit(data)
        shares = tables.staged(ranks.transform(data.select("id", "y", *order)), "shares")
        columns = frames.correlated(shares, order, limit)
        ranks = ranks.copy()
        ranks.set(ranks.inputCols, columns)
        fitted = (make or logistic)(columns).fit(shares)
        return cls(columns, PipelineModel([ranks, *fitted.stages]))

    def transform(self, wide: DataFrame, name: str = "meta_agg_score") -> DataFrame:
        held = frames.aligned(wide.select("id", *[c for c in self.columns if c in wide.columns]), self.columns)
        return self.model.transform(held).select("id", F.element_at(vector_to_array("probability"), 2).alias(name))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> LearnedAggregator:
        model = PipelineModel.load(path)
        return cls(model.stages[0].getInputCols(), model)


def learned_aggregation(wide: DataFrame, labels: DataFrame, top: int = 40, limit: float = 0.98, folds: int = FOLDS, make=None) -> DataFrame:
    """``id, y, fold, meta_agg_score``: each labelled row scored by a :class:`LearnedAggregator` of the other folds."""
    labelled = tables.staged(folded(labels.select("id", F.col("y").cast("double").alias("y")), folds), "folds")
    data = tables.staged(wide.join(labelled.select("id"), "id", "left_semi"), "matrix")
    parts = []
    for k in range(folds):
        model = LearnedAggregator.fit(data, labelled.where(F.col("fold") != k), top, limit, make)
        own = data.join(labelled.where(F.col("fold") == k).select("id"), "id", "left_semi")
        parts.append(model.transform(own).join(labelled, "id").select("id", "y", "fold", "meta_agg_score"))
    return reduce(DataFrame.union, parts)


def stability_selection(wide: DataFrame, labels: DataFrame, most: int = 150, limit: float = 0.9, folds: int = FOLDS) -> list[str]:
    """Features by a blend of two ranks, greedily without those correlated above ``limit``.

    0.6 of the blend is the stability of the area under the curve over folds (its mean distance from
    a half over one plus its relative spread), 0.4 the mutual information of eight rank bins with the label.
    """
    labelled = folded(labels.select("id", F.col("y").cast("double").alias("y")), folds)
    long = frames.stacked(wide, frames.names(wide)).join(labelled, "id")
    areas = reduce(DataFrame.union, [ranking.area(long.where(F.col("fold") != k), ["feature"], "value") for k in range(folds)])
    off = F.abs(F.col("auc") - 0.5)
    stable = areas.groupBy("feature").agg((F.avg(off) / (1 + F.try_divide(F.stddev_pop(off), F.avg(off) + 1e-12))).alias("s"))
    rows = stable.join(mutual_information(long), "feature").collect()  # a row for each feature
    by = lambda c: {r["feature"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[c], r["feature"])))}
    s, m = by("s"), by("mi")
    order = sorted(s, key=lambda f: (-(0.6 * s[f] + 0.4 * m[f]), f))
    return frames.correlated(wide, order, limit)[:most]


def mutual_information(long: DataFrame, bins: int = 8) -> DataFrame:
    """``feature, mi`` of ``long(feature, value, y)``: of equal-rank bins with a label of two classes."""
    places = ranking.swept(long, ["feature"], "value", pos=F.col("y").cast("long"), neg=1 - F.col("y").cast("long"))
    total = F.col("pos_total") + F.col("neg_total")
    cells = places.withColumn("bin", F.floor(bins * (F.col("pos_below") + F.col("neg_below")) / total)).groupBy("feature", "bin").agg(*[F.sum(c).cast("double").alias(c) for c in ("pos", "neg")], *[F.first(f"{c}_total").cast("double").alias(f"{c}_total") for c in ("pos", "neg")])
    n, here = F.col("pos_total") + F.col("neg_total"), F.col("pos") + F.col("neg")
    part = lambda c: F.when(F.col(c) > 0, F.col(c) / n * F.ln(F.col(c) * n / (here * F.col(f"{c}_total")))).otherwise(0.0)
    return cells.groupBy("feature").agg(F.sum(part("pos") + part("neg")).alias("mi"))


def interaction_selection(wide: DataFrame, labels: DataFrame, top: int = 50, most: int = 5000, keep: int = 20, limit: float = 0.95, step: int = 512) -> tuple[DataFrame, list[str]]:
    """``id`` and the best interactions of the ``top`` features, and their names, best first.

    Features are taken by mutual information with the label, of their combinations at most ``most`` are
    made, as one array column. Constant ones are dropped; in the order of their information
    each is kept unless it correlates above ``limit`` with one kept before, up to ``keep``.
    """
    labelled = labels.select("id", F.col("y").cast("double").alias("y"))
    informed = lambda m, names: mutual_information(frames.stacked(m, names).join(labelled, "id"))
    best = [r["feature"] for r in informed(wide, frames.names(wide)).orderBy(F.desc("mi"), "feature").limit(top).collect()]
    made = frames.combinations(best, most)
    names = [f"{a}_{k}_{b}" for k, a, b in made]
    block = tables.staged(frames.combined(wide, made).select("id", "block"), "interactions")
    labels_of = F.lit(names)
    long = block.join(labelled, "id").select("y", F.posexplode("block").alias("at", "value")).where("value is not null and not isnan(value)")
    long = tables.staged(long.select("y", F.get(labels_of, F.col("at")).alias("feature"), "value"), "interactions")
    varied = long.groupBy("feature").agg((F.min("value") < F.max("value")).alias("varies")).where("varies").select("feature")
    order = [r["feature"] for r in mutual_information(long).join(varied, "feature").orderBy(F.desc("mi"), "feature").collect()]
    place, kept = {n: i for i, n in enumerate(names)}, []
    for at in range(0, len(order), step):
        part = [*kept, *order[at : at + step]]
        values = F.transform(F.lit([place[n] for n in part]), lambda i: F.get("block", i))
        kept = frames.unrelated(gram.correlations(block, part, values), part, limit)[:keep]
        if len(kept) == keep:
            break
    return block.select("id", *[F.get("block", F.lit(place[n])).alias(n) for n in kept]), kept


QUERIES = {"logistic_cv": logistic_cv_scores, "gbt_ensemble": gbt_ensemble, "isotonic": isotonic, "oof_stack": oof_stack, "feature_importance": feature_importance, "recursive_elimination": recursive_elimination, "leafwise_scores": leafwise_scores}

"""Pipeline stages, leaf-wise trees and the two-level bundle against numpy and by their guarantees."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from breakwater.operators import boosting, learning
from breakwater.operators.estimators import BreakScorer, MedianImputer, RankNormalizer
from breakwater.plans import engine

from .test_engine import breaks


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 160)
    x = rng.normal(size=(160, 3)) + y[:, None] * np.array([1.0, 0.0, 0.5])
    rows = [(i, float(y[i]), *[None if rng.random() < 0.15 else float("nan") if rng.random() < 0.05 else float(v) for v in x[i]], f"note{i}") for i in range(160)]
    return spark.createDataFrame(rows, "id long, y double, delta_rmse double, energy_w50 double, acf1_shift double, note string").repartition(4), rows


NAMES = ["delta_rmse", "energy_w50", "acf1_shift"]


def test_stages_know_only_the_rows_they_were_fitted_on(spark, matrix, tmp_path):
    wide, rows = matrix
    train, test = wide.where("id < 100"), wide.where("id >= 100")
    stages = Pipeline(stages=[MedianImputer(inputCols=NAMES), RankNormalizer(inputCols=NAMES), VectorAssembler(inputCols=NAMES, outputCol="x")]).fit(train)
    stages.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    for model in (stages, again):
        got = {r.id: r for r in model.transform(test).collect()}
        assert set(got) == set(range(100, 160))
        for k, name in enumerate(NAMES):
            known = [r[2 + k] for r in rows[:100]]
            middle = np.median([v for v in known if v is not None and v == v])
            filled = np.array([middle if v is None or v != v else v for v in known])
            for i, r in got.items():
                v = rows[i][2 + k]
                v = middle if v is None or v != v else v
                assert r[name] == pytest.approx((filled <= v).mean()) and r.x[k] == r[name] and r.note == f"note{i}"
    alone = RankNormalizer(inputCols=["empty"]).fit(wide.withColumn("empty", F.lit(None).cast("double")))
    assert {r.empty for r in alone.transform(wide.withColumn("empty", F.lit(1.0))).collect()} == {0.5}


def test_stages_inside_a_cross_validator(matrix):
    wide, _ = matrix
    model = LogisticRegression(featuresCol="x", labelCol="y")
    steps = Pipeline(stages=[MedianImputer(inputCols=NAMES), RankNormalizer(inputCols=NAMES), VectorAssembler(inputCols=NAMES, outputCol="x"), model])
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 10.0]).build()
    fitted = CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=2, seed=1).fit(wide)
    assert max(fitted.avgMetrics) > 0.7
    assert fitted.bestModel.transform(wide).count() == 160


@pytest.mark.parametrize("mode", ["rank_mean", "zscore_logit"])
def test_break_scorer_as_a_stage(matrix, tmp_path, mode):
    wide, _ = matrix
    fitted = Pipeline(stages=[BreakScorer(mode=mode, outputCol="s")]).fit(wide.where("id < 100"))
    fitted.write().overwrite().save(str(tmp_path / mode))
    a, b = ({r.id: r.s for r in m.transform(wide).collect()} for m in (fitted, PipelineModel.load(str(tmp_path / mode))))
    assert a == b and len(a) == 160 and all(0 <= v <= 1 for v in a.values())
    assert BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="s").evaluate(fitted.transform(wide)) > 0.6


def planted(spark, n=600, seed=5):
    """A label that needs a deep, lopsided tree: an interaction inside one corner of the first column."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 5))
    corner = x[:, 0] > 0.6
    y = np.where(corner, (x[:, 1] > 0.5) ^ (x[:, 2] > 0.5), x[:, 0] > 0.3) ^ (rng.random(n) < 0.03)
    rows = [(i, float(y[i]), *[None if rng.random() < 0.03 else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, " + ", ".join(f"f{k} double" for k in range(5))).repartition(4, "id")


def _auc(scores, labels):
    p, n = scores[labels == 1], scores[labels == 0]
    return ((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n))


def test_leafwise_trees(spark, tmp_path):
    train, test = planted(spark), planted(spark, 400, 6)
    columns = [f"f{k}" for k in range(5)]
    s = boosting.Settings(trees=10, leaves=8, rate=0.4, l1=0.01, l2=0.5, least_rows=8, rows=0.9, columns=0.8, patience=10)
    model = boosting.fit(train, columns, s)
    again = boosting.fit(train, columns, s)
    assert [t.__dict__ for t in model.trees] == [t.__dict__ for t in again.trees]
    model.save(spark, str(tmp_path / "m"))
    loaded = boosting.LeafwiseModel.load(spark, str(tmp_path / "m"))
    got = {r.id: r.score for r in model.score(test).collect()}
    assert got == {r.id: r.score for r in loaded.score(test).collect()}
    y = {r.id: r.y for r in test.collect()}
    ids = sorted(y)
    mine = _auc(np.array([got[i] for i in ids]), np.array([y[i] for i in ids]))
    # As many leaves, but all of one depth: 8 leaves are three levels.
    whole = train.fillna(0.5)
    deep = learning.boosted(columns, depth=3, rounds=10, sampling=0.9).fit(whole)
    other = {r.id: float(r.probability[1]) for r in deep.transform(test.fillna(0.5)).collect()}
    assert mine > 0.85 and mine > _auc(np.array([other[i] for i in ids]), np.array([y[i] for i in ids])) - 0.005
    assert model.importance()["f0"] > 0 and sum(model.importance().values()) <= 7 * len(model.trees)
    assert all(len([v for v in t.column if v < 0]) <= 8 for t in model.trees)
    assert model.losses[-1] < model.losses[0]


def test_early_stop_on_noise_and_single_classes(spark):
    rng = np.random.default_rng(1)
    noise = spark.createDataFrame([(i, float(rng.integers(0, 2)), float(rng.normal())) for i in range(300)], "id long, y double, a double")
    model = boosting.fit(noise, ["a"], boosting.Settings(trees=12, leaves=6, rate=0.5, patience=2, least_rows=5))
    assert len(model.trees) < 12 and len(model.losses) <= len(model.trees) + 4
    flat = boosting.fit(noise.withColumn("y", F.lit(1.0)), ["a"])
    assert flat.trees == [] and all(r.score > 0.99 for r in flat.score(noise).collect())
    assert boosting.fit(noise.limit(0), ["a"]).trees == []


def test_best_split_by_trying_all():
    """The split found from running sums is the one that trying every bin of every column finds."""
    rng = np.random.default_rng(2)
    s = boosting.Settings(l1=0.3, l2=0.7, least_rows=5)
    for _ in range(20):
        rows = 200
        bins = rng.integers(0, 6, (rows, 3))
        bins[rng.random((rows, 3)) < 0.1] = boosting.BINS
        g, h = rng.normal(size=rows), rng.random(rows)
        sums = np.zeros((3, boosting.BINS + 1, 3))
        for c in range(3):
            for k, v in enumerate((g, h, np.ones(rows))):
                sums[c, :, k] = np.bincount(bins[:, c], v, boosting.BINS + 1)
        worth = lambda m: (np.sign(g[m].sum()) * max(abs(g[m].sum()) - 0.3, 0)) ** 2 / (h[m].sum() + 0.7)
        best = 0.0
        for c in range(3):
            for b in range(boosting.BINS):
                for missing in (True, False):
                    left = np.where(bins[:, c] == boosting.BINS, missing, bins[:, c] <= b)
                    if min(left.sum(), (~left).sum()) >= 5:
                        best = max(best, (worth(left) + worth(~left) - worth(left | True)) / 2)
        gain, c, b, missing, sides = boosting._best(sums, s)
        assert gain == pytest.approx(best, abs=1e-9)
        left = np.where(bins[:, c] == boosting.BINS, missing, bins[:, c] <= b)
        assert sides[0] == pytest.approx(g[left].sum()) and sides[5] == (~left).sum()


def test_two_level_bundle(spark, tmp_path):
    """Inference computes what training did; the deployed model has the meta feature; shuffled labels give no area."""
    table, labels = breaks(spark, 40, 30)
    bundle = engine.train(table, labels, ("quantile_deltas", "scale_shift"), aggregated=True, top=6)
    assert engine.META in bundle.columns and bundle.aggregator.columns
    bundle.save(str(tmp_path / "b"))
    again = engine.Bundle.load(spark, str(tmp_path / "b"))
    a, b = ({r.id: r.score for r in engine.infer(table, m).collect()} for m in (bundle, again))
    assert a == pytest.approx(b) and again.aggregator.columns == bundle.aggregator.columns
    meta = {r.id: r[engine.META] for r in bundle.inputs(table).collect()}
    assert meta == pytest.approx({r.id: r.meta_agg_score for r in bundle.aggregator.transform(engine.features(table, ("quantile_deltas", "scale_shift"))).collect()})
    y = {r.id: r.y for r in labels.collect()}
    assert _auc(np.array([a[i] for i in y]), np.array(list(y.values()))) > 0.95
    # Out of fold, labels without meaning stay without it: no row has seen its own.
    wide = engine.features(table, ("quantile_deltas", "scale_shift"))
    areas = []
    for seed in range(3):
        rng = np.random.default_rng(seed)
        mixed = dict(zip(y, rng.permutation(list(y.values()))))
        rows = learning.learned_aggregation(wide, spark.createDataFrame([(i, int(v)) for i, v in mixed.items()], "id long, y int"), top=6).collect()
        areas.append(_auc(np.array([r.meta_agg_score for r in rows]), np.array([r.y for r in rows])))
    assert abs(np.mean(areas) - 0.5) < 0.2 and all(math.isfinite(v) for v in areas)

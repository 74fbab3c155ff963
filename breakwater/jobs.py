"""Jobs for spark-submit: features, train, infer and diagnose, over one settings object.

    spark-submit --py-files breakwater.zip breakwater/jobs.py train --data DIR --model DIR [--settings FILE]

Training writes its settings beside the model, and inference reads them from there, so both
compute the same columns.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.operators import frames, learning, ranking
from breakwater.plans import engine
from breakwater.session import ship
from breakwater.sources import series, tables


@dataclass
class Settings:
    """What a run is told, in one JSON file or by options of the same names."""

    families: list[str] = field(default_factory=lambda: list(engine.DEFAULT))
    #: Only the series of so many smallest ids; 0: all.
    first: int = 0
    folds: int = 5
    aggregated: bool = False
    top: int = 40
    #: Only these columns, such as those of a selection.
    columns: list[str] = field(default_factory=list)
    #: What becomes of lines of a text file that do not fit: fail, drop or keep.
    bad: str = "fail"

    def check(self) -> Settings:
        unknown = sorted(set(self.families) - set(engine.SCOPED))
        if unknown:
            raise ValueError(f"unknown families: {unknown}; known are {sorted(engine.SCOPED)}")
        if self.bad not in series.BAD:
            raise ValueError(f"bad is one of {series.BAD}")
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "settings string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        state = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
        unknown = sorted(set(state) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**state).check()


def _table(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    table = series.read_series(spark, path, bad=settings.bad, check=True)
    if "_corrupt_record" in table.columns:
        table = table.where("_corrupt_record is null")
    return series.first_ids(table, settings.first) if settings.first else table


def features(spark: SparkSession, settings: Settings, data: str, output: str) -> None:
    """The feature matrix of a series file, as Parquet."""
    frames.save_features(engine.features(_table(spark, data, settings), tuple(settings.families)), output)


def diagnosed(wide: DataFrame, labels: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """``feature, auc, oriented_auc, missing, constant`` of each column; ``fold, auc, n`` of the mean rank in each fold, ranked by the other folds."""
    labelled = tables.staged(learning.folded(labels.select("id", F.col("y").cast("double").alias("y")), folds), "folds")
    long = tables.staged(frames.stacked(wide, frames.names(wide)).join(labelled, "id"), "long")
    spread = long.groupBy("feature").agg(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("missing"), (F.coalesce(F.min("value"), F.lit(0.0)) == F.coalesce(F.max("value"), F.lit(0.0))).alias("constant"))
    by_column = spread.join(ranking.area(long, ["feature"], "value"), "feature", "left").select("feature", F.coalesce("auc", F.lit(0.5)).alias("auc"), F.greatest(F.coalesce("auc", F.lit(0.5)), 1 - F.coalesce("auc", F.lit(0.5))).alias("oriented_auc"), "missing", "constant")
    scores = ranking.held_out(long, ["feature"], "value", "fold", folds).groupBy("id", "fold").agg(F.first("y").alias("y"), F.round(F.avg("r"), 9).alias("score"))
    return by_column, ranking.area(scores, ["fold"], "score")


def train(spark: SparkSession, settings: Settings, data: str, model: str) -> None:
    """A bundle of the training split in a folder (``X_train``, ``y_train``), and its settings."""
    x, y = series.load_split(spark, data, "train")
    if settings.first:
        x = series.first_ids(x, settings.first)
    bundle = engine.train(x, y, tuple(settings.families), settings.columns or None, settings.aggregated, settings.top)
    bundle.save(model)
    settings.save(spark, f"{model}/settings")


def infer(spark: SparkSession, data: str, output: str, model: str | None = None, settings: Settings | None = None, labels: str | None = None) -> float | None:
    """Predictions of a series file as CSV: by a bundle with its own settings, else the baseline. With labels (``id, y`` or ``label``) the area under the curve."""
    if model:
        settings = Settings.load(spark, f"{model}/settings")
    settings = settings or Settings()
    table = _table(spark, data, settings)
    bundle = engine.Bundle.load(spark, model) if model else None
    scores = tables.staged(engine.infer(table, bundle, tuple(settings.families)), "scores")
    series.save_predictions(scores, output)
    if not labels:
        return None
    known = series.read_series(spark, labels, bad=settings.bad)
    y = known.select("id", F.col("y" if "y" in known.columns else "label").cast("int").alias("y"))
    return ranking.area(scores.join(y, "id").withColumn("one", F.lit(1)), ["one"], "score").first()["auc"]


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=("features", "train", "infer", "diagnose"))
    parser.add_argument("--data", required=True, help="a series file; for train and diagnose the folder of the training split")
    parser.add_argument("--output", help="where features, predictions or diagnostics go")
    parser.add_argument("--model", help="the bundle's folder")
    parser.add_argument("--labels", help="labels of the series that are scored")
    parser.add_argument("--settings", help="a JSON file of settings")
    parser.add_argument("--families", nargs="+")
    parser.add_argument("--columns", nargs="+")
    parser.add_argument("--first", type=int)
    parser.add_argument("--folds", type=int)
    parser.add_argument("--top", type=int)
    parser.add_argument("--aggregated", action="store_true", default=None)
    parser.add_argument("--bad", choices=series.BAD)
    given = parser.parse_args(arguments)
    need = {"features": "output", "infer": "output", "diagnose": "output", "train": "model"}[given.job]
    if not getattr(given, need):
        parser.error(f"{given.job} needs --{need}")
    spark = ship(SparkSession.builder.appName("breakwater").getOrCreate())
    settings = Settings.load(spark, given.settings) if given.settings else Settings()
    for f in fields(Settings):
        if getattr(given, f.name) is not None:
            setattr(settings, f.name, getattr(given, f.name))
    settings.check()
    with tables.scratch(spark):
        if given.job == "features":
            features(spark, settings, given.data, given.output)
        elif given.job == "train":
            train(spark, settings, given.data, given.model)
        elif given.job == "infer":
            auc = infer(spark, given.data, given.output, given.model, settings, given.labels)
            if auc is not None:
                print(json.dumps({"auc": auc}))
        else:
            x, y = series.load_split(spark, given.data, "train")
            wide = engine.features(series.first_ids(x, settings.first) if settings.first else x, tuple(settings.families))
            by_column, by_fold = diagnosed(tables.staged(wide, "features"), y, settings.folds)
            by_column.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{given.output}/columns")
            by_fold.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{given.output}/folds")


if __name__ == "__main__":
    main()

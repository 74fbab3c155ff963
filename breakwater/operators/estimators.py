"""Imputer, rank normaliser and break likelihood as stages of a pyspark.ml Pipeline.

What a stage knows of the rows it was fitted on is kept in its model: medians as a parameter,
training values as a table, which is saved beside the stage. So inside a CrossValidator every
fold is imputed, ranked and scored by the other folds alone.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.operators import frames, likelihood, ranking
from breakwater.sources import tables


class _HasId(Params):
    idCol = Param(Params._dummy(), "idCol", "column that tells rows apart", TypeConverters.toString)

    def getIdCol(self) -> str:
        return self.getOrDefault(self.idCol)


class _Setters(HasInputCols, _HasId):
    def _fill(self, kwargs: dict) -> None:
        self._setDefault(idCol="id")
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


def _clean(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """``id`` and the columns as doubles, NaN as null."""
    value = lambda c: F.col(c).cast("double")
    return df.select(F.col(ident).alias("id"), *[F.when(~F.isnan(value(c)), value(c)).alias(c) for c in columns])


def _long(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    return frames.stacked(_clean(df, ident, columns), columns)


class MedianImputer(_Setters, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fills nulls and NaN of the input columns with the exact medians of the rows it is fitted on; 0 for a column without values."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, idCol: str | None = None):
        super().__init__()
        self._fill(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        columns = self.getInputCols()
        rows = ranking.quantiles(_long(dataset, self.getIdCol(), columns), ["feature"], "value", {"m": 0.5}).collect()  # a row for each column
        found = {r["feature"]: float(r["m"]) for r in rows}
        return self._copyValues(MedianImputerModel(medians=[found.get(c, 0.0) for c in columns]))


class MedianImputerModel(_Setters, Model, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "of the input columns, in their order", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, medians: list[float] | None = None):
        super().__init__()
        self._fill(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = lambda c: F.col(c).cast("double")
        fill = dict(zip(self.getInputCols(), self.getOrDefault(self.medians)))
        return dataset.withColumns({c: F.when(value(c).isNull() | F.isnan(value(c)), F.lit(m)).otherwise(value(c)) for c, m in fill.items()})


class _TableWriter(MLWriter):
    """Parameters, and what :meth:`_save_tables` of the model writes beside them."""

    def __init__(self, instance: Model):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_tables(self.sparkSession, path)


class _TableReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Model:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.cls()
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        made._load_tables(self.sparkSession, path)
        return made


class _WithTables(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class RankNormalizer(_Setters, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces each input column by the share of the fitted rows' values that are not above it; 0.5 where it, or all of those, are missing.

    ``idCol`` must be unique in a table that is transformed.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, idCol: str | None = None):
        super().__init__()
        self._fill(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RankNormalizerModel:
        made = RankNormalizerModel()
        made.places = tables.staged(_long(dataset, self.getIdCol(), self.getInputCols()).select("feature", "value").where("value is not null"), "places")
        return self._copyValues(made)


class RankNormalizerModel(_Setters, Model, _WithTables):
    places: DataFrame | None = None

    def __init__(self):
        super().__init__()
        self._fill({})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, ident = self.getInputCols(), self.getIdCol()
        shares = ranking.against(_long(dataset, ident, columns), self.places, ["feature"], "value")
        wide = shares.groupBy("id").pivot("feature", columns).agg(F.first("r")).withColumnRenamed("id", ident)
        kept = dataset.drop(*columns).join(wide, ident, "left")
        return kept.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.5)).alias(c) if c in columns else F.col(f"`{c}`") for c in dataset.columns])

    def _save_tables(self, spark: SparkSession, path: str) -> None:
        self.places.write.mode("overwrite").parquet(f"{path}/places")

    def _load_tables(self, spark: SparkSession, path: str) -> None:
        self.places = spark.read.parquet(f"{path}/places")


class BreakScorer(_Setters, HasOutputCol, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the break likelihood of the weighted statistics among the columns, fitted on the rows it is given."""

    mode = Param(Params._dummy(), "mode", "rank_mean or zscore_logit", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, mode: str | None = None, outputCol: str | None = None, idCol: str | None = None):
        super().__init__()
        self._setDefault(mode="rank_mean", outputCol="break_likelihood")
        self._fill(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BreakScorerModel:
        made = BreakScorerModel()
        columns = [c for c in likelihood.WEIGHTS if c in dataset.columns]
        rows = tables.staged(_clean(dataset, self.getIdCol(), columns), "scorer")
        made.scorer = likelihood.BreakLikelihood(self.getOrDefault(self.mode)).fit(rows)
        return self._copyValues(made)


class BreakScorerModel(_Setters, HasOutputCol, Model, _WithTables):
    mode = Param(Params._dummy(), "mode", "rank_mean or zscore_logit", TypeConverters.toString)
    scorer: likelihood.BreakLikelihood | None = None

    def __init__(self):
        super().__init__()
        self._setDefault(mode="rank_mean", outputCol="break_likelihood")
        self._fill({})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ident = self.getIdCol()
        scores = self.scorer.transform(_clean(dataset, ident, [c for c in self.scorer.columns if c in dataset.columns]))
        return dataset.join(scores.select(F.col("id").alias(ident), F.col("break_likelihood").alias(self.getOutputCol())), ident, "left")

    def _save_tables(self, spark: SparkSession, path: str) -> None:
        self.scorer.save(spark, f"{path}/scorer")

    def _load_tables(self, spark: SparkSession, path: str) -> None:
        self.scorer = likelihood.BreakLikelihood.load(spark, f"{path}/scorer")

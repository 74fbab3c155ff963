"""Break likelihood: weighted statistics of change as one number in [0, 1]."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.operators import frames, ranking

#: The statistics and their weights; names end in the window, without an end for whole segments.
WEIGHTS = {
    "delta_rmse": 2.0, "delta_rmse_w50": 1.8, "delta_rmse_w100": 2.0, "delta_rmse_w250": 1.8,
    "delta_resid_var": 1.5, "delta_resid_var_w50": 1.3, "delta_resid_var_w100": 1.5, "delta_resid_var_w250": 1.3,
    "energy": 1.5, "energy_w50": 1.3, "energy_w100": 1.3, "energy_w250": 1.5,
    "wasserstein": 1.2, "wasserstein_w250": 1.2,
    "delta_ar1_phi": 1.2, "delta_ar1_phi_w50": 1.0, "delta_ar1_phi_w100": 1.0, "delta_ar1_phi_w250": 1.2,
    "acf1_shift": 1.0, "acf1_shift_w50": 0.9, "acf1_shift_w100": 0.9, "acf1_shift_w250": 1.0,
    "mad_ratio": 1.2, "mad_ratio_w50": 1.0, "mad_ratio_w100": 1.0, "mad_ratio_w250": 1.2,
    "delta_log_low_high": 0.9, "delta_log_low_high_w50": 0.8, "delta_log_low_high_w100": 0.8, "delta_log_low_high_w250": 0.9,
    "delta_spec_entropy": 0.9, "delta_spec_entropy_w50": 0.8, "delta_spec_entropy_w100": 0.8, "delta_spec_entropy_w250": 0.9,
    "delta_peak_ratio": 0.8, "delta_flatness": 0.7, "delta_flux": 0.7, "delta_rolloff50": 0.7, "delta_bandwidth": 0.7, "delta_hf_power": 0.7,
    "delta_wav_energy_l1": 0.8, "delta_wav_energy_l1_w250": 0.8, "delta_wav_energy_l2": 0.7, "delta_wav_energy_l2_w250": 0.7, "delta_wav_energy_l3": 0.6, "delta_wav_energy_l3_w250": 0.6,
    "delta_wav_entropy": 0.7, "delta_wav_low_energy_share": 0.6, "delta_wav_high_energy_share": 0.6,
}
MODES = ("rank_mean", "zscore_logit")


def _present(wide: DataFrame, weights: dict[str, float]) -> tuple[dict[str, float], float]:
    have = {c: w for c, w in weights.items() if c in wide.columns}
    if not have:
        raise ValueError("the matrix has none of the weighted statistics")
    return have, sum(have.values())


def _weighted(rows: DataFrame, value: str, weights: dict[str, float], total: float) -> DataFrame:
    weight = F.coalesce(*[F.when(F.col("feature") == c, F.lit(w)) for c, w in weights.items()])
    return rows.groupBy("id").agg((F.sum(F.col(value) * weight) / total).alias("break_likelihood"))


def stateless(wide: DataFrame, mode: str = "rank_mean", weights: dict[str, float] | None = None) -> DataFrame:
    """``id, break_likelihood`` of a matrix by itself, nothing kept.

    ``rank_mean`` averages average-tie ranks as shares; ``zscore_logit`` clips distances from the
    median at six quartile ranges, and leaves out a statistic without a range.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    have, total = _present(wide, weights or WEIGHTS)
    long = frames.stacked(wide.select("id", *have), list(have))
    if mode == "rank_mean":
        return _weighted(ranking.ranked(long, ["feature"], "value"), "r", have, total)
    middle = ranking.quantiles(long, ["feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    z = F.greatest(F.least((F.col("value") - F.col("q2")) / (F.col("q3") - F.col("q1")), F.lit(6.0)), F.lit(-6.0))
    rows = long.join(F.broadcast(middle), "feature", "left").withColumn("z", F.when(F.col("value").isNull() | F.col("q1").isNull() | (F.col("q3") - F.col("q1") <= 1e-12), 0.0).otherwise(z))
    return _weighted(rows, "z", have, total).select("id", (1 / (1 + F.exp(-F.col("break_likelihood")))).alias("break_likelihood"))


class BreakLikelihood:
    """A scorer fitted on one wide matrix and applied to any: ``id, break_likelihood``.

    ``rank_mean`` averages the shares of training values that are not above a row's value (0.5
    for a missing one); ``zscore_logit`` puts the weighted mean distance from the training median, in
    quartile ranges, through the logistic function (0 for a missing one). Statistics that the
    matrix does not have are left out, with their weights.
    """

    def __init__(self, mode: str = "rank_mean", weights: dict[str, float] | None = None):
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.mode, self.weights = mode, dict(weights or WEIGHTS)
        self.columns: list[str] = []
        self.places: DataFrame | None = None
        self.quartiles: dict[str, tuple[float, float, float]] = {}

    def fit(self, wide: DataFrame) -> BreakLikelihood:
        self.columns = [c for c in self.weights if c in wide.columns]
        if not self.columns:
            raise ValueError("the matrix has none of the weighted statistics")
        long = frames.stacked(wide, self.columns)
        if self.mode == "rank_mean":
            self.places = long.select("feature", "value")
        else:
            rows = ranking.quantiles(long, ["feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()  # a row for each statistic
            self.quartiles = {r["feature"]: (r["q1"], r["q2"], r["q3"]) for r in rows}
        return self

    def transform(self, wide: DataFrame) -> DataFrame:
        if not self.columns:
            raise ValueError("fit first")
        held = frames.aligned(wide.select("id", *[c for c in self.columns if c in wide.columns]), self.columns)
        total = sum(self.weights[c] for c in self.columns)
        if self.mode == "zscore_logit":
            z = F.lit(0.0)
            for c in self.columns:
                q1, q2, q3 = self.quartiles.get(c, (0.0, 0.0, 0.0))
                z = z + self.weights[c] * F.coalesce((F.col(c) - q2) / (q3 - q1 if q3 - q1 > 1e-12 else 1.0), F.lit(0.0))
            return held.select("id", (1 / (1 + F.exp(-z / total))).alias("break_likelihood"))
        rows = ranking.against(frames.stacked(held, self.columns), self.places, ["feature"], "value")
        return _weighted(rows, "r", {c: self.weights[c] for c in self.columns}, total)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the fitted scorer to a folder."""
        spark.createDataFrame([(json.dumps({"mode": self.mode, "weights": self.weights, "columns": self.columns, "quartiles": self.quartiles}),)], "scorer string").coalesce(1).write.mode("overwrite").text(f"{path}/scorer")
        if self.places is not None:
            self.places.write.mode("overwrite").parquet(f"{path}/places")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BreakLikelihood:
        state = json.loads(spark.read.text(f"{path}/scorer").first()[0])
        made = cls(state["mode"], state["weights"])
        made.columns, made.quartiles = state["columns"], {k: tuple(v) for k, v in state["quartiles"].items()}
        if made.mode == "rank_mean":
            made.places = spark.read.parquet(f"{path}/places")
        return made

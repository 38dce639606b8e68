"""Training, scoring and explaining with Spark's own learners. They stand in for external AutoML engines: same tables in and
out, other models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train(df: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (), target: str = "target", weight: str | None = None, kind: str = "logistic", seed: int = 0) -> PipelineModel:
    """A fitted pipeline over imputed rows; categories are one-hot encoded, unseen ones kept apart."""
    stages = []
    if categories:
        stages += [StringIndexer(inputCols=list(categories), outputCols=[f"{c}_index" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories])]
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"{c}_hot" for c in categories)], outputCol="_features", handleInvalid="error"))
    options = {"featuresCol": "_features", "labelCol": "_label"} | ({"weightCol": weight} if weight else {})
    if kind == "logistic":
        stages.append(LogisticRegression(regParam=0.01, **options))
    elif kind == "trees":
        stages.append(GBTClassifier(maxDepth=4, maxIter=20, seed=seed, **options))
    else:
        raise ValueError(f"no such model: {kind}")
    return Pipeline(stages=stages).fit(df.withColumn("_label", F.col(target).cast("double")))


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The columns to keep, score and predicted."""
    p = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, p.alias("score"), (p >= threshold).alias("predicted"))


def linear_contributions(model: PipelineModel, df: DataFrame, key: str, numeric: Sequence[str]) -> DataFrame:
    """(key, feature, value, shap) of numeric features of a logistic model: weight times distance from the mean."""
    weights = model.stages[-1].coefficients.toArray()
    means = df.agg(*(F.avg(c).alias(c) for c in numeric)).first()
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"), (F.lit(float(w)) * (F.col(c) - F.lit(float(means[c] or 0)))).alias("shap")) for c, w in zip(numeric, weights)))
    return df.select(key, F.explode(cells).alias("_c")).select(key, "_c.*")


#: Sample sizes up to which a strength of regularisation and a grid of mixing weights hold.
CALIBRATION_GRIDS = ((1000, 0.01, (0.25, 0.5)), (5000, 0.1, (0.25, 0.5, 0.75)), (math.inf, 1.0, (0.2, 0.4, 0.6, 0.8, 1.0)))


def _log_odds(score: Column) -> Column:
    p = F.least(F.greatest(score, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def calibrate(df: DataFrame, score: str = "score", actual: str = "actual", least_rows: int = 100, least_class: int = 50, gain: float = 1e-3) -> tuple[float, float, float] | None:
    """Slope and intercept of Platt's scaling of the log-odds, and the weight that mixes it with the raw score: the one of a
    grid with the least Brier score. None for too few rows, or if the Brier score gains too little."""
    rows = df.select(F.col(actual).cast("double").alias("_label"), _log_odds(F.col(score)).alias("x"), F.col(score).alias("p"))
    n, ones = rows.agg(F.count("*"), F.sum("_label")).first()
    if n < least_rows or min(ones, n - ones) < least_class:
        return None
    strength, grid = next((c, g) for most, c, g in CALIBRATION_GRIDS if n < most)
    learner = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1 / (strength * n), standardization=False)
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="_features"), learner]).fit(rows)
    a, b = float(model.stages[-1].coefficients[0]), float(model.stages[-1].intercept)
    scaled = 1 / (1 + F.exp(-(a * F.col("x") + b)))
    losses = rows.agg(*(F.avg(((1 - w) * F.col("p") + w * scaled - F.col("_label")) ** 2) for w in (0.0, *grid))).first()
    best = min(range(len(grid)), key=lambda k: losses[k + 1])
    return (a, b, grid[best]) if losses[0] - losses[best + 1] >= gain else None


def apply_calibration(df: DataFrame, scaling: tuple[float, float, float] | None, score: str = "score") -> DataFrame:
    """df with its score mixed with the scaled one, or as it is."""
    if scaling is None:
        return df
    slope, intercept, weight = scaling
    return df.withColumn(score, (1 - weight) * F.col(score) + weight / (1 + F.exp(-(slope * _log_odds(F.col(score)) + intercept))))

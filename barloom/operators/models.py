"""Model steps on pyspark.ml: boosted trees with importances, Platt and isotonic calibration."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with all features, and them as a vector."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=features))


def boosted(train: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3, seed: int = 1):
    """A fitted model and (feature, importance) in descending order."""
    model = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed).fit(assembled(train.where(F.col(label).isNotNull()), features))
    ranked = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return model, ranked


def scored(model, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    out = model.transform(assembled(df, features))
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def calibrated(train: DataFrame, df: DataFrame, score: str, label: str, method: str = "isotonic", name: str = "calibrated") -> DataFrame:
    """Scores mapped to probabilities by isotonic or logistic (Platt) regression."""
    fit = train.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    if method == "isotonic":
        model = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol=name).fit(fit)
        return model.transform(df.where(F.col(score).isNotNull()))
    model = LogisticRegression(labelCol=label, featuresCol="features").fit(assembled(fit, [score]))
    return scored(model, df, [score], name)

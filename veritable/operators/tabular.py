"""Tabular classifiers on MLlib: features, class weights, calibration, time-series validation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.operators import metrics


def preprocessor(numeric: list[str], categorical: list[str]) -> list:
    """Median imputation and standardizing; most frequent-first one-hot codes with a code
    for values not seen before."""
    return [
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric]),
        VectorAssembler(inputCols=[f"{c}__i" for c in numeric], outputCol="__numeric"),
        StandardScaler(inputCol="__numeric", outputCol="__scaled", withMean=True),
        StringIndexer(inputCols=categorical, outputCols=[f"{c}__s" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}__s" for c in categorical], outputCols=[f"{c}__o" for c in categorical], handleInvalid="keep"),
        VectorAssembler(inputCols=["__scaled", *(f"{c}__o" for c in categorical)], outputCol="features"),
    ]


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """weight = rows / (2 x rows of the class); rows without a label teach nothing and are left out."""
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(label).count().collect()  # two classes
    weight, total = F.lit(1.0), sum(r["count"] for r in counts)
    for r in counts:
        weight = F.when(F.col(label) == r[label], total / (2.0 * r["count"])).otherwise(weight)
    return known.withColumn("weight", weight)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], label: str = "y", model: str = "logistic") -> PipelineModel:
    learner = LogisticRegression(labelCol=label, weightCol="weight", maxIter=50) if model == "logistic" else GBTClassifier(labelCol=label, weightCol="weight", maxIter=20, maxDepth=3, seed=7)
    return Pipeline(stages=[*preprocessor(numeric, categorical), learner]).fit(balanced_weights(df, label))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    rows = model.transform(df.withColumn("weight", F.lit(1.0)))
    return rows.select(*df.columns, vector_to_array("probability")[1].alias("prob"))


def fit_isotonic(scores: DataFrame, label: str = "y"):
    """Monotone calibration of prob, fitted on validation rows."""
    return IsotonicRegression(featuresCol="prob", labelCol=label).fit(scores.select("prob", F.col(label).cast("double").alias(label)))


def calibrate(model, scores: DataFrame) -> DataFrame:
    return model.transform(scores).withColumn("prob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def importance(model: PipelineModel) -> list[tuple[int, float]]:
    """(feature position, absolute coefficient or gain), largest first."""
    last = model.stages[-1]
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return sorted(enumerate(map(abs, values.tolist())), key=lambda x: (-x[1], x[0]))


def cross_validate(df: DataFrame, numeric: list[str], categorical: list[str], folds: int, position: str, label: str = "y") -> DataFrame:
    """Metrics of expanding-window folds: fold k trains on blocks before k, tests on block k."""
    from veritable.operators.splits import expanding_folds

    parts = []
    for k in range(1, folds + 1):
        rows = expanding_folds(df, folds, position).where(F.col("fold") == k)
        model = fit(rows.where("part = 'train'").select(*df.columns), numeric, categorical, label)
        parts.append(score(model, rows.where("part = 'test'").select(*df.columns)).select(F.lit(k).alias("fold"), F.col(label).cast("int").alias("y"), "prob"))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return metrics.all_metrics(scores, ["fold"])

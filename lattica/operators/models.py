"""Boosted trees a label, stacking out of fold, and feature selection, on pyspark.ml.

Labels and folds are fitted in a driver loop over their names, a bounded list;
each fit itself is distributed.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipeline(features: list[str], label: str, rounds: int = 50, depth: int = 6, seed: int = 7) -> Pipeline:
    """Medians of the training rows for missing values, then boosted trees."""
    filled = [f"_{c}" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_features"),
        GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed),
    ])


def fit_labels(df: DataFrame, features: list[str], labels: list[str], min_pos: int = 1, **options) -> dict:
    """A model for each label with at least `min_pos` positives and any negative; others are left out."""
    sums = df.agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in labels], F.count("*").alias("_n")).first()
    return {c: pipeline(features, c, **options).fit(df) for c in labels if min_pos <= (sums[c] or 0) < sums["_n"]}


def probabilities(models: dict, df: DataFrame, key: str) -> DataFrame:
    """(key, label, p) in long form."""
    out = None
    for label, model in models.items():
        x = model.transform(df).select(key, F.lit(label).alias("label"), vector_to_array("probability")[1].alias("p"))
        out = x if out is None else out.unionByName(x)
    return out


def out_of_fold(df: DataFrame, key: str, features: list[str], labels: list[str], folds: int = 5, **options) -> DataFrame:
    """(key, label, p): each row's probability by models that never saw it.

    Folds are dealt in turn within each combination of labels, in the order of
    a hash of the key, so every fold has its share of every combination.
    """
    from lattica.operators.relational import running

    dealt = running(df.withColumn("_combo", F.concat_ws(",", *labels)), ["_combo"], [F.xxhash64(key), F.col(key)], _n=F.lit(1))
    x = dealt.withColumn("_fold", F.col("_n") % folds).drop("_combo", "_n")
    out = None
    for k in range(folds):
        models = fit_labels(x.filter(F.col("_fold") != k), features, labels, **options)
        if models:
            p = probabilities(models, x.filter(F.col("_fold") == k), key)
            out = p if out is None else out.unionByName(p)
    return out


def select_features(models: dict, features: list[str], top: int = 50) -> list[tuple[str, float]]:
    """Features by mean importance over the labels' models, ties by name."""
    mean = {f: float(sum(m.stages[-1].featureImportances[i] for m in models.values())) / max(1, len(models)) for i, f in enumerate(features)}
    return sorted(mean.items(), key=lambda x: (-x[1], x[0]))[:top]

"""Training sets, classifiers and their registry."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED, HELD_OUT = 1729, 0.3


def holdout(df: DataFrame, row_id: str, label: str, seed: int = SEED, share: float = HELD_OUT) -> DataFrame:
    """Adds held_out: the share of each label's rows that come first in a seeded order."""
    w = Window.partitionBy(label)
    place = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), row_id), row_id))
    return df.withColumn("held_out", place <= F.floor(F.count("*").over(w) * share + 0.5))


def fit_logistic(train: DataFrame, features: str = "features", label: str = "label", c: float = 0.1, iterations: int = 200) -> PipelineModel:
    """Standardised logistic regression with balanced classes (ml's penalty is per row: regParam = 1 / (c n))."""
    n, ones = train.agg(F.count("*"), F.sum(label)).first()
    weight = F.when(F.col(label) == 1, n / (2 * max(1, ones))).otherwise(n / (2 * max(1, n - ones)))
    rows = train.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("raw"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", regParam=1 / (c * max(1, n)), maxIter=iterations, standardization=False)
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), lr]).fit(rows)


def score_logistic(model: PipelineModel, df: DataFrame, features: str = "features") -> DataFrame:
    rows = df.withColumn("raw", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def predictions(candidates: DataFrame, models: DataFrame, existing: DataFrame, trained_on: DataFrame) -> DataFrame:
    """Candidates x active models, without those predicted already or used in training (trained_on: model_id, asset_id)."""
    active = F.broadcast(models.where("status = 'active'").select("model_id", "threshold"))
    new = candidates.where("label IS NULL").crossJoin(active)
    return new.join(existing.select("asset_id", "model_id"), ["asset_id", "model_id"], "left_anti").join(trained_on.select("asset_id", "model_id"), ["asset_id", "model_id"], "left_anti")


def activated(models: DataFrame, candidate: str) -> DataFrame:
    """An accepted candidate becomes active and its slot's active model retires; a rejected one changes nothing."""
    me = F.col("model_id") == candidate
    slot = models.where(me & F.col("accepted")).select(F.col("slot").alias("__slot"))
    x = models.join(F.broadcast(slot), F.col("slot") == F.col("__slot"), "left")
    hit = F.col("__slot").isNotNull()
    return x.withColumn("status", F.when(hit & me, F.lit("active")).when(hit & (F.col("status") == "active"), F.lit("retired")).otherwise(F.col("status"))).drop("__slot")


def pooled_scores(windows: DataFrame, weights: dict) -> DataFrame:
    """windows: bag, features. Gated attention, one task per bag (a bag is one media file's windows)."""
    import pandas as pd

    from ..functions.blocks import attention_pool

    def score(df: pd.DataFrame) -> pd.DataFrame:
        return attention_pool(df, weights)

    return windows.select("bag", "features").groupBy("bag").applyInPandas(score, "bag long, windows long, score double")

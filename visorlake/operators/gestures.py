"""A class-weighted gesture classifier on landmark distances."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import StandardScaler
from pyspark.sql import DataFrame, functions as F

from visorlake.functions.vectors import pairwise_distance_features
from visorlake.operators.metrics import binary_metrics
from visorlake.operators.sampling import cap_per_group
from visorlake.operators.stats import class_weights
from visorlake.scale import hash_slice

# The gestures that count as positive.
POSITIVE = ("thumb_index", "thumb_index2")


def gesture_rows(df: DataFrame, pos_cap: int = 0, neg_per_gesture: int = 0, gesture="gesture", id="sample_id",
                 points="points", positive: tuple[str, ...] = POSITIVE) -> DataFrame:
    """Features and labels. `pos_cap` and `neg_per_gesture` bound the rows per gesture that fit a classifier; 0 keeps all."""
    is_pos = F.col(gesture).isin(*positive)
    ranked = df.withColumn("_h", F.xxhash64(id))
    parts = [cap_per_group(ranked.where(c), [gesture], ["_h", id], n, hash_slice(F.col("_h")))
             for c, n in ((is_pos, pos_cap), (~is_pos, neg_per_gesture))]
    rows = parts[0].unionByName(parts[1]).drop("_h")
    return rows.select(id, gesture, F.col(gesture).isin(*positive).cast("int").alias("label"),
                       array_to_vector(pairwise_distance_features(points)).alias("features"))


def train_gesture_classifier(rows: DataFrame, max_iter: int = 50, reg: float = 1e-4) -> PipelineModel:
    """Logistic regression with the positives weighted by negatives over positives."""
    weight = class_weights(rows).first()["pos_weight"]
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
              LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=max_iter, regParam=reg)]
    return Pipeline(stages=stages).fit(weighted)


def score_gestures(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(*[c for c in rows.columns if c != "features"], F.col("prediction").cast("int").alias("pred"))


def evaluate_gestures(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return binary_metrics(score_gestures(model, rows), "label", "pred")

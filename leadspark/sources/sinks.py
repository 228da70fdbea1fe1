"""Result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_document(leaderboard: DataFrame, cv: DataFrame) -> DataFrame:
    """One nested row: the models in training order, CV mean and deviation.

    The array holds one element per candidate model, a fixed handful.
    """
    measures = ["model", "accuracy", "precision", "recall", "f1", "auc_roc"]
    entries = F.array_sort(F.collect_list(F.struct("position", *measures)))
    models = leaderboard.agg(F.transform(entries, lambda m: F.struct(*[m[c].alias(c) for c in measures])).alias("models"))
    return cv.withColumn("models", models.scalar()).select("models", "cv_f1_mean", "cv_f1_std")


def save_metrics(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").json(path)

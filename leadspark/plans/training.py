"""Train from two CSV files: features, candidates, selection, cross-validation, reports, artifact.

    spark-submit leadspark/plans/training.py --leads L.csv --interactions I.csv --out OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from leadspark.operators import metrics, models
from leadspark.operators.features import lead_features
from leadspark.session import build_session, stage
from leadspark.sources import csv, sinks


def run_training(
    spark: SparkSession, leads: DataFrame, interactions: DataFrame, out: str, settings: dict[str, dict] | None = None
) -> models.Training:
    """Write model, metrics, importance, confusion matrix and ROC points of the best model under ``out``."""
    settings = settings or {}
    trained = models.train_models(lead_features(leads, interactions), settings)
    models.save_model(trained.best, f"{out}/model")
    cv = models.cv_summary(models.cv_f1(trained.best.name, trained.rows, settings.get(trained.best.name)))
    sinks.save_metrics(sinks.metrics_document(trained.leaderboard, cv), f"{out}/metrics")
    models.feature_importance(spark, trained.best.model).write.mode("overwrite").parquet(f"{out}/feature_importance")
    scored = stage(models.score(trained.best.model, trained.test), "best-scored")
    metrics.confusion_matrix(scored).write.mode("overwrite").parquet(f"{out}/confusion_matrix")
    metrics.roc_curve(scored).write.mode("overwrite").parquet(f"{out}/roc_curve")
    return trained


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("leads", "interactions", "out"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    spark = build_session("leadspark-training")
    leads, interactions = csv.load_data(spark, args.leads, args.interactions)
    run_training(spark, leads, interactions, args.out).leaderboard.show(truncate=False)


if __name__ == "__main__":
    main()

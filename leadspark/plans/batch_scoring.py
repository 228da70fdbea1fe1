"""Score and explain a table of feature rows with a saved model; what cannot be scored is set aside.

    spark-submit leadspark/plans/batch_scoring.py --model OUT/model --requests R.parquet --out SCORES
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.operators import explain, models, scoring
from leadspark.session import build_session


def contributions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Tree or linear contributions, by the kind of model."""
    linear = not hasattr(model.stages[-1], "featureImportances")
    return explain.logistic_contributions(model, rows) if linear else explain.tree_contributions(model, rows)


def explain_rows(model: PipelineModel, rows: DataFrame, keys: tuple[str, ...] = ("lead_id",)) -> DataFrame:
    """Probability, decision, summary and top factors of every row."""
    out = explain.explained(contributions(model, models.score(model, rows)))
    p = F.col("probability_1")
    return out.select(*keys, F.round(p, 4).alias("conversion_probability"), scoring.decision(p).alias("prediction"), "summary", "top_factors", "space")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("model", "requests", "out"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    spark = build_session("leadspark-scoring")
    candidate, info = models.load_model(args.model)
    requests = spark.read.parquet(args.requests)
    scoring.rejected_requests(requests, info["source_values"]).write.mode("overwrite").parquet(f"{args.out}/rejected")
    rows = scoring.accepted_requests(requests, info["source_values"])
    scoring.batch_score(candidate.model, rows).write.mode("overwrite").parquet(f"{args.out}/scores")
    explain_rows(candidate.model, rows).write.mode("overwrite").parquet(f"{args.out}/explanations")


if __name__ == "__main__":
    main()

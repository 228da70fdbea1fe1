"""Classifier quality from scored rows; every measure is one aggregation over counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.ordered import running_totals
from leadspark.functions.scalars import rate
from leadspark.session import stage


def classification_metrics(scored: DataFrame, by: Sequence[str] = (), digits: int = 4, label: str = "converted") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 from ``prediction``; 0 where undefined."""
    y, p = F.col(label) == 1, F.col("prediction") == 1
    cells = scored.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        *by,
        F.round(rate(tp + tn, tp + tn + fp + fn), digits).alias("accuracy"),
        F.round(rate(tp, tp + fp), digits).alias("precision"),
        F.round(rate(tp, tp + fn), digits).alias("recall"),
        F.round(rate(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
    )


def _score_counts(scored: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score, highest score first, with running totals."""
    counts = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return running_totals(stage(counts, "score-counts"), "score", ["pos", "neg"], by, descending=True)


def auc_roc(scored: DataFrame, by: Sequence[str] = (), digits: int = 4, score: str = "probability_1", label: str = "converted") -> DataFrame:
    """Probability that a positive outscores a negative, ties counting half; null without both classes."""
    ranked = _score_counts(scored, list(by), score, label)
    wins = F.sum(F.col("pos").cast("double") * ((F.col("all_neg") - F.col("cum_neg")) + F.col("neg") / 2))
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return ranked.groupBy(*by).agg(F.round(F.try_divide(wins, pairs), digits).alias("auc_roc"))


def roc_curve(scored: DataFrame, digits: int = 6, score: str = "probability_1", label: str = "converted") -> DataFrame:
    """One point per distinct score and the origin, whose threshold is null."""
    points = _score_counts(scored, [], score, label).select(
        F.col("score").alias("threshold"),
        F.round(F.try_divide(F.col("cum_neg").cast("double"), F.col("all_neg").cast("double")), digits).alias("fpr"),
        F.round(F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos").cast("double")), digits).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def confusion_matrix(scored: DataFrame, label: str = "converted") -> DataFrame:
    """Counts of the four (actual, predicted) cells, absent ones as 0."""
    cells = scored.sparkSession.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    counts = scored.groupBy(F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def select_best(leaderboard: DataFrame) -> DataFrame:
    """The model of highest F1; of equals the one trained first (lowest ``position``)."""
    best = F.max_by(F.struct("model", "f1"), F.struct(F.col("f1"), -F.col("position")))
    return leaderboard.agg(best.alias("b")).select("b.model", "b.f1")

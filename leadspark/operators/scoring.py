"""Batch scoring: validate feature rows, score them, band the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.constants import (
    ACCEPT_FROM, BAD_NUMBER_TEXT, BAD_SOURCE_TEXT, CONFIDENCE_HIGH_FROM, CONFIDENCE_MEDIUM_FROM, FEATURES, RISK_LOW_FROM, RISK_MEDIUM_FROM,
)
from leadspark.operators.models import score

WHOLE_NUMBERS = ["session_count", "total_events", "pricing_page_views", "webinar_registrations", "max_funnel_order", "total_clicks"]
NUMBERS = ["total_time_seconds", "engagement_span_days", "days_since_last_visit", "avg_session_gap_days"]


def decision(p: Column) -> Column:
    return F.when(p >= ACCEPT_FROM, "ACCEPT").otherwise("REJECT")


def band(scored: DataFrame, probability: str = "probability_1") -> DataFrame:
    """Add decision, rounded probability, confidence and risk; bands follow the unrounded score."""
    p = F.col(probability)
    certainty = F.greatest(p, 1 - p)
    return scored.withColumns({
        "prediction": decision(p),
        "conversion_probability": F.round(p, 4),
        "confidence": F.when(certainty >= CONFIDENCE_HIGH_FROM, "high").when(certainty >= CONFIDENCE_MEDIUM_FROM, "medium").otherwise("low"),
        "risk_level": F.when(p >= RISK_LOW_FROM, "low").when(p >= RISK_MEDIUM_FROM, "medium").otherwise("high"),
    })


BANDS = ["prediction", "conversion_probability", "confidence", "risk_level"]


def batch_score(model: PipelineModel, rows: DataFrame, keys: Sequence[str] = ("lead_id",)) -> DataFrame:
    """Keys and bands of every row; works on batch and streaming rows alike."""
    return band(score(model, rows).drop("prediction")).select(*keys, *BANDS)


def check_requests(requests: DataFrame, allowed_sources: Sequence[str]) -> DataFrame:
    """Add ``reason``: why a request cannot be scored, null when it can.

    The allowed sources are the labels of the model's encoder, a short closed list.
    """
    known = F.coalesce(F.col("source").isin(list(allowed_sources)), F.lit(False))
    listed = "[" + ", ".join(f"'{s}'" for s in allowed_sources) + "]"
    checks = []
    for c in [f for f in FEATURES if f != "source"]:
        number = F.col(c).cast("string").try_cast("double")
        bad = number.isNull() | F.isnan(number) | (F.abs(number) >= 2.0**63)  # infinite ones too
        if c in WHOLE_NUMBERS:
            bad = bad | (number != F.floor(number))
        checks.append(F.when(bad, F.lit(BAD_NUMBER_TEXT.format(c))))
    unknown = F.when(~known, F.lit(BAD_SOURCE_TEXT.format(listed)))
    return requests.withColumn("reason", F.coalesce(*checks, unknown))


def rejected_requests(requests: DataFrame, allowed_sources: Sequence[str]) -> DataFrame:
    """The quarantine: requests with a reason."""
    return check_requests(requests, allowed_sources).where("reason IS NOT NULL")


def accepted_requests(requests: DataFrame, allowed_sources: Sequence[str]) -> DataFrame:
    """The valid requests, numbers in their proper types."""
    good = check_requests(requests, allowed_sources).where("reason IS NULL").drop("reason")
    typed = {c: F.col(c).cast("string").cast("double").cast("bigint") for c in WHOLE_NUMBERS} | {c: F.col(c).cast("double") for c in NUMBERS}
    return good.withColumns(typed)

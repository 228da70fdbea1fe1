"""The conversion label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.scalars import is_form_completion, is_high_intent
from leadspark.operators.cleaning import dedup_first


def is_conversion() -> Column:
    """An interaction that converts its lead."""
    return is_high_intent() | is_form_completion()


def high_intent_events(interactions: DataFrame) -> DataFrame:
    return interactions.where(is_high_intent())


def form_completions(interactions: DataFrame) -> DataFrame:
    return interactions.where(is_form_completion())


def converted_ids(interactions: DataFrame) -> DataFrame:
    """Distinct ids of converted leads. The union of both id sets is one filter, read in one pass."""
    return interactions.where(is_conversion() & F.col("lead_id").isNotNull()).select("lead_id").distinct()


def label_leads(unique_leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """Add ``converted`` (0/1) to leads that are already unique; a missing id never matches."""
    hits = converted_ids(interactions).withColumn("_hit", F.lit(1))
    return unique_leads.join(hits, "lead_id", "left").withColumn("converted", F.coalesce("_hit", F.lit(0))).drop("_hit")


def lead_labels(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """First row per lead, with its label."""
    return label_leads(dedup_first(leads), interactions)

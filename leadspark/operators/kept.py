"""Features kept up to date: partial aggregates per lead, session and date are stored, new interactions add to them.

An increment is reduced to its partials and written under its own name, so that writing it again replaces it. Features
come from the partials of all increments, which are merged on the way; the interactions are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadspark.operators import features
from leadspark.session import stage


def add_increment(store: str, name: str, interactions: DataFrame) -> None:
    """Reduce new interactions and keep them as increment ``name``."""
    features.partials(interactions).write.mode("overwrite").parquet(f"{store}/increment={name}")


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Merge all increments of a store into one increment of another, one row per lead, session and date."""
    features.merged(spark.read.parquet(store)).write.mode("overwrite").parquet(f"{target}/increment=merged")


def kept_features(spark: SparkSession, leads: DataFrame, store: str, fill_recency: float | None = 0.0) -> DataFrame:
    """``lead_features`` of all interactions that were added."""
    activity = stage(features.activity_of(spark.read.parquet(store)), "activity")
    return features.lead_features(leads, None, fill_recency=fill_recency, activity=activity)

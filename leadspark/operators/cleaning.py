"""Deduplicate, impute, normalise and project lead tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.constants import EXPLORE_CATEGORICALS, FEATURES, MEDIAN_COLUMNS, MODEL_EXCLUDED, TRAIN_CATEGORICALS, UNKNOWN
from leadspark.functions.ordered import exact_quantiles
from leadspark.functions.scalars import present
from leadspark.functions.stats import melt


def dedup_first(leads: DataFrame, key: str = "lead_id", order: str = "ingest_seq") -> DataFrame:
    """The first row of every key. Spark keeps one row per key and task before it shuffles."""
    first = W.partitionBy(key).orderBy(order)
    return leads.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def fill_unknown(leads: DataFrame, columns: Sequence[str] = TRAIN_CATEGORICALS) -> DataFrame:
    """Missing categories become "Unknown"; columns the table lacks are skipped."""
    return leads.fillna(UNKNOWN, subset=present(leads, columns))


def fit_medians(leads: DataFrame, columns: Sequence[str] = MEDIAN_COLUMNS) -> dict[str, float]:
    """Exact median per column, one number each; columns with no value at all are left out."""
    names = present(leads, columns)
    rows = exact_quantiles(melt(leads, [], names), "value", [0.5], by=["feature"]).collect()
    return {r["feature"]: r["quantiles"][0] for r in rows}


def impute_medians(leads: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Fill missing numbers with the medians given, or with the table's own."""
    medians = fit_medians(leads) if medians is None else medians
    return leads.fillna(medians) if medians else leads


def training_leads(leads: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Dedup, then fill: the medians are those of the deduplicated table."""
    unique = dedup_first(leads)
    filled = impute_medians(fill_unknown(unique), medians)
    return filled.withColumn("log_employee_count", F.log1p("employee_count"))


def exploration_imputed(leads: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Fill only: the medians are those of the table with its repeated rows."""
    return impute_medians(fill_unknown(leads, EXPLORE_CATEGORICALS), medians)


def exploration_leads(leads: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Fill, then dedup."""
    return dedup_first(exploration_imputed(leads, medians))


def drop_model_excluded(features: DataFrame) -> DataFrame:
    return features.drop(*MODEL_EXCLUDED)


def numeric_projection(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop text and time columns, turn booleans into 0/1, fill what is left missing with 0."""
    columns = []
    for field in features.schema.fields:
        if field.name in keep:
            columns.append(F.col(field.name))
        elif isinstance(field.dataType, T.BooleanType):
            columns.append(F.coalesce(F.col(field.name).cast("int"), F.lit(0)).alias(field.name))
        elif isinstance(field.dataType, T.NumericType):
            columns.append(F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType)).alias(field.name))
    return features.select(*columns)


def model_features(features: DataFrame, keep: Sequence[str] = ("lead_id", "converted")) -> DataFrame:
    """The model's columns in their fixed order, after the columns to carry along."""
    return features.select(*keep, *FEATURES)

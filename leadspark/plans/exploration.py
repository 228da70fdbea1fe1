"""The exploratory report: every quality and exploration table, each written under its name.

    spark-submit leadspark/plans/exploration.py --leads L.csv --interactions I.csv --out OUT
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.stats import box_stats
from leadspark.operators import cleaning, explore, quality
from leadspark.session import build_session, stage
from leadspark.sources import csv


def report(leads: DataFrame, interactions: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Tables by name, built when called; the raw leads are needed for duplicates and missing values."""
    medians = cleaning.fit_medians(leads)
    clean = stage(cleaning.exploration_leads(leads, medians), "clean-leads")
    profile = {c: (lambda c=c: explore.conversion_by(clean, interactions, c)) for c in ("source", "lead_segment", "industry", "job_role", "funding_stage") if c in clean.columns}
    return {
        "table_shape": lambda: quality.table_shape({"leads": leads, "interactions": interactions}),
        "schema_listing": lambda: quality.schema_listing({"leads": leads, "interactions": interactions}),
        "null_counts_leads": lambda: quality.null_counts(leads),
        "null_counts_interactions": lambda: quality.null_counts(interactions),
        "missing_cells": lambda: quality.missing_cells(leads),
        "null_counts_after_impute": lambda: quality.null_counts(cleaning.exploration_imputed(leads, medians)),
        "duplicate_summary": lambda: quality.duplicate_summary(leads),
        "duplicate_rows": lambda: quality.duplicate_rows(leads),
        "employee_count_describe": lambda: quality.describe_column(clean, "employee_count"),
        "employee_count_box": lambda: box_stats(clean, "employee_count"),
        "employee_count_box_log": lambda: box_stats(clean.withColumn("log_count", F.log1p("employee_count")), "log_count"),
        "interaction_time_range": lambda: quality.time_range(interactions),
        "interactions_before_creation": lambda: quality.before_creation(clean, interactions),
        "conversion_summary": lambda: explore.conversion_summary(clean, interactions),
        "class_counts": lambda: explore.class_counts(clean, interactions),
        "source_volume": lambda: explore.volume_by(clean, "source"),
        **{f"conversion_by_{c}": build for c, build in profile.items()},
        "segment_gap": lambda: explore.segment_gap(clean, interactions),
        "funnel_conversion": lambda: explore.funnel_conversion(clean, interactions),
        "session_means": lambda: explore.session_means(clean, interactions),
        "session_box": lambda: explore.session_box(clean, interactions),
        "pricing_means": lambda: explore.pricing_means(clean, interactions),
        "monthly_patterns": lambda: explore.monthly_patterns(interactions),
        "interaction_class_counts": lambda: explore.interaction_class_counts(interactions),
        "weekday_events": lambda: explore.weekday_events(interactions),
        "weekday_high_intent": lambda: explore.weekday_high_intent(interactions),
        "time_to_convert_summary": lambda: explore.time_to_convert_summary(interactions),
        "time_to_convert_histogram": lambda: explore.time_to_convert_histogram(interactions),
        "temporal_correlations": lambda: explore.temporal_correlations(interactions),
        "temporal_class_means": lambda: explore.temporal_class_means(interactions),
        "temporal_histogram": lambda: explore.temporal_histogram(interactions),
        "temporal_density": lambda: explore.temporal_density(interactions),
        "correlation_matrix": lambda: explore.correlation_matrix(clean, interactions),
        "quartile_conversion": lambda: explore.quartile_conversion(interactions),
        "time_of_day_correlation": lambda: explore.time_of_day_correlation(interactions),
        "third_pricing_view": lambda: explore.third_pricing_view(interactions),
    }


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("leads", "interactions", "out"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    spark = build_session("leadspark-exploration")
    leads, interactions = csv.load_data(spark, args.leads, args.interactions)
    # CSV is parsed once; the tables below read columns of the staged copy
    leads, interactions = stage(leads, "leads"), stage(interactions, "interactions")
    for name, build in report(leads, interactions).items():
        build().write.mode("overwrite").parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()

"""Exploratory aggregates over leads, labels and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.constants import MONTH_NAMES, WEEKDAYS
from leadspark.functions.ordered import exact_quantiles
from leadspark.functions.scalars import elapsed_days, is_high_intent, lookup
from leadspark.functions.stats import box_stats, correlations, histogram, kernel_density, melt
from leadspark.operators.cleaning import dedup_first
from leadspark.operators.features import TEMPORAL, add_temporal, lead_activity, lead_measures, staged_activity
from leadspark.operators.labels import is_conversion, lead_labels
from leadspark.session import stage

CORRELATED = [
    "session_count", "pricing_page_views", *TEMPORAL, "employee_count", "company_age_years", "converted",
]


# --- lead profile -------------------------------------------------------------------------------

def conversion_summary(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    return lead_labels(leads, interactions).agg(
        F.coalesce(F.sum("converted"), F.lit(0)).cast("bigint").alias("n_converted"),
        F.count("*").alias("n_leads"),
        F.round(F.avg("converted") * 100, 4).alias("rate_pct"),
        F.count_if(F.col("converted") == 0).alias("n_not_converted"),
    )


def class_counts(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    return lead_labels(leads, interactions).groupBy("converted").agg(F.count("*").alias("n_leads"))


def volume_by(leads: DataFrame, column: str) -> DataFrame:
    """Unique leads per value, most first; leads without a value are left out."""
    known = dedup_first(leads).where(F.col(column).isNotNull())
    return known.groupBy(column).agg(F.count("*").alias("n_leads")).orderBy(F.desc("n_leads"), column)


def conversion_by(leads: DataFrame, interactions: DataFrame, column: str) -> DataFrame:
    """Conversion rate per value, highest first."""
    known = lead_labels(leads, interactions).where(F.col(column).isNotNull())
    rates = known.groupBy(column).agg(F.round(F.avg("converted"), 3).alias("conversion_rate"))
    return rates.orderBy(F.desc("conversion_rate"), column)


def segment_gap(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """Conversion rates of named groups side by side, 0 for a group that does not occur."""
    def rate_of(column: str, value: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(F.col(column) == value, F.col("converted"))), F.lit(0.0)), 3)

    return lead_labels(leads, interactions).agg(
        rate_of("lead_segment", "Enterprise").alias("enterprise_rate"),
        rate_of("lead_segment", "SMB").alias("smb_rate"),
        rate_of("job_role", "Analyst").alias("analyst_rate"),
        rate_of("job_role", "Intern").alias("intern_rate"),
    )


# --- behaviour ----------------------------------------------------------------------------------

def lead_outcomes(unique_leads: DataFrame, activity: DataFrame) -> DataFrame:
    """Unique leads with their activity (null without interactions) and ``converted`` (0/1).

    The label comes from the same aggregation as the measures, not from a further pass.
    """
    joined = unique_leads.join(activity, "lead_id", "left")
    return joined.withColumn("converted", F.coalesce("is_converted", F.lit(0)))


def funnel_conversion(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """Conversion rate by deepest known stage; leads without a known stage are left out."""
    staged = lead_outcomes(dedup_first(leads), lead_measures(interactions)).where("deepest_known_stage IS NOT NULL")
    return staged.groupBy(F.col("deepest_known_stage").alias("funnel_order")).agg(
        F.count("*").alias("n_leads"), F.round(F.avg("converted"), 4).alias("conversion_rate")
    )


def sessions_per_lead(interactions: DataFrame) -> DataFrame:
    return lead_activity(interactions).where("lead_id IS NOT NULL").select("lead_id", "session_count")


def session_means(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """Mean sessions by class over the leads that have any interaction."""
    outcomes = lead_outcomes(dedup_first(leads), lead_activity(interactions))
    return outcomes.groupBy("converted").agg(F.round(F.avg("session_count"), 4).alias("mean_sessions"))


def session_box(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    outcomes = lead_outcomes(dedup_first(leads), lead_activity(interactions)).select("converted", "session_count")
    return box_stats(stage(outcomes, "session-outcomes"), "session_count", "converted")


def pricing_views_per_lead(interactions: DataFrame) -> DataFrame:
    """Pricing page views of the leads that have any."""
    views = interactions.where("page_name = 'Pricing' AND lead_id IS NOT NULL")
    return views.groupBy("lead_id").agg(F.count("*").alias("pricing_page_views"))


def pricing_means(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """Mean pricing page views by class, leads without any counted as 0."""
    outcomes = lead_outcomes(dedup_first(leads), lead_measures(interactions))
    return outcomes.groupBy("converted").agg(
        F.round(F.avg(F.coalesce("pricing_page_views", F.lit(0))), 4).alias("mean_pricing_views")
    )


def third_pricing_view(interactions: DataFrame, nth: int = 3) -> DataFrame:
    """The moment of each lead's ``nth`` pricing view; tasks keep ``nth`` rows per lead before the shuffle."""
    views = interactions.where("page_name = 'Pricing' AND lead_id IS NOT NULL AND ts IS NOT NULL")
    order = W.partitionBy("lead_id").orderBy("ts", "interaction_id")
    ranked = views.select("lead_id", "ts", "interaction_id", F.row_number().over(order).alias("_rn"))
    return ranked.where(F.col("_rn") == nth).select("lead_id", "interaction_id", F.col("ts").alias("alert_at"))


# --- calendar -----------------------------------------------------------------------------------

def monthly_patterns(interactions: DataFrame) -> DataFrame:
    """Events, events by converted leads, unique leads and event-weighted rate per month number.

    Interactions shrink to one row per lead and month first. The label is then the maximum over a
    lead's few months, so neither a join nor a distinct count touches the raw rows.
    """
    per_lead = interactions.groupBy("lead_id", F.month("ts").alias("month")).agg(
        F.count("interaction_id").alias("events"), F.count("*").alias("rows"), F.max(is_conversion()).alias("hit")
    )
    converted = F.max("hit").over(W.partitionBy("lead_id")) & F.col("lead_id").isNotNull()
    months = per_lead.withColumn("converted", converted).where("month IS NOT NULL").groupBy("month").agg(
        F.sum("events").alias("total_events"),
        F.sum(F.when(F.col("converted"), F.col("rows")).otherwise(0)).alias("conv_events"),
        F.count("lead_id").alias("unique_leads"),
    )
    named = months.withColumn("month_name", lookup(MONTH_NAMES, "month"))
    return named.select(
        "month", "month_name", "total_events", "conv_events", "unique_leads",
        F.round(F.try_divide(F.col("conv_events") * 100.0, F.col("total_events").cast("double")), 4).alias("conv_rate"),
    )


def interaction_class_counts(interactions: DataFrame) -> DataFrame:
    """Interactions of converted leads and of the others; those without a lead count as not converted."""
    per_lead = interactions.groupBy("lead_id").agg(F.count("*").alias("rows"), F.max(is_conversion()).alias("hit"))
    converted = (F.coalesce("hit", F.lit(False)) & F.col("lead_id").isNotNull()).cast("int")
    return per_lead.groupBy(converted.alias("converted")).agg(F.sum("rows").alias("n_interactions"))


def _weekdays(events: DataFrame, counted: Column) -> DataFrame:
    """Counts on the seven weekdays, Monday first; null for a day without events."""
    days = events.sparkSession.createDataFrame(list(enumerate(WEEKDAYS, 1)), "dow_no int, day_of_week string")
    counts = events.where("ts IS NOT NULL").groupBy((F.weekday("ts") + 1).alias("dow_no")).agg(counted.alias("n_events"))
    return days.join(counts, "dow_no", "left")


def weekday_events(interactions: DataFrame) -> DataFrame:
    return _weekdays(interactions, F.count("interaction_id")).orderBy("dow_no")


def weekday_high_intent(interactions: DataFrame) -> DataFrame:
    """High-intent events by weekday, busiest first."""
    return _weekdays(interactions.where(is_high_intent()), F.count("*")).orderBy(F.desc_nulls_last("n_events"), "dow_no")


# --- time to convert ----------------------------------------------------------------------------

def time_to_convert(interactions: DataFrame) -> DataFrame:
    """Days from first visit to first high-intent event, for leads that have both."""
    both = lead_measures(interactions).where("first_visit IS NOT NULL AND first_intent IS NOT NULL")
    return both.select("lead_id", elapsed_days("first_visit", "first_intent").alias("days_to_convert"))


def time_to_convert_summary(interactions: DataFrame) -> DataFrame:
    days = stage(time_to_convert(interactions), "days-to-convert")
    median = exact_quantiles(days, "days_to_convert", [0.5]).select(F.col("quantiles")[0]).scalar()
    d = F.col("days_to_convert")
    return days.agg(
        F.count("*").alias("n_leads"),
        F.round(F.avg(d), 4).alias("mean_days"),
        F.count_if(d < 1).alias("under_1_day"),
        F.count_if(d < 7).alias("under_7_days"),
        F.count_if(d > 30).alias("over_30_days"),
    ).withColumn("median_days", F.round(median, 4))


def time_to_convert_histogram(interactions: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(time_to_convert(interactions).withColumnRenamed("days_to_convert", "value"), [], [], bins)


# --- temporal features --------------------------------------------------------------------------

def temporal_frame(interactions: DataFrame) -> DataFrame:
    """Every lead with interactions: the three temporal features, unfilled, and its label."""
    activity = staged_activity(interactions)
    frame = add_temporal(activity, activity)
    return frame.select("lead_id", *TEMPORAL, F.col("is_converted").alias("converted"))


def temporal_correlations(interactions: DataFrame) -> DataFrame:
    rows = correlations(temporal_frame(interactions), [(c, "converted") for c in TEMPORAL])
    return rows.select(F.col("feature_a").alias("feature"), "correlation")


def temporal_class_means(interactions: DataFrame) -> DataFrame:
    """One row per feature, one column per class."""
    def mean_of(feature: str, label: int) -> Column:
        return F.round(F.avg(F.when(F.col("converted") == label, F.col(feature))), 1)

    cells = [
        F.struct(F.lit(c).alias("feature"), mean_of(c, 0).alias("not_converted"), mean_of(c, 1).alias("converted")) for c in TEMPORAL
    ]
    return temporal_frame(interactions).agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def temporal_histogram(interactions: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(melt(temporal_frame(interactions), ["converted"], TEMPORAL), ["feature"], ["converted"], bins)


def temporal_density(interactions: DataFrame, points: int = 200) -> DataFrame:
    return kernel_density(melt(temporal_frame(interactions), ["converted"], TEMPORAL), "feature", "converted", points)


def correlation_matrix(clean_leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """All pairs of the numeric features and the label, pairwise complete, in long form."""
    activity = staged_activity(interactions)
    frame = add_temporal(lead_outcomes(clean_leads, activity), activity)
    frame = frame.withColumn("pricing_page_views", F.coalesce("pricing_page_views", F.lit(0)))
    names = [c for c in CORRELATED if c in frame.columns]
    return correlations(frame, [(a, b) for i, a in enumerate(names) for b in names[i:]], mirrored=True)


def quartile_conversion(interactions: DataFrame, features: tuple[str, ...] = ("days_since_last_visit", "avg_session_gap_days")) -> DataFrame:
    """Conversion rate per quartile of a feature; values equal to an edge fall below it."""
    values = stage(melt(temporal_frame(interactions), ["converted"], list(features)).where("value IS NOT NULL"), "quartile-values")
    edges = exact_quantiles(values, "value", [0.25, 0.5, 0.75], ["feature"])
    quartile = sum(((F.col("value") > F.col("quantiles")[i]).cast("int") for i in range(3)), F.lit(1))
    return values.join(F.broadcast(edges), "feature").groupBy("feature", quartile.alias("quartile")).agg(
        F.count("*").alias("n_leads"), F.round(F.avg("converted"), 4).alias("conversion_rate")
    )


def time_of_day_correlation(interactions: DataFrame) -> DataFrame:
    """Shares of a lead's events in business hours, on weekends and at night, against its label."""
    hour, day = F.hour("ts"), F.weekday("ts")
    share = {
        "business_hours_share": (day < 5) & (hour >= 9) & (hour < 18),
        "weekend_share": day >= 5,
        "night_share": (hour >= 22) | (hour < 6),
    }
    per_lead = interactions.where("lead_id IS NOT NULL").groupBy("lead_id").agg(
        *[F.avg(when.cast("double")).alias(name) for name, when in share.items()], F.max(is_conversion().cast("int")).alias("converted")
    )
    rows = correlations(per_lead, [(name, "converted") for name in share])
    return rows.select(F.col("feature_a").alias("feature"), "correlation")

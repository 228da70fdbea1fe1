"""Per-lead features: one pass over the interactions, aggregated twice, and one join to the leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.constants import EVENT_COUNTS, PAGE_COUNTS
from leadspark.functions.scalars import elapsed_days, flag_to_int, floor_zero, funnel_order, is_high_intent, safe_ratio
from leadspark.operators.cleaning import training_leads
from leadspark.operators.labels import is_conversion
from leadspark.session import stage


def _zero_if_none(c: Column, zero: float | int) -> Column:
    return F.coalesce(c, F.lit(zero))


def _measures() -> dict[str, tuple[str, Column]]:
    """Per measure how it is combined and of what; all combine before a shuffle, hot leads included."""
    depth = funnel_order("funnel_stage", unknown=1)
    return {
        "total_events": ("count", F.col("interaction_id")),
        "total_time_seconds": ("sum0", F.col("time_on_page_seconds")),
        "avg_time_per_page": ("avg", F.col("time_on_page_seconds")),
        "avg_scroll_depth": ("avg", F.col("scroll_depth_percent")),
        "max_scroll_depth": ("max", F.col("scroll_depth_percent")),
        **{name: ("count", F.when(F.col("page_name") == page, 1)) for name, page in PAGE_COUNTS.items()},
        **{name: ("count", F.when(F.col("event_name") == event, 1)) for name, event in EVENT_COUNTS.items()},
        "max_funnel_order": ("max", depth),
        # distinct stages as a bit mask: no further distinct aggregate
        "funnel_stages_reached": ("bits", F.call_function("shiftleft", F.lit(1), depth)),
        "first_visit": ("min", F.col("ts")),
        "last_visit": ("max", F.col("ts")),
        "max_session_number": ("max", F.col("session_number")),
        "return_visitor_flag": ("max", F.col("is_return_visitor")),
        "total_clicks": ("sum0", F.col("click_count")),
        "avg_mouse_activity": ("avg", F.col("mouse_activity_score")),
        # not features: the label, and what exploration asks per lead
        "is_converted": ("max", is_conversion().cast("int")),
        "first_intent": ("min", F.when(is_high_intent(), F.col("ts"))),
        "deepest_known_stage": ("max", funnel_order("funnel_stage", unknown=None)),
    }


def _first_level() -> list[Column]:
    out = []
    for name, (kind, value) in _measures().items():
        if kind == "avg":
            out += [F.sum(value).alias(name), F.count(value).alias(f"{name}_n")]
        else:
            out.append({"count": F.count, "sum0": F.sum, "max": F.max, "min": F.min, "bits": F.bit_or}[kind](value).alias(name))
    return out


def _second_level() -> list[Column]:
    """The measures from rows of ``_first_level``."""

    def again(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "avg":
            return F.try_divide(F.sum(c).cast("double"), F.sum(f"{name}_n").cast("double"))
        if kind == "sum0":
            return _zero_if_none(F.sum(c), 0)
        return {"count": F.sum, "max": F.max, "min": F.min, "bits": lambda x: F.bit_count(F.bit_or(x))}[kind](c)

    return [again(name, kind).alias(name) for name, (kind, _) in _measures().items()]


AGGREGATES = [
    "session_count", "total_events", "total_time_seconds", "avg_time_per_page", "avg_scroll_depth", "max_scroll_depth",
    *PAGE_COUNTS, *EVENT_COUNTS, "max_funnel_order", "funnel_stages_reached", "first_visit", "last_visit",
    "max_session_number", "return_visitor_flag", "total_clicks", "avg_mouse_activity",
]
TEMPORAL = ["engagement_span_days", "days_since_last_visit", "avg_session_gap_days"]
RATIOS = ["high_intent_page_ratio", "avg_events_per_day", "events_per_session"]
LOGS = ["log_total_time_seconds", "log_total_events", "log_total_clicks"]
ENGINEERED = [c for c in AGGREGATES if c not in ("first_visit", "last_visit")] + TEMPORAL + RATIOS + LOGS


def lead_measures(interactions: DataFrame) -> DataFrame:
    """One row per known lead, all but the distinct counts; Catalyst drops what a caller does not select."""
    known = interactions.where("lead_id IS NOT NULL")
    return known.groupBy("lead_id").agg(*_first_level()).groupBy("lead_id").agg(*_second_level())


def lead_activity(interactions: DataFrame) -> DataFrame:
    """Measures, distinct sessions and active dates per lead, from one pass; the row of a null lead comes too.

    Interactions shrink to one row per lead, session and date first. That short table gives the measures and
    both distinct counts, for which Spark repeats rows; the raw interactions are neither repeated nor read again.
    """
    return activity_of(partials(interactions))


def partials(interactions: DataFrame) -> DataFrame:
    """One row per lead, session and date, with sums, counts and extremes that add up over parts of the interactions."""
    return interactions.groupBy("lead_id", "session_id", F.to_date("ts").alias("date")).agg(*_first_level())


def merged(parts: DataFrame) -> DataFrame:
    """Partials of several parts of the interactions as those of all of them."""
    def again(name: str, kind: str) -> list[Column]:
        if kind == "avg":
            return [F.sum(name).alias(name), F.sum(f"{name}_n").alias(f"{name}_n")]
        return [{"count": F.sum, "sum0": F.sum, "max": F.max, "min": F.min, "bits": F.bit_or}[kind](name).alias(name)]

    return parts.groupBy("lead_id", "session_id", "date").agg(*[c for name, (kind, _) in _measures().items() for c in again(name, kind)])


def activity_of(parts: DataFrame) -> DataFrame:
    """The activity per lead from partials, of whatever parts of the interactions."""
    return parts.groupBy("lead_id").agg(
        *_second_level(), F.count_distinct("session_id").alias("session_count"), F.count_distinct("date").alias("active_days")
    )


def staged_activity(interactions: DataFrame) -> DataFrame:
    """``lead_activity`` written once: the latest time of all leads is read from it and not from the interactions."""
    return stage(lead_activity(interactions), "activity")


def lead_aggregates(interactions: DataFrame) -> DataFrame:
    return lead_activity(interactions).where("lead_id IS NOT NULL").select("lead_id", *AGGREGATES)


def reference_time(activity: DataFrame) -> Column:
    """Latest timestamp over all interactions, those without a lead included, as a scalar subquery."""
    return activity.agg(F.max("last_visit")).scalar()


def closed_gap(first: Column, last: Column, days: Column) -> Column:
    """Mean gap between consecutive active dates = whole range / (dates − 1); null for one date."""
    return F.when(days > 1, F.date_diff(last, first) / (days - 1))


def add_temporal(frame: DataFrame, activity: DataFrame) -> DataFrame:
    """Span, recency and gap per known lead; null where a lead has no timestamp or only one active date."""
    reference = reference_time(activity)
    return frame.where("lead_id IS NOT NULL").withColumns({
        "engagement_span_days": floor_zero(elapsed_days("first_visit", "last_visit")),
        "days_since_last_visit": floor_zero(F.timestamp_diff("MICROSECOND", F.col("last_visit"), reference) / 86_400_000_000.0),
        "avg_session_gap_days": closed_gap(F.col("first_visit"), F.col("last_visit"), F.col("active_days")),
    })


def lead_temporal(interactions: DataFrame) -> DataFrame:
    """The temporal features in their training form: span and gap zero-filled, recency not."""
    activity = staged_activity(interactions)
    temporal = add_temporal(activity, activity).select("lead_id", *TEMPORAL)
    return temporal.fillna(0.0, subset=["engagement_span_days", "avg_session_gap_days"])


def session_gaps(interactions: DataFrame) -> DataFrame:
    """Mean gap per lead by looking back one active date. A window holds one lead's distinct dates."""
    dates = interactions.where("lead_id IS NOT NULL AND ts IS NOT NULL").select("lead_id", F.to_date("ts").alias("date")).distinct()
    back = F.lag("date").over(W.partitionBy("lead_id").orderBy("date"))
    gaps = dates.withColumn("gap_days", F.date_diff("date", back))
    return gaps.groupBy("lead_id").agg(F.avg("gap_days").alias("avg_session_gap_days"))


def session_gaps_closed(interactions: DataFrame) -> DataFrame:
    """The same as :func:`session_gaps` without a window."""
    dated = lead_activity(interactions).select("lead_id", "first_visit", "last_visit", "active_days").where("active_days > 0 AND lead_id IS NOT NULL")
    return dated.select(
        "lead_id", closed_gap(F.col("first_visit"), F.col("last_visit"), F.col("active_days")).alias("avg_session_gap_days")
    )


def add_ratios(features: DataFrame) -> DataFrame:
    """Expects a zero-filled ``engagement_span_days``."""
    intent_pages = F.col("pricing_page_views") + F.col("contact_page_views") + F.col("case_study_views")
    return features.withColumns({
        "high_intent_page_ratio": safe_ratio(intent_pages, "total_events"),
        "avg_events_per_day": F.col("total_events") / (F.col("engagement_span_days") + 1),
        "events_per_session": safe_ratio("total_events", "session_count"),
    })


def add_logs(features: DataFrame) -> DataFrame:
    return features.withColumns({name: F.log1p(F.col(name.removeprefix("log_"))) for name in LOGS})


def interaction_features(interactions: DataFrame | None, activity: DataFrame | None = None) -> DataFrame:
    """All engineered features of the leads that have interactions, with ``is_converted``; ``activity`` if it is at hand."""
    activity = staged_activity(interactions) if activity is None else activity
    temporal = add_temporal(activity, activity)
    filled = temporal.fillna(0.0, subset=["engagement_span_days", "avg_session_gap_days"])
    return add_logs(add_ratios(filled)).select("lead_id", "is_converted", *ENGINEERED)


def join_activity(profile: DataFrame, active: DataFrame) -> DataFrame:
    """Every lead, with the features of :func:`interaction_features` where it has some.

    Those are read from staged files, which are small when compressed: without the hint Spark would broadcast a row per
    active lead.
    """
    return profile.join(active.hint("merge"), "lead_id", "left")


def lead_features(
    leads: DataFrame, interactions: DataFrame | None, medians: dict[str, float] | None = None, fill_recency: float | None = 0.0,
    activity: DataFrame | None = None,
) -> DataFrame:
    """The whole feature table: one row per lead, its profile, ``converted`` and 31 engineered features.

    Leads without interactions get zeros everywhere, which also makes them look recently seen; pass
    ``fill_recency=None`` to leave their recency empty instead.
    """
    profile = training_leads(leads, medians)
    joined = join_activity(profile, interaction_features(interactions, activity))
    joined = joined.withColumn("converted", _zero_if_none(F.col("is_converted"), 0)).withColumn(
        "return_visitor_flag", flag_to_int("return_visitor_flag")
    )
    zeros = [c for c in ENGINEERED if fill_recency is not None or c != "days_since_last_visit"]
    return joined.fillna(0, subset=zeros).select(*profile.columns, "converted", *ENGINEERED)

"""Cleaning, labels, features, exploration and quality on tiny tables with every kind of gap."""

import pytest
from pyspark.sql import functions as F

from leadspark.constants import FEATURES, LABEL_DEFINING
from leadspark.operators import cleaning, encode, explore, features, labels, quality
from leadspark.plans import registry
from leadspark.sources.rolemap import LeadTables

INTERACTIONS = """interaction_id string, lead_id string, session_id string, ts string, event_name string, page_name string, funnel_stage string,
    form_completed boolean, time_on_page_seconds double, scroll_depth_percent double, session_number int, is_return_visitor boolean,
    click_count bigint, mouse_activity_score double"""


def events(spark, rows):
    """Rows as dicts; what a row does not name is null."""
    names = [part.split()[0] for part in INTERACTIONS.split(",")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], INTERACTIONS)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def interactions(spark):
    return events(spark, [
        dict(interaction_id="1", lead_id="a", session_id="s1", ts="2026-01-01 00:00:00", event_name="blog_read", page_name="Pricing", funnel_stage="Awareness"),
        dict(interaction_id="2", lead_id="a", session_id="s1", ts="2026-01-01 12:00:00", event_name="demo_request", page_name="Pricing", time_on_page_seconds=5.0),
        dict(interaction_id="3", lead_id="a", session_id="s2", ts="2026-01-05 00:00:00", event_name="blog_read", page_name="Pricing", funnel_stage="Decision", click_count=2),
        dict(interaction_id="4", lead_id="b", session_id=None, ts="2026-01-02 06:00:00", event_name="blog_read", is_return_visitor=True),
        dict(interaction_id="5", lead_id=None, session_id="s9", ts="2026-02-01 00:00:00", event_name="demo_request", form_completed=True),
        dict(interaction_id="6", lead_id="d", session_id="s4", ts=None, form_completed=True),
        dict(interaction_id=None, lead_id="d", session_id="s4", ts=None, form_completed=None),
    ])


@pytest.fixture(scope="module")
def leads(spark):
    rows = [
        ("a", 1, "2026-01-01", "Google", None, 10.0, 1.0), ("a", 2, "2026-01-01", "Referral", "CXO", 1000.0, 9.0),
        ("b", 3, "2026-02-01", None, "VP", None, 3.0), ("c", 4, "2025-01-01", "Direct", "VP", 30.0, None), ("d", 5, None, "Direct", "VP", 20.0, 5.0),
        (None, 6, None, "Direct", None, None, None), (None, 7, None, "Direct", None, None, None),
    ]
    df = spark.createDataFrame(rows, "lead_id string, ingest_seq bigint, created_at string, source string, job_role string, employee_count double, company_age_years double")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def by(df, key="lead_id"):
    return {r[key]: r for r in df.collect()}


def test_first_row_of_each_lead_wins(leads):
    kept = cleaning.dedup_first(leads)
    assert sorted(r["ingest_seq"] for r in kept.collect()) == [1, 3, 4, 5, 6]


def test_dedup_prunes_hot_keys_before_the_shuffle(leads):
    assert "WindowGroupLimit" in cleaning.dedup_first(leads)._jdf.queryExecution().executedPlan().toString()


def test_medians_before_and_after_dedup(leads):
    assert cleaning.fit_medians(leads)["employee_count"] == 25.0
    assert cleaning.fit_medians(cleaning.dedup_first(leads)) == {"employee_count": 20.0, "company_age_years": 3.0}


def test_fill_skips_absent_columns(leads):
    filled = by(cleaning.fill_unknown(leads), "ingest_seq")
    assert filled[3]["source"] == "Unknown" and filled[1]["job_role"] == "Unknown"


def test_labels_never_match_a_missing_id(leads, interactions):
    got = by(labels.lead_labels(leads, interactions))
    assert {k: r["converted"] for k, r in got.items()} == {"a": 1, "b": 0, "c": 0, "d": 1, None: 0}


def test_aggregates(interactions):
    got = by(features.lead_aggregates(interactions))
    assert set(got) == {"a", "b", "d"}
    a, b, d = got["a"], got["b"], got["d"]
    assert (a["session_count"], a["total_events"], a["total_time_seconds"], a["avg_time_per_page"]) == (2, 3, 5.0, 5.0)
    assert (a["pricing_page_views"], a["blog_reads"], a["max_funnel_order"], a["funnel_stages_reached"], a["total_clicks"]) == (3, 2, 4, 2, 2)
    assert (b["session_count"], b["total_time_seconds"], b["avg_time_per_page"], b["return_visitor_flag"]) == (0, 0.0, None, True)
    assert (d["total_events"], d["first_visit"], d["max_funnel_order"]) == (1, None, 1)


def test_temporal_features(interactions):
    got = by(features.lead_temporal(interactions))
    # the latest time belongs to an event without a lead
    assert (got["a"]["engagement_span_days"], got["a"]["days_since_last_visit"], got["a"]["avg_session_gap_days"]) == (4.0, 27.0, 4.0)
    assert (got["b"]["engagement_span_days"], got["b"]["avg_session_gap_days"]) == (0.0, 0.0)
    assert (got["d"]["engagement_span_days"], got["d"]["days_since_last_visit"]) == (0.0, None)


def test_gap_forms_agree(spark):
    rows = [dict(interaction_id=str(i), lead_id=f"l{i % 5}", session_id="s", ts=f"2026-01-{1 + (i * i) % 28:02d} 01:00:00") for i in range(60)]
    df = events(spark, rows)
    window = {k: r["avg_session_gap_days"] for k, r in by(features.session_gaps(df)).items()}
    closed = {k: r["avg_session_gap_days"] for k, r in by(features.session_gaps_closed(df)).items()}
    assert window.keys() == closed.keys() and all(window[k] == pytest.approx(closed[k]) for k in window)


def test_feature_table(leads, interactions):
    table = features.lead_features(leads, interactions)
    assert len(features.ENGINEERED) == 31 and table.columns[-31:] == features.ENGINEERED
    got = by(table)
    c = got["c"]
    assert all(c[f] == 0 for f in features.ENGINEERED) and c["converted"] == 0 and c["company_age_years"] == 3.0
    assert got["b"]["return_visitor_flag"] == 1 and got["a"]["high_intent_page_ratio"] == 1.0 and got["a"]["avg_events_per_day"] == 3 / 5
    assert got["d"]["days_since_last_visit"] == 0.0
    kept = by(features.lead_features(leads, interactions, fill_recency=None))
    assert kept["c"]["days_since_last_visit"] is None and kept["a"]["days_since_last_visit"] == 27.0


def test_model_columns_do_not_leak(leads, interactions):
    assert not set(FEATURES) & set(LABEL_DEFINING)
    projected = cleaning.numeric_projection(cleaning.drop_model_excluded(features.lead_features(leads, interactions)))
    assert "source" not in projected.columns and "converted" not in projected.columns
    assert all(v is not None for r in projected.collect() for v in r)


def test_activity_is_never_broadcast(leads, interactions):
    """A row per active lead comes from files that are small when compressed, whatever the number of leads."""
    for table in (features.lead_features(leads, interactions), registry.model_table(LeadTables(leads, interactions))):
        plan = table._jdf.queryExecution().executedPlan()
        assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()
        got = by(table)
        assert {k: (r["converted"], r["total_events"]) for k, r in got.items()} == {"a": (1, 3), "b": (0, 1), "c": (0, 0), "d": (1, 1), None: (0, 0)}
        assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()  # as it ran


def test_quality(leads, interactions):
    d = quality.duplicate_summary(leads).first()
    assert (d["n_rows"], d["n_ids"], d["n_duplicates"]) == (7, 4, 2)
    assert [r["ingest_seq"] for r in quality.duplicate_rows(leads).collect()] == [6, 7, 1, 2]
    nulls = {r["column_name"]: r["n_missing"] for r in quality.null_counts(leads).collect()}
    assert nulls == {"created_at": 3, "job_role": 3, "employee_count": 3, "company_age_years": 3, "lead_id": 2, "source": 1}
    assert quality.missing_cells(leads).first()["n_cells"] == 49
    assert [r["interaction_id"] for r in quality.before_creation(leads, interactions).collect()] == ["4"]
    assert quality.time_range(interactions).first()["span_days"] == 31


def test_months_ignore_the_year_and_weigh_by_events(spark):
    rows = [
        dict(interaction_id="1", lead_id="a", ts="2025-03-01 00:00:00", event_name="demo_request"),
        dict(interaction_id="2", lead_id="a", ts="2026-03-05 00:00:00"), dict(interaction_id="3", lead_id="b", ts="2026-03-05 00:00:00"),
        dict(interaction_id="4", lead_id="a", ts="2026-09-05 00:00:00"), dict(interaction_id="5", lead_id=None, ts="2026-03-05 00:00:00", event_name="demo_request"),
        dict(interaction_id="6", lead_id="c", ts=None, form_completed=True), dict(interaction_id="7", lead_id="c", ts="2026-01-05 00:00:00"),
    ]
    df = events(spark, rows)
    got = {r["month"]: r for r in explore.monthly_patterns(df).collect()}
    assert set(got) == {1, 3, 9}
    march = got[3]
    assert (march["month_name"], march["total_events"], march["conv_events"], march["unique_leads"], march["conv_rate"]) == ("Mar", 4, 2, 2, 50.0)
    assert got[1]["conv_events"] == 1
    assert {r["month"] for r in explore.monthly_patterns(df).collect()} == {1, 3, 9}


def test_weekdays_are_dense(interactions):
    days = explore.weekday_events(interactions).collect()
    assert [r["day_of_week"] for r in days][0] == "Monday" and len(days) == 7 and days[1]["n_events"] is None


def test_time_to_convert_ignores_forms(interactions):
    got = by(explore.time_to_convert(interactions))
    assert {k: r["days_to_convert"] for k, r in got.items()} == {"a": 0.5}


def test_funnel_uses_known_stages_only(leads, interactions):
    got = explore.funnel_conversion(leads, interactions).collect()
    assert [(r["funnel_order"], r["n_leads"], r["conversion_rate"]) for r in got] == [(4, 1, 1.0)]


def test_session_and_pricing_means_differ_in_zero_fill(leads, interactions):
    sessions = {r["converted"]: r["mean_sessions"] for r in explore.session_means(leads, interactions).collect()}
    pricing = {r["converted"]: r["mean_pricing_views"] for r in explore.pricing_means(leads, interactions).collect()}
    assert sessions == {0: 0.0, 1: 1.5} and pricing == {0: 0.0, 1: 1.5}


def test_third_pricing_view(interactions):
    df = explore.third_pricing_view(interactions)
    assert [(r["lead_id"], r["interaction_id"]) for r in df.collect()] == [("a", "3")]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_split_folds_weights(spark):
    df = spark.range(505).select(F.col("id").alias("lead_id"), (F.col("id") % 4 == 0).cast("int").alias("converted"))
    split = encode.stratified_split(df)
    sizes = {(r["converted"], r["is_test"]): r["count"] for r in split.groupBy("converted", "is_test").count().collect()}
    assert sizes == {(1, True): 25, (1, False): 102, (0, True): 76, (0, False): 302}
    folds = encode.stratified_folds(df).groupBy("fold").agg(F.count("*").alias("n"), F.sum("converted").alias("y")).collect()
    assert len(folds) == 5 and all(100 <= r["n"] <= 102 and 25 <= r["y"] <= 26 for r in folds)
    weights = {r["converted"]: r["weight"] for r in encode.class_weights(df).collect()}
    assert weights == {1: pytest.approx(505 / (2 * 127)), 0: pytest.approx(505 / (2 * 378))}


def test_codes_follow_the_alphabet(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("b",)], "source string")
    assert [r["source"] for r in encode.label_encode(df).collect()] == [2, 0, 1, 2]


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in encode.standardise(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_hot_leads_can_be_split(spark):
    """With a third of the rows on one lead the final plans hold a skewed join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "256k",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        i = F.col("id")
        hot = spark.range(0, 300_000, 1, 8).select(F.when(i % 3 == 0, 7).otherwise(i).alias("lead_id"), i.alias("interaction_id"), F.timestamp_seconds(i).alias("ts"))
        leads = spark.range(0, 300_000, 1, 8).select(i.alias("lead_id"), i.alias("ingest_seq"), F.lit("2025-01-01").cast("timestamp").alias("created_at"))
        early = quality.before_creation(leads, hot)
        assert early.count() == 300_000
        early.write.format("noop").mode("overwrite").save()
        repeated = quality.duplicate_rows(hot.withColumnRenamed("interaction_id", "ingest_seq"))
        plans = []
        for df in (early, repeated):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        assert all("skew=true" in p for p in plans)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_rows_without_id_are_duplicates_of_each_other(spark):
    leads = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (6, 4), (6, 5)], "lead_id int, ingest_seq int")
    assert [r.ingest_seq for r in quality.duplicate_rows(leads).collect()] == [1, 2, 4, 5]
    assert [r.ingest_seq for r in quality.duplicate_rows(leads.where("ingest_seq > 1")).collect()] == [4, 5]


def test_features_read_the_interactions_once(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    from leadspark.operators import features as feats
    from leadspark.sources.rolemap import read_tables

    t = read_tables(spark, path)
    plan = feats.lead_activity(t.interactions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    frame = feats.lead_features(t.leads, t.interactions, medians={})
    assert "events.parquet" not in frame._jdf.queryExecution().executedPlan().toString()


def test_alerts_are_corrected_and_expire(spark, tmp_path):
    """Views in any order: an alert at once, a revision when an earlier view arrives, nothing for views behind the watermark."""
    import datetime

    from leadspark.session import fresh_path
    from leadspark.streaming import alerts
    from leadspark.streaming.scoring import read_feature_stream

    day = lambda d: datetime.datetime(2026, 1, d)
    schema = "interaction_id long, lead_id long, page_name string, ts timestamp_ntz"
    files = [
        [(1, 7, "Pricing", day(1)), (2, 7, "Pricing", day(4)), (3, 7, "Pricing", day(5)), (3, 7, "Pricing", day(5)), (9, None, "Pricing", day(5)), (8, 7, "Home", day(1))],
        [(4, 7, "Pricing", day(3)), (5, 8, "Pricing", day(20)), (6, 8, "Pricing", day(20))],
        [(7, 8, "Pricing", day(20)), (10, 7, "Pricing", day(2))],
    ]
    inbox, out, log = (fresh_path(spark, n) for n in ("alerts-in", "alerts-out", "alerts-log"))
    found = []
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = read_feature_stream(spark, inbox, spark.read.parquet(inbox).schema)
        alerts.write_alerts(alerts.pricing_alerts(stream, delay="10 days"), out, log).awaitTermination()
        found.append({r.lead_id: (r.interaction_id, r.alert_at.day) for r in alerts.current_alerts(spark, out).collect()})
    # the last file's view of day 2 is more than ten days behind day 20
    assert found == [{7: (3, 5)}, {7: (2, 4)}, {7: (2, 4), 8: (7, 20)}]


def test_alerts_call_python_once_for_many_leads(spark, monkeypatch):
    """Leads are followed by groups, whatever their number, with the alerts and revisions that each has by itself."""
    import datetime

    from leadspark.session import fresh_path
    from leadspark.streaming import alerts
    from leadspark.streaming.scoring import read_feature_stream

    start = datetime.datetime(2026, 1, 1)
    rows = [(10 * lead + k, str(lead), "Pricing", start + datetime.timedelta(hours=(k * 7 + lead) % 10)) for lead in range(60) for k in range(lead % 7)]
    inbox, out, log = (fresh_path(spark, n) for n in ("alerts-in", "alerts-out", "alerts-log"))
    for part in range(3):
        spark.createDataFrame(rows[part::3], "interaction_id long, lead_id string, page_name string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(inbox)
    stream = read_feature_stream(spark, inbox, spark.read.parquet(inbox).schema, files_per_trigger=1)
    grouped = alerts.pricing_alerts(stream, delay="36500 days", groups=4)
    alerts.write_alerts(grouped, out, log).awaitTermination()
    got = {r.lead_id: r.interaction_id for r in alerts.current_alerts(spark, out).collect()}
    want = {}
    for lead in range(60):
        views = sorted((ts, i) for i, x, _, ts in rows if x == str(lead))
        if len(views) >= 3:
            want[str(lead)] = views[2][1]
    assert got == want and len(want) == 33
    told = spark.read.parquet(out).groupBy("lead_id").agg(F.count("*").alias("n"), F.max("revision").alias("last"), F.min("revision").alias("first")).collect()
    assert all(r.n == r.last and r["first"] == 1 for r in told) and any(r.n > 1 for r in told)
    plan = grouped._jdf.queryExecution().analyzed().toString()
    assert "group#" in plan.split("FlatMapGroupsInPandasWithState")[1].splitlines()[0]

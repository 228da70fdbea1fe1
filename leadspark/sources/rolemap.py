"""Leads and interactions derived from the ``customer`` and ``events`` tables.

The two statements run unchanged on Spark SQL and DuckDB. They add what real lead data has and the
test tables lack: repeated leads, missing values, events without a lead, leads without events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LEADS_SQL = """
SELECT c_custkey AS lead_id,
  2 * c_custkey + copy AS ingest_seq,
  CAST('2023-12-05' AS DATE) + CAST(c_custkey % 30 AS INT) AS created_at,
  CASE WHEN copy = 1 THEN 'Referral' WHEN c_custkey % 8 = 0 THEN 'Direct' WHEN c_custkey % 8 = 1 THEN 'Email Campaign'
       WHEN c_custkey % 8 = 2 THEN 'Facebook' WHEN c_custkey % 8 = 3 THEN 'Google' WHEN c_custkey % 8 = 4 THEN 'Instagram'
       WHEN c_custkey % 8 = 5 THEN 'LinkedIn' WHEN c_custkey % 8 = 6 THEN 'Organic Search' ELSE 'Referral' END AS source,
  CASE c_nationkey % 4 WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'Mid-Market' WHEN 2 THEN 'Startup' ELSE 'SMB' END AS lead_segment,
  c_mktsegment AS industry,
  CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_nationkey < 8 THEN '1-50' WHEN c_nationkey < 16 THEN '51-500' ELSE '500+' END AS company_size,
  CASE c_custkey % 6 WHEN 0 THEN 'Bootstrapped' WHEN 1 THEN 'Seed' WHEN 2 THEN 'Series A' WHEN 3 THEN 'Series B' WHEN 4 THEN 'Series C+' ELSE 'Public' END AS funding_stage,
  CASE c_custkey % 7 WHEN 0 THEN 'Analyst' WHEN 1 THEN 'Manager' WHEN 2 THEN 'Senior Manager' WHEN 3 THEN 'CXO' WHEN 4 THEN 'VP' WHEN 5 THEN 'Intern' ELSE NULL END AS job_role,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'Free' ELSE 'Business' END AS account_type,
  CASE WHEN c_custkey % 10 = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Mobile' ELSE 'Desktop' END AS device_type,
  CASE WHEN c_custkey % 12 = 5 THEN NULL WHEN c_custkey % 4 < 2 THEN 'Growing' ELSE 'Flat' END AS employee_growth_band,
  CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey < 10 THEN 'EMEA' WHEN c_nationkey < 18 THEN 'APAC' ELSE 'AMER' END AS region,
  CASE WHEN c_custkey % 15 = 2 THEN NULL WHEN c_custkey % 5 = 0 THEN 'Ads' ELSE 'Search' END AS first_touch_channel,
  CASE WHEN c_custkey % 14 = 3 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Chrome' ELSE 'Firefox' END AS browser,
  CASE WHEN c_acctbal < -500 THEN NULL WHEN c_acctbal < 5000 THEN '<5M' ELSE '>5M' END AS annual_revenue_band,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('nation-', CAST(c_nationkey AS STRING)) END AS city,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(floor(10 + abs(c_acctbal) * 25) AS DOUBLE) END AS employee_count,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 40 AS DOUBLE) END AS company_age_years
FROM (SELECT *, 0 AS copy FROM {customer}
      UNION ALL
      SELECT *, 1 AS copy FROM {customer} WHERE c_custkey % 50 = 7) c
"""

INTERACTIONS_SQL = """
SELECT event_id AS interaction_id,
  CASE WHEN event_id % 401 = 0 THEN NULL ELSE user_id END AS lead_id,
  concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING), '-', CAST(CAST(floor(extract(HOUR FROM ts) / 6) AS INT) AS STRING)) AS session_id,
  CASE WHEN event_id % 211 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_type = 'signup' AND k = 0 THEN 'demo_request' WHEN event_type = 'signup' AND k = 1 THEN 'free_trial_start'
       WHEN event_type = 'signup' AND k = 2 THEN 'contact_form_submit' WHEN event_type = 'signup' AND k < 23 THEN 'webinar_registration'
       WHEN event_type = 'view' AND k < 30 THEN 'pricing_page_view' WHEN event_type = 'view' AND k < 60 THEN 'document_download'
       WHEN event_type = 'view' THEN 'blog_read' ELSE event_type END AS event_name,
  CASE WHEN event_type = 'purchase' THEN k = 99 ELSE NULL END AS form_completed,
  CASE k % 7 WHEN 0 THEN 'Pricing' WHEN 1 THEN 'Contact' WHEN 2 THEN 'Case Studies' WHEN 3 THEN 'ROI Calculator'
       WHEN 4 THEN 'Features' WHEN 5 THEN 'Webinar' ELSE 'Home' END AS page_name,
  CASE WHEN k >= 95 THEN NULL WHEN event_type = 'purchase' AND k < 3 THEN 'Decision' WHEN event_type = 'click' AND k < 6 THEN 'Evaluation'
       WHEN event_type = 'view' AND k < 12 THEN 'Consideration' ELSE 'Awareness' END AS funnel_stage,
  CASE WHEN k = 50 THEN NULL ELSE value END AS time_on_page_seconds,
  CAST(k AS DOUBLE) AS scroll_depth_percent,
  CAST(extract(DAY FROM ts) AS INT) AS session_number,
  user_id % 3 <> 0 AND k > 80 AS is_return_visitor,
  CASE WHEN event_type = 'click' THEN CAST(k % 5 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS click_count,
  value / 10 AS mouse_activity_score
FROM (SELECT e.*, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events} e) x
"""

# Orders as interactions of their customers: several years, so that every month occurs.
ORDER_EVENTS_SQL = """
SELECT o_orderkey AS interaction_id, CASE WHEN o_orderkey % 401 = 0 THEN NULL ELSE o_custkey END AS lead_id, o_orderdate AS ts,
  CASE WHEN o_orderkey % 37 = 0 THEN 'demo_request' ELSE 'order' END AS event_name, o_orderstatus = 'F' AND o_orderkey % 53 = 0 AS form_completed
FROM {orders}
"""


@dataclass(frozen=True)
class LeadTables:
    """The two input tables and where they came from; ``leads`` may repeat ids, ``interactions`` may lack them."""

    leads: DataFrame
    interactions: DataFrame
    origin: str = ""


def read_tables(spark: SparkSession, sf_dir: str) -> LeadTables:
    """Both tables over ``<sf_dir>/customer.parquet`` and ``<sf_dir>/events.parquet``."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return LeadTables(
        leads=spark.sql(LEADS_SQL, customer=customer),
        interactions=spark.sql(INTERACTIONS_SQL, events=events),
        origin=sf_dir,
    )

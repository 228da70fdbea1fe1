"""SQL that computes the same results on another engine (DuckDB), for checking."""

from __future__ import annotations

import re

from leadspark.constants import (
    EVENT_COUNTS, FEATURE_LABELS, FEATURES, FUNNEL_ORDER, HIGH_INTENT_EVENTS, MEDIAN_COLUMNS, PAGE_COUNTS, SEED, WEEKDAYS,
)
from leadspark.operators.features import ENGINEERED, LOGS, RATIOS, TEMPORAL
from leadspark.plans.registry import EXAMPLE_INTERCEPT, EXAMPLE_WEIGHTS
from leadspark.sources.rolemap import INTERACTIONS_SQL, LEADS_SQL, ORDER_EVENTS_SQL

_high = ", ".join(f"'{e}'" for e in HIGH_INTENT_EVENTS)
_stage = "CASE funnel_stage " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in FUNNEL_ORDER.items()) + " END"
_hit = f"(coalesce(event_name IN ({_high}), false) OR form_completed IS NOT DISTINCT FROM true)"
_pages = ", ".join(f"CAST(count_if(page_name = '{v}') AS BIGINT) AS {c}" for c, v in PAGE_COUNTS.items())
_events = ", ".join(f"CAST(count_if(event_name = '{v}') AS BIGINT) AS {c}" for c, v in EVENT_COUNTS.items())
_LEAD_COLUMNS = [
    "lead_id", "ingest_seq", "created_at", "source", "lead_segment", "industry", "company_size", "funding_stage", "job_role",
    "account_type", "device_type", "employee_growth_band", "region", "first_touch_channel", "browser", "annual_revenue_band", "city",
    "employee_count", "company_age_years",
]
_FILLED = [
    "source", "lead_segment", "company_size", "industry", "funding_stage", "job_role",
    "account_type", "device_type", "employee_growth_band", "region", "first_touch_channel",
]
_EXPLORED = ["city", "browser", "company_size", "annual_revenue_band"]
_INTERACTION_COLUMNS = [
    "interaction_id", "lead_id", "session_id", "ts", "event_name", "form_completed", "page_name", "funnel_stage", "time_on_page_seconds",
    "scroll_depth_percent", "session_number", "is_return_visitor", "click_count", "mouse_activity_score",
]


def _days(a: str, b: str) -> str:
    return f"greatest(date_diff('microsecond', {a}, {b}) / 86400000000.0, 0)"


def _round(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_DOUBLES = {
    "total_time_seconds", "avg_time_per_page", "avg_scroll_depth", "max_scroll_depth", "avg_mouse_activity", *TEMPORAL, *RATIOS, *LOGS,
    "employee_count", "company_age_years", "log_employee_count",
}


def _out(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in _DOUBLES else c for c in columns)


_CTE = {
    "leads_raw": LEADS_SQL.format(customer="customer", events="events"),
    "interactions_raw": INTERACTIONS_SQL.format(events="events"),
    "known": "SELECT * FROM interactions_raw WHERE lead_id IS NOT NULL",
    "leads_first": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ingest_seq) AS rn FROM leads_raw) WHERE rn = 1",
    "order_events": ORDER_EVENTS_SQL.format(orders="orders"),
    "order_ids": f"SELECT DISTINCT lead_id FROM order_events WHERE lead_id IS NOT NULL AND {_hit}",
    "ids": f"SELECT DISTINCT lead_id FROM known WHERE {_hit}",
    "labelled": "SELECT l.*, CASE WHEN i.lead_id IS NULL THEN 0 ELSE 1 END AS converted FROM leads_first l LEFT JOIN ids i ON l.lead_id = i.lead_id",
    "ref": "SELECT max(ts) AS ref_ts FROM interactions_raw",
    "agg": f"""SELECT lead_id, count(DISTINCT session_id) AS session_count, count(interaction_id) AS total_events,
        coalesce(sum(time_on_page_seconds), 0) AS total_time_seconds, avg(time_on_page_seconds) AS avg_time_per_page,
        avg(scroll_depth_percent) AS avg_scroll_depth, max(scroll_depth_percent) AS max_scroll_depth, {_pages}, {_events},
        max(coalesce({_stage}, 1)) AS max_funnel_order, CAST(count(DISTINCT coalesce({_stage}, 1)) AS INT) AS funnel_stages_reached,
        min(ts) AS first_visit, max(ts) AS last_visit, max(session_number) AS max_session_number,
        bool_or(is_return_visitor) AS return_visitor_flag, CAST(coalesce(sum(click_count), 0) AS BIGINT) AS total_clicks,
        avg(mouse_activity_score) AS avg_mouse_activity, max({_stage}) AS deepest_known_stage,
        min(CASE WHEN event_name IN ({_high}) THEN ts END) AS first_intent, CAST(bool_or({_hit}) AS INT) AS is_converted
        FROM known GROUP BY lead_id""",
    "days": "SELECT DISTINCT lead_id, CAST(ts AS DATE) AS d FROM known WHERE ts IS NOT NULL",
    "gaps": """SELECT lead_id, avg(d - prev) AS avg_session_gap_days
        FROM (SELECT lead_id, d, lag(d) OVER (PARTITION BY lead_id ORDER BY d) AS prev FROM days) GROUP BY lead_id""",
    "temporal": f"""SELECT a.lead_id, {_days('first_visit', 'last_visit')} AS span_raw, CASE WHEN first_visit IS NULL THEN NULL ELSE {_days('first_visit', 'last_visit')} END AS engagement_span_days,
        CASE WHEN last_visit IS NULL THEN NULL ELSE {_days('last_visit', 'ref_ts')} END AS days_since_last_visit,
        g.avg_session_gap_days, a.is_converted AS converted
        FROM agg a CROSS JOIN ref LEFT JOIN gaps g ON a.lead_id = g.lead_id""",
    "inter": """SELECT a.* EXCLUDE (first_visit, last_visit, deepest_known_stage, first_intent), coalesce(t.engagement_span_days, 0) AS engagement_span_days,
        t.days_since_last_visit, coalesce(t.avg_session_gap_days, 0) AS avg_session_gap_days,
        (pricing_page_views + contact_page_views + case_study_views) / (CASE total_events WHEN 0 THEN 1 ELSE total_events END) AS high_intent_page_ratio,
        total_events / (coalesce(t.engagement_span_days, 0) + 1) AS avg_events_per_day,
        total_events / (CASE session_count WHEN 0 THEN 1 ELSE session_count END) AS events_per_session,
        ln(1 + total_time_seconds) AS log_total_time_seconds, ln(1 + total_events) AS log_total_events, ln(1 + total_clicks) AS log_total_clicks
        FROM agg a JOIN temporal t ON a.lead_id = t.lead_id""",
    "profile": "SELECT l.* EXCLUDE (company_size, job_role, account_type, device_type, employee_growth_band, region, first_touch_channel, employee_count, company_age_years), "
        "coalesce(account_type, 'Unknown') AS account_type, coalesce(device_type, 'Unknown') AS device_type, coalesce(region, 'Unknown') AS region, "
        "coalesce(employee_growth_band, 'Unknown') AS employee_growth_band, coalesce(first_touch_channel, 'Unknown') AS first_touch_channel, coalesce(company_size, 'Unknown') AS company_size, "
        "coalesce(job_role, 'Unknown') AS job_role, coalesce(employee_count, m1) AS employee_count, coalesce(company_age_years, m2) AS company_age_years, "
        "ln(1 + coalesce(employee_count, m1)) AS log_employee_count "
        "FROM labelled l CROSS JOIN (SELECT median(employee_count) AS m1, median(company_age_years) AS m2 FROM leads_first)",
    "feats": "SELECT p.*, " + ", ".join(
        f"CASE WHEN i.{c} THEN 1 ELSE 0 END AS {c}" if c == "return_visitor_flag" else f"coalesce(i.{c}, 0) AS {c}" for c in ENGINEERED
    ) + " FROM profile p LEFT JOIN inter i ON p.lead_id = i.lead_id",
    "model": f"SELECT lead_id, converted, {_out(FEATURES)} FROM feats",
    "scored": """SELECT lead_id, converted, p AS probability_1, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction
        FROM (SELECT *, round(1 / (1 + exp(-(0.4 * max_funnel_order + 0.02 * total_events - 3.0))), 9) AS p FROM model)""",
    "imputed": "SELECT l.* EXCLUDE (city, company_size, browser, annual_revenue_band, employee_count, company_age_years), coalesce(city, 'Unknown') AS city, coalesce(browser, 'Unknown') AS browser, coalesce(annual_revenue_band, 'Unknown') AS annual_revenue_band, "
        "coalesce(company_size, 'Unknown') AS company_size, coalesce(employee_count, m1) AS employee_count, coalesce(company_age_years, m2) AS company_age_years "
        "FROM leads_raw l CROSS JOIN (SELECT median(employee_count) AS m1, median(company_age_years) AS m2 FROM leads_raw)",
    "clean": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ingest_seq) AS rn FROM imputed) WHERE rn = 1",
    "ttc": "SELECT lead_id, date_diff('microsecond', first_visit, first_intent) / 86400000000.0 AS days_to_convert FROM agg "
        "WHERE first_visit IS NOT NULL AND first_intent IS NOT NULL",
    "outcomes": "SELECT l.lead_id, coalesce(a.is_converted, 0) AS converted, a.session_count, a.pricing_page_views, a.deepest_known_stage "
        "FROM leads_first l LEFT JOIN agg a ON l.lead_id = a.lead_id",
    "numbered": "SELECT m.*, dense_rank() OVER (ORDER BY source) - 1 AS source_number FROM model m",
}


def _x(f: str) -> str:
    return "source_number" if f == "source" else f


_MODELS = ["Logistic Regression", "Random Forest", "Gradient Boosting", "Column-Sampled Boosting"]


def _board(which) -> str:
    """The rows that a leaderboard of these models must have; a fifth of each class, rounded, is tested."""
    rows = ", ".join(f"({i}, '{_MODELS[k]}')" for i, k in enumerate(which))
    tested = ", ".join(f"CAST(round(0.2 * (SELECT count_if(converted = {y}) FROM model)) AS BIGINT) AS n_{y}" for y in (0, 1))
    flags = "true AS in_range, true AS f1_follows, true AS accuracy_follows, true AS beats_chance"
    return f"SELECT position, model, {tested}, {flags} FROM (VALUES {rows}) AS v(position, model)"


_CTE["moments"] = "SELECT " + ", ".join(f"avg({_x(f)}) AS m_{f}, stddev_pop({_x(f)}) AS s_{f}" for f in FEATURES) + " FROM numbered"
_CTE["contributed"] = "SELECT n.*, " + ", ".join(
    f"{EXAMPLE_WEIGHTS[f]} * ({_x(f)} - m_{f}) / CASE s_{f} WHEN 0 THEN 1 ELSE s_{f} END AS c_{f}" for f in FEATURES
) + " FROM numbered n CROSS JOIN moments"
_CTE["probable"] = f"SELECT *, 1 / (1 + exp(-({EXAMPLE_INTERCEPT} + {' + '.join(f'c_{f}' for f in FEATURES)}))) AS probability_1 FROM contributed"
_CTE["items"] = " UNION ALL ".join(
    f"SELECT lead_id, {i} AS place, '{f}' AS feature, {'source' if f == 'source' else f'CAST(CAST({f} AS DOUBLE) AS VARCHAR)'} AS value, "
    f"c_{f} AS raw, '{FEATURE_LABELS[f]}' AS human_label FROM probable"
    for i, f in enumerate(FEATURES)
)
_CTE["factors"] = """SELECT lead_id, CAST(rk AS INT) AS factor_rank, feature, value, round(raw, 4) AS contribution,
    CASE WHEN raw > 0 THEN 'increases' ELSE 'decreases' END AS direction, human_label
    FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY abs(raw) DESC, place) AS rk FROM items) WHERE rk <= 5"""
_CTE["ranked_class"] = f"""SELECT lead_id, converted,
    row_number() OVER (PARTITION BY converted ORDER BY md5(concat(CAST(lead_id AS VARCHAR), '_{SEED}')), lead_id) AS rn,
    count(*) OVER (PARTITION BY converted) AS n FROM labelled"""


def _needs(sql: str) -> list[str]:
    """The named subqueries a statement uses, in the order they are defined."""
    wanted, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in _CTE:
            if name in words and name not in wanted:
                wanted.add(name)
                todo.append(_CTE[name])
    return [name for name in _CTE if name in wanted]


def _sql(body: str) -> str:
    names = _needs(body)
    return ("WITH " + ",\n".join(f"{n} AS ({_CTE[n]})" for n in names) + "\n" if names else "") + body


def _nulls(table: str, columns: list[str], tail: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM {table}" for c in columns)
    return f"SELECT * FROM ({parts}) WHERE n_missing > 0 ORDER BY n_missing DESC, column_name {tail}"


def _box(value: str, table: str, by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    return f"""SELECT {key}count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
        round(least(min(CASE WHEN x >= lo THEN x END), any_value(q1)), 4) AS whisker_low,
        round(greatest(max(CASE WHEN x <= hi THEN x END), any_value(q3)), 4) AS whisker_high,
        CAST(count_if(NOT (x >= lo AND x <= hi)) AS BIGINT) AS outliers
        FROM (SELECT {key}CAST({value} AS DOUBLE) AS x FROM {table} WHERE {value} IS NOT NULL) v
        JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
              (SELECT {key}quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({value} AS DOUBLE), 0.5) AS q2,
                      quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3 FROM {table} WHERE {value} IS NOT NULL {group})) q {on} {group}"""


def _hist(long: str, keys: list[str], classes: list[str], bins: int = 30) -> str:
    """``long`` yields keys, classes and value."""
    k, kc = "".join(f"{c}, " for c in keys), "".join(f"{c}, " for c in keys + classes)
    group_k = f"GROUP BY {', '.join(keys)}" if keys else ""
    join_k = f"USING ({', '.join(keys)})" if keys else "ON true"
    join_all = f"USING ({', '.join(keys + classes + ['bin'])})"
    edge = f"(lo + ({{i}}) * (hi - lo) / {bins})"
    down = f"CASE WHEN value < {edge.format(i='g')} THEN g - 1 ELSE g END"
    grid_from = f"(SELECT DISTINCT {', '.join(keys + classes)} FROM v) d JOIN e {join_k}" if keys + classes else "e"
    return f"""SELECT {kc}CAST(bin AS INT) AS bin, round({edge.format(i='bin - 1')}, 6) AS bin_start, round({edge.format(i='bin')}, 6) AS bin_end, coalesce(n, 0) AS n
        FROM (WITH v AS (SELECT * FROM ({long}) WHERE value IS NOT NULL),
              e AS (SELECT {k}min(value) - CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS lo,
                           max(value) + CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END AS hi FROM v {group_k}),
              f AS (SELECT {kc}value, lo, hi, least(CAST(floor((value - lo) / (hi - lo) * {bins}) AS INT), {bins - 1}) AS g FROM v JOIN e {join_k}),
              f2 AS (SELECT {kc}value, lo, hi, {down} AS g FROM f),
              h AS (SELECT {kc}1 + CASE WHEN value >= {edge.format(i='g + 1')} AND g < {bins - 1} THEN g + 1 ELSE g END AS bin FROM f2),
              c AS (SELECT {kc}bin, count(*) AS n FROM h GROUP BY {', '.join(keys + classes + ['bin'])}),
              grid AS (SELECT {kc}lo, hi, b.bin FROM {grid_from} CROSS JOIN (SELECT unnest(range(1, {bins + 1})) AS bin) b WHERE lo IS NOT NULL)
              SELECT grid.*, c.n FROM grid LEFT JOIN c {join_all})"""


def _corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    spread = f"(stddev_pop({x}) * stddev_pop({y}))"
    return f"round(CASE WHEN {spread} = 0 THEN NULL ELSE covar_pop({x}, {y}) / {spread} END, 6)"


def _conversion(column: str) -> str:
    return f"SELECT {column}, round(avg(converted), 3) AS conversion_rate FROM labelled WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY 2 DESC, 1"


def _weekdays(where: str, what: str, order: str) -> str:
    days = ", ".join(f"({i}, '{d}')" for i, d in enumerate(WEEKDAYS, 1))
    return f"""SELECT dow_no, day_of_week, n_events FROM (VALUES {days}) AS w(dow_no, day_of_week)
        LEFT JOIN (SELECT isodow(ts) AS dow, {what} AS n_events FROM interactions_raw WHERE ts IS NOT NULL AND {where} GROUP BY 1) c ON c.dow = w.dow_no {order}"""


_temporal_long = " UNION ALL ".join(f"SELECT '{c}' AS feature, converted, {c} AS value FROM temporal" for c in TEMPORAL)
_CORR = ["session_count", "pricing_page_views", *TEMPORAL, "employee_count", "company_age_years", "converted"]
_full = """SELECT c.lead_id, a.session_count, coalesce(a.pricing_page_views, 0) AS pricing_page_views, t.engagement_span_days,
    t.days_since_last_visit, t.avg_session_gap_days, c.employee_count, c.company_age_years, coalesce(a.is_converted, 0) AS converted
    FROM clean c LEFT JOIN agg a ON c.lead_id = a.lead_id LEFT JOIN temporal t ON c.lead_id = t.lead_id"""
_share = {
    "business_hours_share": "isodow(ts) < 6 AND hour(ts) >= 9 AND hour(ts) < 18",
    "weekend_share": "isodow(ts) >= 6",
    "night_share": "hour(ts) >= 22 OR hour(ts) < 6",
}
_f1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2.0 * tp / (2 * tp + fp + fn), 4) END"


def _cells(prediction: str) -> str:
    return f"""SELECT count_if(converted = 1 AND {prediction}) AS tp, count_if(converted = 0 AND {prediction}) AS fp,
        count_if(converted = 1 AND NOT {prediction}) AS fn, count_if(converted = 0 AND NOT {prediction}) AS tn FROM scored"""


_checks = " ".join(
    [f"WHEN lead_id % 10 = {d} THEN 'Invalid number for ''{c}''.'" for c, d in (("session_count", 5), ("session_count", 6), ("session_count", 7), ("total_events", 4))]
)
_lead_cols_typed = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c == "lead_id" else f"CAST({c} AS TIMESTAMP) AS {c}" if c == "created_at" else c
    for c in _LEAD_COLUMNS if c != "ingest_seq"
)
_interaction_typed = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c in ("interaction_id", "lead_id", "is_return_visitor") else f"round({c}, 6) AS {c}"
    if c in ("time_on_page_seconds", "scroll_depth_percent", "mouse_activity_score") else c for c in _INTERACTION_COLUMNS
)
_coded = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS {c}" for c in _FILLED)
_feature_columns = [*_LEAD_COLUMNS, "log_employee_count", "converted", *ENGINEERED]
_numeric_columns = [c for c in ["ingest_seq", "employee_count", "company_age_years", "log_employee_count", *ENGINEERED]]
_MEDIANS = ", ".join(MEDIAN_COLUMNS)

ORACLES: dict[str, str] = {name: _sql(body) for name, body in {
    "csv_ingest": f"SELECT {_lead_cols_typed} FROM leads_raw",
    "csv_ingest_interactions": f"SELECT {_interaction_typed} FROM interactions_raw",
    "table_shape": f"SELECT 'leads' AS table_name, count(*) AS n_rows, {len(_LEAD_COLUMNS)} AS n_columns FROM leads_raw "
        f"UNION ALL SELECT 'interactions', count(*), {len(_INTERACTION_COLUMNS)} FROM interactions_raw",
    "preview_head": "SELECT * FROM leads_raw ORDER BY ingest_seq LIMIT 3",
    "preview_head_interactions": "SELECT * REPLACE (round(time_on_page_seconds, 6) AS time_on_page_seconds, round(scroll_depth_percent, 6) AS scroll_depth_percent, "
        "round(mouse_activity_score, 6) AS mouse_activity_score) FROM interactions_raw ORDER BY interaction_id LIMIT 3",
    "null_counts_leads": _nulls("leads_raw", _LEAD_COLUMNS),
    "null_counts_interactions_top10": _nulls("interactions_raw", _INTERACTION_COLUMNS, "LIMIT 10"),
    "missing_cells_total": "SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in _LEAD_COLUMNS) + f" AS BIGINT) AS n_missing, count(*) * {len(_LEAD_COLUMNS)} AS n_cells FROM leads_raw",
    "null_counts_after_impute": _nulls("imputed", _LEAD_COLUMNS),
    "duplicate_summary": "SELECT count(*) AS n_rows, count(DISTINCT lead_id) AS n_ids, count(*) - count(DISTINCT lead_id) AS n_duplicates FROM leads_raw",
    "duplicate_rows": "SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY lead_id) AS n FROM leads_raw) WHERE n > 1 ORDER BY lead_id, ingest_seq LIMIT 6",
    "employee_count_describe": "SELECT count(employee_count) AS n, round(avg(employee_count), 1) AS mean, round(stddev_samp(employee_count), 1) AS std, "
        "round(min(employee_count), 1) AS min, round(quantile_cont(employee_count, 0.25), 1) AS p25, round(quantile_cont(employee_count, 0.5), 1) AS p50, "
        "round(quantile_cont(employee_count, 0.75), 1) AS p75, round(max(employee_count), 1) AS max FROM clean",
    "employee_count_box": _box("employee_count", "clean"),
    "employee_count_box_log": _box("ln(1 + employee_count)", "clean"),
    "interaction_time_range": "SELECT min(ts) AS min_ts, max(ts) AS max_ts, CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000.0) AS BIGINT) AS span_days FROM interactions_raw",
    "interactions_before_creation": "SELECT i.interaction_id, i.lead_id, i.ts, l.created_at FROM interactions_raw i LEFT JOIN leads_first l ON i.lead_id = l.lead_id WHERE i.ts < l.created_at",
    "dedup_leads_first": "SELECT * FROM leads_first",
    "fill_unknown_exploration": "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in _EXPLORED) + ") FROM leads_raw",
    "fill_unknown": "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in _FILLED) + ") FROM leads_raw",
    "impute_median_train": f"SELECT lead_id, {_MEDIANS} FROM profile",
    "impute_median_eda": f"SELECT lead_id, ingest_seq, {_MEDIANS} FROM imputed",
    "parse_ts_coerce": "SELECT interaction_id, CASE WHEN interaction_id % 97 = 0 THEN NULL ELSE ts END AS ts FROM interactions_raw",
    "funnel_order_train": f"SELECT interaction_id, coalesce({_stage}, 1) AS funnel_order FROM interactions_raw",
    "funnel_order_eda": f"SELECT interaction_id, {_stage} AS funnel_order FROM interactions_raw",
    "return_flag_normalise": """SELECT interaction_id, flag_text, CASE WHEN lower(flag_text) IN ('true', 'yes') THEN 1 ELSE 0 END AS flag FROM
        (SELECT interaction_id, CASE interaction_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'True' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' WHEN 4 THEN 'FALSE'
         WHEN 5 THEN '1' WHEN 6 THEN 'maybe' END AS flag_text FROM interactions_raw)""",
    "drop_model_excluded": f"SELECT {_out([c for c in _feature_columns if c not in ('lead_id', 'created_at', 'city', 'browser', 'annual_revenue_band', 'converted')])} FROM feats",
    "numeric_projection": f"SELECT lead_id AS lead, {_coded}, {_out(_numeric_columns)} FROM feats",
    "model_features": f"SELECT lead_id, converted, {', '.join(FEATURES)} FROM model",
    "high_intent_events": f"SELECT interaction_id, lead_id, event_name FROM interactions_raw WHERE event_name IN ({_high})",
    "form_completions": "SELECT interaction_id, lead_id, form_completed FROM interactions_raw WHERE form_completed",
    "converted_ids": "SELECT lead_id FROM ids",
    "lead_labels": "SELECT lead_id, source, converted FROM labelled",
    "lead_aggregates": "SELECT lead_id, " + _out(["session_count", *[c for c in ENGINEERED if c not in (*TEMPORAL, *RATIOS, *LOGS, "session_count")]]) + ", first_visit, last_visit FROM agg",
    "lead_temporal": "SELECT lead_id, round(coalesce(engagement_span_days, 0), 6) AS engagement_span_days, round(days_since_last_visit, 6) AS days_since_last_visit, "
        "round(coalesce(avg_session_gap_days, 0), 6) AS avg_session_gap_days FROM temporal",
    "avg_session_gap": "SELECT lead_id, round(avg_session_gap_days, 6) AS avg_session_gap_days FROM gaps",
    "avg_session_gap_closed": "SELECT lead_id, round(CASE WHEN count(*) > 1 THEN (max(d) - min(d)) / (count(*) - 1) END, 6) AS avg_session_gap_days FROM days GROUP BY lead_id",
    "ratio_features": f"SELECT lead_id, {_round(RATIOS)} FROM inter",
    "log_features": f"SELECT lead_id, {_round(LOGS)} FROM inter",
    "lead_features": f"SELECT {_out(_feature_columns)} FROM feats",
    "lead_features_kept": f"SELECT {_out(_feature_columns)} FROM feats",
    "conversion_summary": "SELECT CAST(sum(converted) AS BIGINT) AS n_converted, count(*) AS n_leads, round(avg(converted) * 100, 4) AS rate_pct, CAST(count_if(converted = 0) AS BIGINT) AS n_not_converted FROM labelled",
    "class_counts": "SELECT converted, count(*) AS n_leads FROM labelled GROUP BY converted",
    "source_volume": "SELECT source, count(*) AS n_leads FROM leads_first WHERE source IS NOT NULL GROUP BY source ORDER BY 2 DESC, 1",
    "conversion_by_source": _conversion("source"),
    "conversion_by_segment": _conversion("lead_segment"),
    "conversion_by_industry": _conversion("industry"),
    "conversion_by_job_role": _conversion("job_role"),
    "conversion_by_funding_stage": _conversion("funding_stage"),
    "segment_gap": "SELECT " + ", ".join(
        f"round(coalesce(avg(CASE WHEN {c} = '{v}' THEN converted END), 0), 3) AS {v.lower()}_rate"
        for c, v in (("lead_segment", "Enterprise"), ("lead_segment", "SMB"), ("job_role", "Analyst"), ("job_role", "Intern"))
    ) + " FROM labelled",
    "funnel_conversion": "SELECT deepest_known_stage AS funnel_order, count(*) AS n_leads, round(avg(converted), 4) AS conversion_rate FROM outcomes WHERE deepest_known_stage IS NOT NULL GROUP BY 1",
    "sessions_per_lead": "SELECT lead_id, session_count FROM agg",
    "session_means": "SELECT converted, round(avg(session_count), 4) AS mean_sessions FROM outcomes GROUP BY converted",
    "session_box": _box("session_count", "outcomes", "converted"),
    "pricing_views_per_lead": "SELECT lead_id, count(*) AS pricing_page_views FROM known WHERE page_name = 'Pricing' GROUP BY lead_id",
    "pricing_means": "SELECT converted, round(avg(coalesce(pricing_page_views, 0)), 4) AS mean_pricing_views FROM outcomes GROUP BY converted",
    "monthly_patterns": """SELECT month, CASE month WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' WHEN 12 THEN 'Dec' END AS month_name,
        total_events, conv_events, unique_leads, round(conv_events * 100.0 / total_events, 4) AS conv_rate FROM
        (SELECT CAST(month(ts) AS INT) AS month, count(interaction_id) AS total_events, CAST(sum(CASE WHEN i.lead_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS conv_events, count(DISTINCT r.lead_id) AS unique_leads
         FROM interactions_raw r LEFT JOIN ids i ON r.lead_id = i.lead_id WHERE ts IS NOT NULL GROUP BY 1)""",
    "monthly_patterns_orders": """SELECT month, CASE month WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' WHEN 12 THEN 'Dec' END AS month_name,
        total_events, conv_events, unique_leads, round(conv_events * 100.0 / total_events, 4) AS conv_rate FROM
        (SELECT CAST(month(ts) AS INT) AS month, count(interaction_id) AS total_events, CAST(sum(CASE WHEN i.lead_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS conv_events, count(DISTINCT r.lead_id) AS unique_leads
         FROM order_events r LEFT JOIN order_ids i ON r.lead_id = i.lead_id WHERE ts IS NOT NULL GROUP BY 1)""",
    "interaction_class_counts": """SELECT CASE WHEN i.lead_id IS NULL THEN 0 ELSE 1 END AS converted, count(*) AS n_interactions
        FROM interactions_raw r LEFT JOIN ids i ON r.lead_id = i.lead_id GROUP BY 1""",
    "dow_all_events": _weekdays("true", "count(interaction_id)", "ORDER BY dow_no"),
    "dow_high_intent": _weekdays(f"event_name IN ({_high})", "count(*)", "ORDER BY n_events DESC NULLS LAST, dow_no"),
    "time_to_convert": "SELECT lead_id, round(days_to_convert, 6) AS days_to_convert FROM ttc",
    "time_to_convert_summary": "SELECT count(*) AS n_leads, round(avg(days_to_convert), 4) AS mean_days, CAST(count_if(days_to_convert < 1) AS BIGINT) AS under_1_day, "
        "CAST(count_if(days_to_convert < 7) AS BIGINT) AS under_7_days, CAST(count_if(days_to_convert > 30) AS BIGINT) AS over_30_days, round(median(days_to_convert), 4) AS median_days FROM ttc",
    "time_to_convert_hist": _hist("SELECT days_to_convert AS value FROM ttc", [], []),
    "temporal_correlations": " UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr(c, 'converted')} AS correlation FROM temporal" for c in TEMPORAL),
    "temporal_class_means": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(CASE WHEN converted = 0 THEN {c} END), 1) AS not_converted, round(avg(CASE WHEN converted = 1 THEN {c} END), 1) AS converted FROM temporal" for c in TEMPORAL
    ),
    "temporal_hist": _hist(_temporal_long, ["feature"], ["converted"]),
    "temporal_kde": f"""SELECT feature, converted, CAST(point AS INT) AS point, round(max(lo + point * (hi - lo) / 199), 6) AS x,
        round(sum(exp(-0.5 * pow((lo + point * (hi - lo) / 199 - value) / h, 2))) / (max(n) * max(h) * 2.5066282746310002), 6) AS density
        FROM (SELECT v.feature, v.converted, v.value, s.n, s.sd * pow(s.n, -0.2) AS h, e.lo, e.hi FROM ({_temporal_long}) v
              JOIN (SELECT feature, converted, count(*) AS n, stddev_samp(value) AS sd FROM ({_temporal_long}) WHERE value IS NOT NULL GROUP BY 1, 2) s ON s.feature = v.feature AND s.converted = v.converted
              JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM ({_temporal_long}) GROUP BY 1) e ON e.feature = v.feature WHERE v.value IS NOT NULL AND s.sd > 0)
        CROSS JOIN (SELECT unnest(range(0, 200)) AS point) GROUP BY feature, converted, point""",
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr(a, b)} AS correlation FROM ({_full})" for a in _CORR for b in _CORR),
    "quartile_conversion": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, quartile, count(*) AS n_leads, round(avg(converted), 4) AS conversion_rate FROM
            (SELECT converted, 1 + CAST({c} > q1 AS INT) + CAST({c} > q2 AS INT) + CAST({c} > q3 AS INT) AS quartile FROM temporal CROSS JOIN
             (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM temporal) WHERE {c} IS NOT NULL) GROUP BY quartile"""
        for c in ("days_since_last_visit", "avg_session_gap_days")
    ),
    "time_of_day_correlation": " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {_corr('share', 'converted')} AS correlation FROM (SELECT lead_id, avg(CAST(({w}) AS DOUBLE)) AS share, CAST(bool_or({_hit}) AS INT) AS converted FROM known GROUP BY lead_id)"
        for n, w in _share.items()
    ),
    "third_pricing_view": "SELECT lead_id, interaction_id, ts AS alert_at FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ts, interaction_id) AS rn "
        "FROM known WHERE page_name = 'Pricing' AND ts IS NOT NULL) WHERE rn = 3",
    "third_pricing_view_stream": "SELECT lead_id, interaction_id, ts AS alert_at FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ts, interaction_id) AS rn "
        "FROM known WHERE page_name = 'Pricing' AND ts IS NOT NULL) WHERE rn = 3",
    "label_encode": f"SELECT lead_id, {_coded} FROM (SELECT lead_id, {', '.join(f'coalesce({c}, {chr(39)}Unknown{chr(39)}) AS {c}' for c in _FILLED)} FROM leads_first)",
    "stratified_split": "SELECT lead_id, converted, rn <= round(0.2 * n) AS is_test FROM ranked_class",
    "stratified_folds": "SELECT lead_id, converted, CAST((rn - 1) % 5 AS INT) AS fold FROM ranked_class",
    "class_weights": "SELECT converted, count(*) AS n_rows, round((SELECT count(*) FROM ranked_class WHERE rn > round(0.2 * n)) / "
        "((SELECT count(DISTINCT converted) FROM ranked_class WHERE rn > round(0.2 * n)) * count(*)), 6) AS weight FROM ranked_class WHERE rn > round(0.2 * n) GROUP BY converted",
    "standardise": "SELECT lead_id, " + ", ".join(
        f"round(({f} - avg({f}) OVER ()) / CASE stddev_pop({f}) OVER () WHEN 0 THEN 1 ELSE stddev_pop({f}) OVER () END, 6) AS {f}" for f in FEATURES if f != "source"
    ) + " FROM model",
    "leak_check": " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS is_present, false AS is_leak" for f in FEATURES),
    "classification_metrics": f"""SELECT round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 4) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 4) END AS recall, {_f1} AS f1 FROM ({_cells('prediction = 1')})""",
    "auc_roc": """SELECT round(sum(CASE WHEN p.probability_1 > q.probability_1 THEN 1.0 WHEN p.probability_1 = q.probability_1 THEN 0.5 ELSE 0 END) / count(*), 4) AS auc_roc
        FROM scored p JOIN scored q ON p.converted = 1 AND q.converted = 0""",
    "roc_curve": """SELECT probability_1 AS threshold, round(sum(sum(1 - converted)) OVER w / (SELECT sum(1 - converted) FROM scored), 6) AS fpr,
        round(sum(sum(converted)) OVER w / (SELECT sum(converted) FROM scored), 6) AS tpr FROM scored GROUP BY probability_1
        WINDOW w AS (ORDER BY probability_1 DESC) UNION ALL SELECT NULL, 0, 0""",
    "confusion_matrix": """SELECT actual, predicted, count(s.lead_id) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(actual, predicted)
        LEFT JOIN scored s ON s.converted = c.actual AND s.prediction = c.predicted GROUP BY 1, 2""",
    # invariants: the queries compute the flags from their rows
    "model_matrix": "SELECT lead_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS DOUBLE) AS x_source, "
        + ", ".join(f"round(CAST({f} AS DOUBLE), 6) AS x_{f}" for f in FEATURES if f != "source") + " FROM model",
    "model_roundtrip": "SELECT lead_id, true AS same FROM model",
    "batch_score": "SELECT lead_id, true AS in_range, true AS bands_agree, true AS separates FROM model",
    "score_stream": "SELECT lead_id, true AS in_range, true AS bands_agree, true AS same_as_batch FROM model WHERE lead_id % 10 NOT IN (3, 4, 5, 6, 7)",
    "feature_importance": "SELECT feature, true AS is_share, true AS adds_up, true AS in_order FROM (VALUES " + ", ".join(f"('{f}')" for f in FEATURES) + ") AS v(feature)",
    "explain_tree": "SELECT lead_id, 'probability' AS space, true AS adds_up FROM model",
    "cv_f1": """SELECT CAST(range AS INT) AS fold, CAST((SELECT count_if(converted = 0) - range + 4 FROM model) // 5 AS BIGINT) AS n_0,
        CAST((SELECT count_if(converted = 1) - range + 4 FROM model) // 5 AS BIGINT) AS n_1, true AS in_range FROM range(5)""",
    **{name: _board([k]) for name, k in {"train_lr": 0, "train_rf": 1, "train_gbt": 2, "train_gbt_colsample": 3}.items()},
    "model_leaderboard": _board(range(4)),
    "metrics_document": "SELECT position, model, true AS as_measured, true AS cv_in_range FROM (VALUES "
        + ", ".join(f"({k}, '{m}')" for k, m in enumerate(_MODELS)) + ") AS v(position, model)",
    "model_card": f"""SELECT 'Random Forest' AS model, 'RandomForestClassificationModel' AS model_type, {len(FEATURES)} AS feature_count, '{", ".join(FEATURES)}' AS features,
        string_agg(source, ', ' ORDER BY source) AS supported_sources FROM (SELECT DISTINCT source FROM model)""",
    "logistic_gradient": "SELECT coefficient, 0.0::DOUBLE AS gradient, true AS bounded, CAST(count_if(converted = 0) AS BIGINT) AS n_0, CAST(count_if(converted = 1) AS BIGINT) AS n_1 FROM model, (VALUES "
        + ", ".join(f"('{f}')" for f in [*FEATURES, "intercept"]) + ") AS v(coefficient) GROUP BY 1",
    **{f"explain_{m}_factors": "SELECT lead_id, CAST(k AS INT) AS factor_rank, true AS own_value, true AS direction_follows, true AS ranked FROM model, range(1, 6) AS r(k)" for m in ("forest", "logistic")},
    **{f"explain_{m}_summary": """SELECT lead_id, CASE max_funnel_order WHEN 1 THEN 'Awareness' WHEN 2 THEN 'Consideration' WHEN 3 THEN 'Evaluation' WHEN 4 THEN 'Decision' ELSE 'Unknown' END AS funnel_stage,
        true AS percent_agrees, true AS strength_agrees FROM model""" for m in ("forest", "logistic")},
    "select_best": "SELECT model, f1 FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS model, {_f1} AS f1 FROM ({_cells(f'probability_1 > {cut}')})" for i, (name, cut) in enumerate([("cut 0.3 a", 0.3), ("cut 0.3 b", 0.3), ("cut 0.6", 0.6)])
    ) + ") ORDER BY f1 DESC, position LIMIT 1",
    "validate_requests": f"""SELECT lead_id, CASE {_checks} ELSE 'Invalid value for ''source''. Allowed values: [' ||
        (SELECT string_agg('''' || source || '''', ', ' ORDER BY source) FROM (SELECT DISTINCT source FROM leads_raw)) || ']' END AS reason
        FROM model WHERE lead_id % 10 IN (3, 4, 5, 6, 7)""",
    "score_bands": """SELECT lead_id, CASE WHEN probability_1 >= 0.5 THEN 'ACCEPT' ELSE 'REJECT' END AS prediction, round(probability_1, 4) AS conversion_probability,
        CASE WHEN greatest(probability_1, 1 - probability_1) >= 0.85 THEN 'high' WHEN greatest(probability_1, 1 - probability_1) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN probability_1 >= 0.8 THEN 'low' WHEN probability_1 >= 0.5 THEN 'medium' ELSE 'high' END AS risk_level FROM scored""",
    "explain_linear": f"SELECT lead_id, {_round([f'c_{f}' for f in FEATURES])}, round(probability_1, 6) AS probability_1 FROM probable",
    "explain_top_factors": "SELECT * FROM factors",
    "explain_summary": """SELECT p.lead_id, round(p.probability_1, 4) AS conversion_probability, CASE WHEN p.probability_1 >= 0.5 THEN 'ACCEPT' ELSE 'REJECT' END AS prediction,
        concat_ws(' ', 'This lead has a ' || CASE WHEN p.probability_1 >= 0.75 THEN 'strong' WHEN p.probability_1 >= 0.45 THEN 'moderate' ELSE 'low' END ||
            ' conversion probability of ' || CAST(CAST(round_even(p.probability_1 * 100, 0) AS INT) AS VARCHAR) || '%.',
          'The lead reached the ' || CASE p.max_funnel_order WHEN 1 THEN 'Awareness' WHEN 2 THEN 'Consideration' WHEN 3 THEN 'Evaluation' WHEN 4 THEN 'Decision' ELSE 'Unknown' END || ' stage of the funnel.',
          coalesce('Key positive signals: ' || pos.t || '.', 'No strong positive signals detected.'), 'Main drag: ' || neg.t || '.') AS summary
        FROM probable p
        LEFT JOIN (SELECT lead_id, string_agg(human_label || ' (' || value || ')', ', ' ORDER BY factor_rank) AS t FROM
            (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY factor_rank) AS k FROM factors WHERE contribution > 0) WHERE k <= 3 GROUP BY lead_id) pos ON pos.lead_id = p.lead_id
        LEFT JOIN (SELECT lead_id, human_label || ' (' || value || ')' AS t FROM
            (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY factor_rank) AS k FROM factors WHERE contribution < 0) WHERE k = 1) neg ON neg.lead_id = p.lead_id""",
}.items()}

"""Words and numbers the results depend on."""

# Events that mark a lead as converted.
HIGH_INTENT_EVENTS = ["demo_request", "free_trial_start", "contact_form_submit"]

# Depth of each funnel stage.
FUNNEL_ORDER = {"Awareness": 1, "Consideration": 2, "Evaluation": 3, "Decision": 4}

# Lead columns whose missing values become UNKNOWN: before training, and in exploration.
UNKNOWN = "Unknown"
TRAIN_CATEGORICALS = [
    "source", "lead_segment", "company_size", "industry", "funding_stage", "job_role",
    "account_type", "device_type", "employee_growth_band", "region", "first_touch_channel",
]
EXPLORE_CATEGORICALS = ["city", "browser", "company_size", "annual_revenue_band"]

# Lead columns whose missing values become the median.
MEDIAN_COLUMNS = ["employee_count", "company_age_years"]

# Columns kept away from the models: identifiers, raw text, the label itself.
MODEL_EXCLUDED = [
    "lead_id", "business_email", "city", "state", "campaign", "browser",
    "annual_revenue_band", "screen_size", "created_at", "converted",
]

# Columns that would leak the label into the features.
LABEL_DEFINING = ["demo_requests", "free_trial_starts", "contact_form_submits", "forms_completed", "form_completed"]

# The model's features, in order, with their plain names.
FEATURE_LABELS = {
    "source": "Acquisition source",
    "session_count": "Number of sessions",
    "total_events": "Total interactions",
    "total_time_seconds": "Time on site (seconds)",
    "pricing_page_views": "Pricing page visits",
    "webinar_registrations": "Webinar registrations",
    "max_funnel_order": "Deepest funnel stage reached",
    "total_clicks": "Total clicks",
    "engagement_span_days": "Days active on site",
    "days_since_last_visit": "Days since last visit",
    "avg_session_gap_days": "Average days between sessions",
}
FEATURES = list(FEATURE_LABELS)

# Pages and events counted per lead.
PAGE_COUNTS = {
    "pricing_page_views": "Pricing",
    "contact_page_views": "Contact",
    "case_study_views": "Case Studies",
    "roi_calc_views": "ROI Calculator",
    "features_page_views": "Features",
    "webinar_views": "Webinar",
}
EVENT_COUNTS = {
    "pricing_events": "pricing_page_view",
    "doc_downloads": "document_download",
    "webinar_registrations": "webinar_registration",
    "blog_reads": "blog_read",
}

# Calendar names used in reports.
MONTH_NAMES = {1: "Jan", 2: "Feb", 3: "Mar", 4: "Apr", 5: "May", 6: "Jun", 7: "Jul", 8: "Aug", 9: "Sep", 10: "Oct", 11: "Nov", 12: "Dec"}
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Cell texts read as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Score bands.
ACCEPT_FROM = 0.5
CONFIDENCE_HIGH_FROM, CONFIDENCE_MEDIUM_FROM = 0.85, 0.60
RISK_LOW_FROM, RISK_MEDIUM_FROM = 0.80, 0.50
STRONG_FROM, MODERATE_FROM = 0.75, 0.45

# Sentences of a summary, and why a request is rejected; the braces are filled in.
SCORE_TEXT = "This lead has a {} conversion probability of {}."
STAGE_TEXT = "The lead reached the {} stage of the funnel."
POSITIVE_TEXT = "Key positive signals: {}."
NO_POSITIVE_TEXT = "No strong positive signals detected."
NEGATIVE_TEXT = "Main drag: {}."
BAD_NUMBER_TEXT = "Invalid number for '{}'."
BAD_SOURCE_TEXT = "Invalid value for 'source'. Allowed values: {}"

# Model settings.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
MODEL_SETTINGS = {
    "Logistic Regression": {"max_iter": 1000, "c": 1.0},
    "Random Forest": {"trees": 300, "depth": 10, "min_leaf": 3},
    "Gradient Boosting": {"trees": 200, "depth": 4, "rate": 0.05, "rows": 0.8},
    "Column-Sampled Boosting": {"trees": 300, "depth": 6, "rate": 0.05, "rows": 0.8, "columns": 0.8},
}

"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadspark.operators import explain, models  # noqa: E402
from leadspark.operators.features import lead_features  # noqa: E402
from leadspark.plans.registry import QUERIES  # noqa: E402
from leadspark.session import build_session  # noqa: E402
from leadspark.sources.rolemap import read_tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "lead_features", "lead_aggregates", "lead_temporal", "avg_session_gap", "lead_labels", "conversion_by_source", "funnel_conversion",
    "session_box", "monthly_patterns", "time_to_convert_summary", "temporal_hist", "correlation_matrix", "stratified_split", "auc_roc",
    "explain_top_factors", "employee_count_describe", "interactions_before_creation",
]


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        out = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    # the second run of each query counts: the first compiles its code
    for name in HEADLINE:
        for _ in range(2):
            timed(name, lambda: drain(QUERIES[name](spark, SF_DIR)))

    # load, label, featurise and split, then the four models with their full settings, one by one and in shared passes as
    # the training job fits them, and the winner's cross-validation
    t = read_tables(spark, SF_DIR)
    rows, train, test = timed("load_to_split", lambda: models.split_rows(lead_features(t.leads, t.interactions)))
    fitted = [timed(f"fit_{name.lower().replace(' ', '_').replace('-', '_')}", lambda: models.fit(name, train)) for name in models.BUILDERS]
    timed("fit_all_together", lambda: models.fit_many(list(models.BUILDERS), train))
    timed("evaluate", lambda: drain(models.evaluate(fitted, test)))
    for name in ("Random Forest", "Column-Sampled Boosting"):
        timed(f"cv_{name.lower().replace(' ', '_').replace('-', '_')}", lambda: drain(models.cv_f1(name, rows)))
    timed("explain_random_forest", lambda: drain(explain.tree_contributions(fitted[1].model, models.score(fitted[1].model, test))))
    print(json.dumps({
        "metric": "total seconds of the headline queries, second run each, and of one training", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

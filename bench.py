"""Seconds per query on one machine; prints one JSON line.

``prepare_bookings`` is the time to derive and write the bookings table, and
``customer_profiles`` and ``segment_summary`` run end to end from it. The reports
read written profiles, as they do on a cluster.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotwise.catalog import tables  # noqa: E402
from slotwise.catalog.queries import QUERIES  # noqa: E402
from slotwise.session import local_session  # noqa: E402

HEADLINE = [
    "segment_summary", "customer_profiles", "customer_history", "rfm_scores", "visit_trend",
    "features_domain", "features_fitted", "feature_matrix", "feature_ranges", "staff_rates",
    "executive_kpis", "period_delta", "noshow_trend_daily", "branch_impact",
    "branch_service_heatmap", "hour_dow_heatmap", "payment_noshow", "noshow_by", "cohort_rates",
    "dataset_summary", "risk_combos", "risk_factors", "revenue_at_risk",
    "retention_strategy_metrics", "at_risk_customers", "upgrade_opportunities", "roc_auc",
    "best_f1_threshold", "binary_metrics", "calibration_curve", "drift_numeric",
    "drift_categorical", "drift_report", "rejected_requests", "bookings_csv", "stream_history",
    "stream_noshow_rate", "model_comparison", "scored_bookings", "scored_fast",
]


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor

    seconds = {"prepare_bookings": timed(lambda: tables.bookings(spark, sf_dir))}
    seconds["prepare_profiles"] = timed(lambda: tables.profiles(spark, sf_dir))
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = timed(
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

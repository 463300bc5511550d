"""Plans keep the shape they need on large data."""

import re

import pytest

from slotwise.catalog.queries import QUERIES
from slotwise.operators import dashboard, history, profiles, retention

# queries whose frame is a lazy plan over the bookings or the profiles
LAZY = [
    "basics", "filtered_bookings", "rejected_requests", "features_rates_and_flags",
    "features_lead_and_time", "features_domain", "features_fitted", "feature_matrix", "staff_rates",
    "target_balance", "customer_history", "customer_profiles", "visit_trend", "segment_summary",
    "revenue_at_risk", "retention_strategies", "at_risk_customers", "upgrade_opportunities",
    "executive_kpis", "period_delta", "noshow_trend_weekly", "branch_service_heatmap", "noshow_by",
    "cohort_rates", "dataset_summary", "risk_combos", "risk_factors", "manual_risk",
    "class_weights", "calibration_curve", "binary_metrics", "drift_categorical", "soft_vote",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_worker(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in text


def test_profiles_take_one_shuffle(bookings):
    text = plan(profiles.customer_profiles(bookings))
    assert text.count("Exchange") == text.count("Exchange hashpartitioning(customer_id") == 1


def test_history_takes_one_shuffle(bookings):
    assert plan(history.customer_history(bookings)).count("Exchange") == 1


def test_trend_and_report_read_only_their_columns(bookings, capsys):
    profiles.visit_trend(bookings).explain("formatted")
    columns = re.findall(r"ReadSchema: struct<(.*?)>", capsys.readouterr().out)
    assert columns == ["booking_id:string,customer_id:string,booking_datetime:timestamp_ntz"]
    dashboard.payment_noshow(bookings).explain("formatted")
    columns = re.findall(r"ReadSchema: struct<(.*?)>", capsys.readouterr().out)
    assert columns == ["payment_method:string,outcome:string"]


def test_unused_profile_columns_are_pruned(bookings, capsys):
    retention.segment_summary(profiles.customer_profiles(bookings)).explain("formatted")
    text = capsys.readouterr().out
    assert "mode(" not in text and "service_duration_mins" not in text


def test_top_customers_are_not_fully_sorted(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["at_risk_customers"](spark, sf_dir))

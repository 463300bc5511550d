"""Tiers, segments, churn score and actions as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from slotwise import constants as K
from slotwise.functions.expr import any_of, at_least_one, choose, clip01, flag, half_even

C = F.col


def risk_tier(p: Column) -> Column:
    """Left-closed tiers; values outside [0, 0.7), NaN and null are CRITICAL."""
    low, medium, high = K.RISK_TIER_EDGES
    return (
        F.when((p >= 0) & (p < low), "LOW")
        .when((p >= low) & (p < medium), "MEDIUM")
        .when((p >= medium) & (p < high), "HIGH")
        .otherwise("CRITICAL")
    )


def recommended_action(tier: Column) -> Column:
    return choose(tier, K.RECOMMENDED_ACTIONS, None)


def would_flag(p: Column, threshold: float) -> Column:
    return p >= F.lit(float(threshold))


def churn_tier(score: Column) -> Column:
    return F.when(score >= 0.6, "HIGH").when(score >= 0.35, "MEDIUM").otherwise("LOW")


def manual_risk_score() -> Column:
    visits = at_least_one(C("past_visit_count"))
    return (
        C("past_noshow_count") / visits * 0.30
        + flag(C("booking_lead_time_hours") < 3) * 0.10
        + flag(C("booking_lead_time_hours") > 168) * 0.08
        + flag(C("past_visit_count") == 0) * 0.15
        + flag(C("hour_of_day") >= 18) * 0.05
        + flag(any_of(C("payment_method"), K.RISKY_PAYMENTS)) * 0.12
        + C("past_cancellation_count") / visits * 0.20
    )


def booking_segment() -> Column:
    """Dashboard rule on one booking's history; not the customer segment."""
    visits = C("past_visit_count")
    rate = C("past_noshow_count") / at_least_one(visits)
    return (
        F.when((visits >= 15) & (rate < 0.1), "VIP")
        .when(visits >= 6, "Loyal")
        .when((visits >= 1) & (rate > 0.3), "At-Risk")
        .when(visits >= 1, "Occasional")
        .otherwise("New")
    )


def visit_trend(n: Column, first_days: Column, second_days: Column) -> Column:
    """Visits per 30 days in the second half of a customer's bookings against the first."""
    half = F.floor(n / 2)
    first = half / (F.greatest(first_days, F.lit(1)) / 30)
    second = (n - half) / (F.greatest(second_days, F.lit(1)) / 30)
    return (
        F.when(n < 4, "new")
        .when(first_days.isNull() | second_days.isNull(), "stable")
        .when(second > first * 1.2, "accelerating")
        .when(second < first * 0.7, "declining")
        .otherwise("stable")
    )


def customer_segment() -> Column:
    """First match wins."""
    n, rate = C("total_bookings"), C("noshow_rate")
    days, trend = C("days_since_last_visit"), C("visit_trend")
    reliable_regular = (n >= 6) & (rate < 0.2)
    return (
        F.when((n >= 15) & (rate < 0.10) & (days < 45), "VIP")
        .when(reliable_regular & (days > 60), "At-Risk")
        .when(reliable_regular, "Loyal")
        .when((n >= 3) & (trend == "accelerating") & (rate < 0.2), "Promising")
        .when(
            (rate > 0.30) | ((n >= 4) & (trend == "declining")) | ((n >= 6) & (days > 60)),
            "At-Risk",
        )
        .when((days > 90) & (n >= 2), "Hibernating")
        .when(n >= 2, "Occasional")
        .otherwise("New")
    )


def churn_score() -> Column:
    """Null when the customer has no dated booking."""
    w, days = K.CHURN_WEIGHTS, C("days_since_last_visit")
    tenure = F.greatest(C("customer_tenure_days"), F.lit(1))
    dormant = days / F.greatest(tenure + days, F.lit(1))
    total = (
        clip01(days / 120) * w["recency"]
        + choose(C("visit_trend"), K.TREND_RISK, 0.4) * w["trend"]
        + clip01(C("noshow_rate") / 0.5) * w["noshow"]
        + clip01(C("cancellation_rate") / 0.5) * w["cancel"]
        + C("pct_risky_payment") * w["payment"]
        + clip01(dormant) * w["tenure"]
    )
    return F.when(days.isNotNull(), half_even(clip01(total), 4))


def retention_action() -> Column:
    """First match wins."""
    text, segment, churn = K.RETENTION_ACTIONS, C("segment"), C("churn_risk")
    return (
        F.when((churn == "HIGH") & segment.isin("VIP", "Loyal"), text["urgent"])
        .when(
            (C("visit_trend") == "declining") & segment.isin("VIP", "Loyal", "Promising"),
            text["declining"],
        )
        .when(C("noshow_rate") > 0.4, text["chronic"])
        .when(C("days_since_last_visit") > 60, text["dormant"])
        .when(C("pct_risky_payment") > 0.6, text["prepaid"])
        .when(churn == "MEDIUM", text["medium"])
        .otherwise(text["standard"])
    )

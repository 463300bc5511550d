"""Model features as SQL expressions, one library for batch, training and streams.

Text rather than ``Column`` calls: a frame with all features is then a few calls
to the JVM instead of thousands. Each group may use the columns of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise import constants as K


def _flag(condition: str) -> str:
    """1 or 0; a null condition counts as 0."""
    return f"coalesce(CAST({condition} AS INT), 0)"


def _one_of(column: str, names: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(name) for name in names)})"


def _table(column: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN '{name}' THEN {value}" for name, value in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


# max(visits, 1); null stays null
VISITS = "CASE WHEN past_visit_count < 1 THEN 1L ELSE past_visit_count END"

RATES = {
    "noshow_rate_historical": f"past_noshow_count / ({VISITS})",
    "cancellation_rate": f"past_cancellation_count / ({VISITS})",
    "unreliability_rate": f"(past_noshow_count + past_cancellation_count) / ({VISITS})",
}

CUSTOMER_FLAGS = {
    "is_new_customer": "past_visit_count = 0",
    "is_repeat_customer": "past_visit_count > 0",
    "is_loyal": "past_visit_count >= 8",
    "is_very_loyal": "past_visit_count >= 15",
    "is_vip": "past_visit_count >= 15 AND noshow_rate_historical < 0.1D",
    "is_chronic_nosho": "past_visit_count >= 3 AND noshow_rate_historical > 0.3D",
    "has_noshow_history": "past_noshow_count > 0",
    "has_cancel_history": "past_cancellation_count > 0",
}

LEAD_FLAGS = {
    "is_last_minute": "booking_lead_time_hours < 3",
    "is_short_notice": "booking_lead_time_hours < 6",
    "is_same_day": "booking_lead_time_hours < 24",
    "is_far_advance": "booking_lead_time_hours > 168",
    "is_very_far_advance": "booking_lead_time_hours > 336",
}

# right-closed; null and anything outside (-1, 720] fall into 3
LEAD_BUCKET = """CASE WHEN booking_lead_time_hours > -1 AND booking_lead_time_hours <= 2 THEN 0
    WHEN booking_lead_time_hours > 2 AND booking_lead_time_hours <= 6 THEN 1
    WHEN booking_lead_time_hours > 6 AND booking_lead_time_hours <= 24 THEN 2
    WHEN booking_lead_time_hours > 72 AND booking_lead_time_hours <= 168 THEN 4
    WHEN booking_lead_time_hours > 168 AND booking_lead_time_hours <= 336 THEN 5
    WHEN booking_lead_time_hours > 336 AND booking_lead_time_hours <= 720 THEN 6
    ELSE 3 END"""

TIME_FLAGS = {
    "is_weekend": "day_of_week IN (5, 6)",
    "is_monday": "day_of_week = 0",
    "is_friday": "day_of_week = 4",
    "is_evening": "hour_of_day >= 18",
    "is_late_evening": "hour_of_day >= 20",
    "is_morning": "hour_of_day <= 10",
    "is_peak_hours": "hour_of_day IN (11, 12, 17, 18)",
    "is_monsoon": "month IN (7, 8, 9)",
    "is_wedding_season": "month IN (11, 12, 1, 2)",
    "is_summer": "month IN (4, 5, 6)",
}

ORDINALS = {
    "payment_risk_encoded": _table("payment_method", K.PAYMENT_RISK, K.UNKNOWN_ORDINAL),
    "service_commitment": _table("service_type", K.SERVICE_COMMITMENT, K.UNKNOWN_ORDINAL),
    "branch_tier": _table("branch", K.BRANCH_TIER, K.UNKNOWN_ORDINAL),
}

_LOW_COMMIT = _one_of("service_type", K.LOW_COMMIT_SERVICES)
_PREMIUM = _one_of("service_type", K.PREMIUM_SERVICES)
INTERACTIONS = {
    "cash_x_new": "payment_method = 'Cash' AND past_visit_count = 0",
    "prepaid_x_loyal": "payment_method = 'Online Prepaid' AND past_visit_count >= 8",
    "cash_x_chronic": "payment_method = 'Cash' AND is_chronic_nosho = 1",
    "evening_x_low_commit": f"hour_of_day >= 18 AND {_LOW_COMMIT}",
    "evening_x_cash": "hour_of_day >= 18 AND payment_method = 'Cash'",
    "monday_morning_new": "day_of_week = 0 AND hour_of_day <= 11 AND past_visit_count = 0",
    "evening_cash_chronic": "hour_of_day >= 18 AND payment_method = 'Cash'"
    " AND noshow_rate_historical > 0.3D",
    "weekend_premium_prepaid": f"day_of_week IN (5, 6) AND {_PREMIUM}"
    " AND payment_method = 'Online Prepaid'",
}

COMPOSITES = {
    "noshow_intensity": "CASE WHEN past_visit_count >= 3 THEN noshow_rate_historical"
    " ELSE past_noshow_count * 0.3D END",
    "reliability_score": "log1p(past_visit_count) * (1 - noshow_rate_historical)",
    "risk_score_v2": "noshow_rate_historical * 0.20D + cancellation_rate * 0.10D"
    " + is_new_customer * 0.10D + payment_risk_encoded / 3 * 0.10D"
    " + is_evening * 0.05D + cash_x_new * 0.10D",
}


def month_of(columns: list[str]) -> str:
    """Month of the timestamp, else a given month, else 6."""
    candidates = []
    if "booking_datetime" in columns:
        candidates.append("month(booking_datetime)")
    if "month" in columns:
        candidates.append("CAST(month AS INT)")
    return f"coalesce({', '.join([*candidates, '6'])})"


def lead_bucket() -> Column:
    return F.expr(LEAD_BUCKET)


def add(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Add or replace columns given as SQL text, in one projection."""
    kept = [f"`{name}`" for name in df.columns if name not in expressions]
    return df.selectExpr(*kept, *[f"{sql} AS `{name}`" for name, sql in expressions.items()])


def row_features(df: DataFrame) -> DataFrame:
    """All features that depend on the row alone (no fitted table)."""
    flags = {**CUSTOMER_FLAGS, **LEAD_FLAGS, **TIME_FLAGS}
    first = add(df, {"month": month_of(df.columns), **RATES})
    second = add(
        first,
        {
            **{name: _flag(condition) for name, condition in flags.items()},
            "lead_time_bucket": LEAD_BUCKET,
            "lead_time_log": "log1p(booking_lead_time_hours)",
            **ORDINALS,
        },
    )
    third = add(second, {name: _flag(condition) for name, condition in INTERACTIONS.items()})
    return add(third, COMPOSITES)

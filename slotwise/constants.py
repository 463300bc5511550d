"""Fixed values of the booking domain.

Everything in this module is a fixed value: results are only right if the
lists, tables, thresholds and texts are exactly these.
"""

from __future__ import annotations

# --- fixed values: categories ------------------------------------------------
SERVICES = ["Haircut", "Color", "Keratin", "Facial", "Manicure", "Pedicure", "Waxing", "Bridal"]
BRANCHES = ["Science City", "Memnagar", "Sindhu Bhavan Road", "Sabarmati", "Chandkheda"]
PAYMENT_METHODS = ["Online Prepaid", "Card on Arrival", "Cash", "UPI"]
SHOW, NO_SHOW = "Show", "No-Show"
LOW_COMMIT_SERVICES = ["Manicure", "Pedicure", "Waxing"]
PREMIUM_SERVICES = ["Bridal", "Keratin", "Color"]
RISKY_PAYMENTS = ["Cash", "Card on Arrival"]
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# --- fixed values: ordinal encodings and prices ------------------------------
PAYMENT_RISK = {"Online Prepaid": 0, "UPI": 1, "Card on Arrival": 2, "Cash": 3}
SERVICE_COMMITMENT = {
    "Bridal": 6, "Keratin": 5, "Color": 4, "Facial": 3,
    "Haircut": 2, "Pedicure": 2, "Waxing": 1, "Manicure": 1,
}
BRANCH_TIER = {
    "Memnagar": 0, "Sindhu Bhavan Road": 1, "Science City": 2, "Sabarmati": 3, "Chandkheda": 4,
}
UNKNOWN_ORDINAL = 2
SERVICE_PRICE = {
    "Haircut": 1500, "Color": 4000, "Keratin": 6000, "Facial": 2500,
    "Manicure": 1000, "Pedicure": 1200, "Waxing": 800, "Bridal": 20000,
}
UNKNOWN_PRICE_RETENTION = 1800
UNKNOWN_PRICE_DASHBOARD = 1500

# --- fixed values: request limits and defaults -------------------------------
REQUEST_RANGES = {
    "booking_lead_time_hours": (0, 720),
    "day_of_week": (0, 6),
    "hour_of_day": (0, 23),
    "past_visit_count": (0, 100),
    "past_cancellation_count": (0, 50),
    "past_noshow_count": (0, 20),
    "service_duration_mins": (10, 400),
}
REQUIRED_NUMBERS = ["booking_lead_time_hours", "day_of_week", "hour_of_day"]
REQUEST_DEFAULTS = {
    "booking_lead_time_hours": 24, "day_of_week": 0, "hour_of_day": 12,
    "past_visit_count": 0, "past_cancellation_count": 0, "past_noshow_count": 0,
    "service_duration_mins": 60, "service_type": "Haircut", "branch": "Science City",
    "payment_method": "Cash", "staff_id": "S01",
}

# --- fixed values: model features, in model order ----------------------------
CATEGORICAL = ["service_type", "branch", "payment_method", "staff_id"]
RAW_NUMERIC = [
    "booking_lead_time_hours", "day_of_week", "hour_of_day",
    "past_visit_count", "past_cancellation_count", "past_noshow_count",
    "service_duration_mins",
]
FEATURE_GROUPS = {
    "raw": RAW_NUMERIC,
    "rates": ["noshow_rate_historical", "cancellation_rate", "unreliability_rate"],
    "flags": [
        "is_new_customer", "is_repeat_customer", "is_loyal", "is_very_loyal", "is_vip",
        "is_chronic_nosho", "has_noshow_history", "has_cancel_history",
    ],
    "lead": [
        "is_last_minute", "is_short_notice", "is_same_day", "is_far_advance",
        "is_very_far_advance", "lead_time_bucket", "lead_time_log",
    ],
    "temporal": [
        "is_weekend", "is_monday", "is_friday", "is_evening", "is_late_evening", "is_morning",
        "is_peak_hours", "month", "is_monsoon", "is_wedding_season", "is_summer",
    ],
    "ordinals": ["payment_risk_encoded", "service_commitment", "branch_tier"],
    "interactions": [
        "cash_x_new", "prepaid_x_loyal", "cash_x_chronic", "evening_x_low_commit",
        "evening_x_cash", "monday_morning_new", "evening_cash_chronic", "weekend_premium_prepaid",
    ],
    "composite": ["noshow_intensity", "reliability_score", "staff_noshow_rate", "risk_score_v2"],
    "labels": [
        "service_type_label", "branch_label", "payment_method_label", "staff_id_label",
    ],
}
FEATURES = [name for group in FEATURE_GROUPS.values() for name in group]
DEFAULT_GLOBAL_RATE = 0.19
STAFF_PRIOR_WEIGHT = 50

# --- fixed values: tiers, segments, churn ------------------------------------
RISK_TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
RISK_TIER_EDGES = [0.25, 0.50, 0.70]
RECOMMENDED_ACTIONS = {
    "LOW": "Standard confirmation SMS 24hrs before appointment.",
    "MEDIUM": "Send reminder SMS + WhatsApp. Offer 10% discount for prepayment.",
    "HIGH": "Call customer directly + request deposit or reschedule to prepaid.",
    "CRITICAL": "Require full prepayment OR double-book the slot. Flag for manager review.",
}
CHURN_TIERS = ["LOW", "MEDIUM", "HIGH"]
CHURN_WEIGHTS = {
    "recency": 0.25, "trend": 0.20, "noshow": 0.20, "cancel": 0.10, "payment": 0.10, "tenure": 0.15,
}
TREND_RISK = {"accelerating": 0.0, "stable": 0.2, "new": 0.4, "declining": 0.8}
VISIT_TRENDS = ["accelerating", "stable", "declining", "new"]
SEGMENTS = ["VIP", "Loyal", "Promising", "Occasional", "At-Risk", "Hibernating", "New"]
REFERENCE_DATE = "2026-03-16 00:00:00"

# --- fixed values: drift -----------------------------------------------------
DRIFT_NUMERIC = RAW_NUMERIC
DRIFT_CATEGORICAL = ["service_type", "branch", "payment_method"]
DRIFT_ALPHA = 0.05
RETRAIN_ABOVE = 0.3

# --- fixed values: reasons shown for a scored booking ------------------------
# printf patterns; the argument is a whole percent, hours, days, hour or service.
REASON_TEXT = {
    "chronic": "Chronic no-show history (%d%% of past visits)",
    "elevated": "Elevated no-show history (%d%% of past visits)",
    "new": "New customer — no booking history to assess reliability",
    "cancels": "High cancellation rate (%d%%)",
    "cash": "Cash payment — no financial commitment to attend",
    "card": "Card on arrival — no prepayment commitment",
    "lead_2": "Extremely last-minute booking (%dh lead time)",
    "lead_6": "Short-notice booking (%dh lead time)",
    "lead_336": "Very far advance booking (%d days ahead — may forget)",
    "lead_168": "Far advance booking (%d days ahead)",
    "late_evening": "Late evening slot (%d:00) — higher no-show tendency",
    "evening": "Evening appointment (%d:00)",
    "monday": "Monday booking — higher no-show tendency",
    "low_commit": "Low-commitment service (%s) — easier to skip",
    "cash_new": "⚠️ Cash payment + new customer — highest risk combination",
    "late_low_commit": "⚠️ Late evening + %s — high skip probability",
    "triple": "⚠️ Triple risk: chronic no-shower + cash + evening",
    "prepaid_premium": "✅ Prepaid + premium service — low risk combination",
    "prepaid": "✅ Online prepaid — customer financially committed",
    "vip": "✅ VIP customer — highly reliable history",
    "loyal": "✅ Loyal customer — established relationship",
    "none": "No significant risk factors identified",
}

# --- fixed values: retention actions per customer ----------------------------
RETENTION_ACTIONS = {
    "urgent": "🚨 URGENT: Personal call from salon manager. "
    "Offer complimentary premium service + priority booking.",
    "declining": "📉 Declining visits. Send personalized 'exclusive offer' "
    "WhatsApp + schedule preferred stylist.",
    "chronic": "⚠️ Chronic no-shower. Require prepayment for "
    "future bookings + automated reminder chain (48h, 24h, 2h).",
    "dormant": "💤 Dormant customer. 'We miss you' campaign: "
    "20% comeback discount + free consultation.",
    "prepaid": "💳 Migrate to prepaid: Offer 5% discount for online booking + prepayment.",
    "medium": "📱 Re-engagement: Loyalty program enrollment + 15% discount on next visit.",
    "standard": "Standard loyalty program check-in.",
}

# --- fixed values: retention strategy texts (printf patterns) ----------------
STRATEGY_TEXT = {
    "at_risk": {
        "strategy_name": "At-Risk High-Value Re-engagement",
        "target_segment": "At-Risk (%s customers)",
        "rationale": "%s%% haven't visited in 45+ days. "
        "Combined LTV at risk: ₹%s. "
        "Avg LTV per customer: ₹%s. "
        "%s%% use cash/card-on-arrival "
        "(conversion to prepaid could reduce future no-shows).",
        "suggested_action": "Tiered re-engagement: "
        "High-LTV (top 50%): Personal call from salon manager + "
        "complimentary add-on service. "
        "Others: WhatsApp campaign with 15% comeback discount + "
        "direct booking link. "
        "All: migrate to online prepayment with 5% incentive.",
        "projected_impact": "Recovering 25%% of dormant At-Risk customers could "
        "generate ₹%s in recovered revenue.",
    },
    "new": {
        "strategy_name": "New Customer → Loyal Conversion",
        "target_segment": "New (%s customers)",
        "rationale": "No-show rate for new customers: %s%% "
        "(vs %s%% overall). "
        "%s%% pay with cash. "
        "Average Loyal/VIP customer LTV: ₹%s. "
        "Converting 30%% of new customers could add "
        "₹%s in projected value.",
        "suggested_action": "First 3 Visits loyalty ladder: "
        "Visit 2 → 10% off, Visit 3 → free add-on service. "
        "Require online prepayment (reduces no-show by ~15pp). "
        "Personalized follow-up WhatsApp 5 days after first visit. "
        "Auto-suggest rebooking at checkout.",
        "projected_impact": "If 30%% of %s new customers convert to "
        "Occasional+ with avg 4 visits/year: "
        "₹%s/year in additional revenue.",
    },
    "vip_loyal": {
        "strategy_name": "VIP & Loyal Retention Shield",
        "target_segment": "VIP & Loyal (%s customers, ₹%s total LTV)",
        "rationale": "%s high-value customers show churn signals "
        "(₹%s LTV at risk). "
        "%s show declining visit frequency. "
        "Avg VIP/Loyal LTV: ₹%s — "
        "each lost customer costs %sx a single service.",
        "suggested_action": "VIP Priority Program: "
        "• Priority booking slots & dedicated stylist. "
        "• Birthday month 20% discount + surprise gift. "
        "• Quarterly exclusive preview of new services. "
        "• Manager outreach at 21+ days without visit. "
        "• Annual loyalty gift at 20+ visits/year. "
        "For declining-frequency VIPs: personal call + "
        "complimentary premium service to re-engage.",
        "projected_impact": "Preventing 50%% of at-risk VIP/Loyal churn saves "
        "₹%s in lifetime value.",
    },
    "hibernating": {
        "strategy_name": "Hibernating Customer Win-Back",
        "target_segment": "Hibernating (%s customers)",
        "rationale": "These customers averaged %s visits "
        "but haven't returned in 90+ days. "
        "Combined historical LTV: ₹%s. "
        "Win-back campaigns typically recover 10–15%% of hibernating customers.",
        "suggested_action": "Staged win-back: "
        "Week 1: 'We miss you' SMS with 20% discount. "
        "Week 3: WhatsApp with before/after portfolio. "
        "Week 5: Final offer — 30% off premium service. "
        "Non-responders: mark as churned after 6 months.",
        "projected_impact": "Recovering 12%% of %s hibernating "
        "customers: ₹%s in recovered revenue.",
    },
}

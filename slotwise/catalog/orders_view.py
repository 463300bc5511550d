"""Bookings as a plain mapping of the columns of ``orders``.

An order is a booking: its priority is the branch, keys give service, payment,
time and staff in turn, the price gives lead time and duration, and status and
price the outcome. Visits before a booking follow (order date, order key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slotwise import schema
from slotwise.plans.ordered import heavy_keys, prior_sums_given

# in the order of the remainder, or by priority
SERVICES = ["Haircut", "Color", "Keratin", "Facial", "Manicure", "Pedicure", "Waxing", "Bridal"]
PAYMENTS = ["Online Prepaid", "Card on Arrival", "Cash", "UPI"]
BRANCH_OF = {
    "1-URGENT": "Science City", "2-HIGH": "Memnagar", "3-MEDIUM": "Sindhu Bhavan Road",
    "4-NOT SPECIFIED": "Sabarmati", "5-LOW": "Chandkheda",
}


def _by_index(value: str, names: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names))
    return f"CASE {value} {whens} END"


#: The mapping, as expressions that Spark and DuckDB both read; ``div`` is integer division.
MAPPING = {
    "service_type": _by_index("o_orderkey % 8", SERVICES),
    "branch": "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRANCH_OF.items()) + " END",
    "payment_method": _by_index("(o_orderkey div 8) % 4", PAYMENTS),
    "hour_of_day": "9 + (o_orderkey div 32) % 12",
    "booking_lead_time_hours": "CAST(floor(o_totalprice) AS BIGINT) div 700",
    "service_duration_mins": "20 + CAST(floor(o_totalprice) AS BIGINT) % 161",
    "staff_no": "1 + o_custkey % 20",
    "outcome": "CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 'No-Show' ELSE 'Show' END",
    "cancelled": "CASE WHEN o_orderstatus = 'O' AND o_totalprice < 50000 THEN 1 ELSE 0 END",
}


def map_bookings(orders: DataFrame) -> DataFrame:
    mapped = orders.selectExpr(
        "o_orderkey AS k",
        "o_custkey AS c",
        "o_orderdate AS d",
        # the dates of the orders, scaled to one year
        "(CAST(datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') AS BIGINT) * 365) div 2405 AS day_no",
        *[f"{sql} AS {name}" for name, sql in MAPPING.items()],
    )
    history = prior_sums_given(
        mapped,
        ["c"],
        ["d", "k"],
        {
            "past_visit_count": F.lit(1).cast("long"),
            "past_cancellation_count": F.col("cancelled").cast("long"),
            "past_noshow_count": F.when(F.col("outcome") == "No-Show", 1).otherwise(0).cast("long"),
        },
        heavy_keys(mapped, ["c"]),
    )
    return history.selectExpr(
        "CAST(k AS STRING) AS booking_id",
        "CAST(c AS STRING) AS customer_id",
        "service_type",
        "branch",
        "TIMESTAMP_NTZ'2025-03-16 00:00:00' + make_dt_interval(0, 0,"
        " CAST(day_no * 1440 + hour_of_day * 60 + (k % 4) * 15 AS INT), 0) AS booking_datetime",
        "booking_lead_time_hours",
        "CAST((day_no + 6) % 7 AS BIGINT) AS day_of_week",
        "hour_of_day",
        "payment_method",
        "past_visit_count",
        "past_cancellation_count",
        "past_noshow_count",
        "past_visit_count > 0 AS is_repeat_customer",
        "service_duration_mins",
        "concat('S', lpad(CAST(staff_no AS STRING), 2, '0')) AS staff_id",
        "outcome",
    ).select(schema.BOOKINGS.names)

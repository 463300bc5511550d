"""One row per customer: totals, trend, RFM scores, segment and churn risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise import constants as K
from slotwise.functions import rules
from slotwise.functions.expr import any_of, at_least_one, flag, is_noshow, price, whole_days
from slotwise.plans.materialize import materialize
from slotwise.plans.ordered import TASK_ROWS, in_time, prior_sums, with_position

C = F.col

_TREND_INPUTS = {
    "_first_from": (F.min, 1),
    "_first_to": (F.max, 1),
    "_second_from": (F.min, 2),
    "_second_to": (F.max, 2),
}


def _halves() -> dict[str, Column]:
    """Extremes of the first and second half of a customer's bookings in time order."""
    in_first = C("position") <= F.floor(C("key_rows") / 2)
    half = {1: F.when(in_first, C("booking_datetime")), 2: F.when(~in_first, C("booking_datetime"))}
    return {name: extreme(half[which]) for name, (extreme, which) in _TREND_INPUTS.items()}


def _trend() -> Column:
    return rules.visit_trend(
        C("total_rows"),
        whole_days(C("_first_to"), C("_first_from")),
        whole_days(C("_second_to"), C("_second_from")),
    )


def visit_trend(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``customer_id, visit_trend``."""
    rows = df.filter(C("customer_id").isNotNull()).select("customer_id", "booking_datetime", "booking_id")
    placed = with_position(rows, ["customer_id"], in_time(), task_rows)
    ends = placed.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[value.alias(name) for name, value in _halves().items()],
    )
    return ends.select("customer_id", _trend().alias("visit_trend"))


def _totals() -> dict[str, Column]:
    ticket = price(K.UNKNOWN_PRICE_RETENTION)
    shown = C("outcome") == K.SHOW
    return {
        "total_rows": F.count(F.lit(1)),
        "total_bookings": F.count("booking_id"),
        "show_count": F.count_if(shown),
        "noshow_count": F.count_if(is_noshow()),
        "total_revenue": F.sum(F.when(shown, ticket).otherwise(0)).cast("double"),
        "avg_ticket": F.avg(ticket),
        "last_visit": F.max("booking_datetime"),
        "first_visit": F.min("booking_datetime"),
        "avg_lead_time": F.avg("booking_lead_time_hours"),
        # most frequent value, the smallest on a tie
        "primary_branch": F.mode("branch", True),
        "primary_service": F.mode("service_type", True),
        "primary_payment": F.mode("payment_method", True),
        "pct_risky_payment": F.avg(flag(any_of(C("payment_method"), K.RISKY_PAYMENTS))),
        # a set of service names, as many as the salon offers
        "unique_services": F.size(F.collect_set("service_type")).cast("long"),
        "total_duration_mins": F.sum("service_duration_mins"),
        "max_cancel_count": F.max("past_cancellation_count"),
    }


def customer_profiles(
    df: DataFrame, ref_date: str = K.REFERENCE_DATE, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Profiles with trend, segment and churn, from one shuffle on ``customer_id``.

    The window that places each booking in its customer's sequence and the
    aggregation share that shuffle. Customers too large for one task are placed
    by range partitioning and aggregated with map-side combine.
    """
    rows = df.filter(C("customer_id").isNotNull()).select(
        "customer_id", "booking_id", "booking_datetime", "service_type", "branch",
        "payment_method", "outcome", "booking_lead_time_hours", "service_duration_mins",
        "past_cancellation_count",
    )
    placed = with_position(rows, ["customer_id"], in_time(), task_rows)
    core = placed.groupBy("customer_id").agg(
        *[value.alias(name) for name, value in {**_totals(), **_halves()}.items()]
    )
    bookings = F.greatest(C("total_bookings"), F.lit(1))
    reference = F.lit(ref_date).cast("timestamp_ntz")
    derived = core.withColumns(
        {
            "noshow_rate": C("noshow_count") / bookings,
            "show_rate": C("show_count") / bookings,
            "days_since_last_visit": whole_days(reference, C("last_visit")),
            "customer_tenure_days": at_least_one(
                whole_days(C("last_visit"), C("first_visit"))
            ),
            "estimated_ltv": C("total_revenue"),
            "cancellation_rate": F.coalesce(C("max_cancel_count"), F.lit(0)) / bookings,
            "visit_trend": _trend(),
        }
    )
    months = at_least_one(C("customer_tenure_days") / 30)
    return (
        derived.drop("total_rows", *_TREND_INPUTS)
        .withColumn("visit_frequency", C("total_bookings") / months)
        .withColumn(
            "projected_annual_value",
            C("visit_frequency") * 12 * C("avg_ticket") * C("show_rate"),
        )
        .withColumns({"segment": rules.customer_segment(), "churn_score": rules.churn_score()})
        .withColumn("churn_risk", rules.churn_tier(C("churn_score")))
    )


_RFM_INPUTS = {
    "r_score": "days_since_last_visit",
    "f_score": "total_bookings",
    "m_score": "total_revenue",
}


def _long_values(cdf: DataFrame) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(score).alias("score"), C(name).cast("double").alias("value"))
            for score, name in _RFM_INPUTS.items()
        ]
    )
    return cdf.select("customer_id", F.inline(entries))


def _ranked(values: DataFrame, task_rows: int) -> DataFrame:
    one = F.lit(1).cast("long")
    placed = prior_sums(values, ["score"], ["value", "customer_id"], {"rank": one}, task_rows)
    return placed.withColumn("rank", C("rank") + 1)


def ranked_values(cdf: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``score, value, customer_id, rank``: rank from 1, ties in customer order."""
    return _ranked(_long_values(cdf), task_rows)


def rfm_scores(cdf: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``r_score``, ``f_score``, ``m_score`` (1 to 5) and the weighted ``rfm_score``.

    With N customers rank k is in bucket max(1, ceil(5(k-1)/(N-1))). Only the last
    (value, customer) of the first four buckets is looked up, twelve rows in all,
    so the profiles themselves are neither sorted nor joined. They are read twice:
    pass written ones if they are costly.
    """
    values = materialize(_long_values(cdf))
    customers = values.count() // len(_RFM_INPUTS)
    last_ranks = [bucket * (customers - 1) // 5 + 1 for bucket in range(1, 5)]
    ends = (
        _ranked(values, task_rows).filter(C("rank").isin(last_ranks)).collect()
        if customers
        else []
    )
    cuts: dict[str, dict[int, tuple]] = {name: {} for name in _RFM_INPUTS}
    for row in ends:
        cuts[row["score"]][row["rank"]] = (row["value"], row["customer_id"])

    def bucket(score: str) -> Column:
        value, total = C(_RFM_INPUTS[score]).cast("double"), F.lit(1)
        for rank in last_ranks:
            if rank in cuts[score]:
                cut_value, cut_id = cuts[score][rank]
                beyond = (value > cut_value) | ((value == cut_value) & (C("customer_id") > cut_id))
                total = total + flag(beyond)
        return total

    scored = cdf.withColumns(
        {
            "r_score": F.lit(6) - bucket("r_score"),
            "f_score": bucket("f_score"),
            "m_score": bucket("m_score"),
        }
    )
    return scored.withColumn(
        "rfm_score", C("r_score") * 0.35 + C("f_score") * 0.35 + C("m_score") * 0.30
    )

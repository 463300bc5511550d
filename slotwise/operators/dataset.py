"""Summaries of a whole bookings dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from slotwise import constants as K
from slotwise.functions.expr import any_of, is_noshow, noshow_int, price

C = F.col


def dataset_summary(df: DataFrame, approximate_customers: bool = False) -> DataFrame:
    """Totals; average price and revenue lost ignore services without a price."""
    listed = price(None)
    customers = F.approx_count_distinct if approximate_customers else F.count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(noshow_int()).alias("noshow_rate"),
        customers("customer_id").alias("customers"),
        F.to_date(F.min("booking_datetime")).alias("first_date"),
        F.to_date(F.max("booking_datetime")).alias("last_date"),
        F.avg(listed).alias("avg_price"),
        F.coalesce(F.sum(F.when(is_noshow(), listed)), F.lit(0)).alias("gross_lost"),
    )


def noshow_by(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """``dimension, value, bookings, noshow_rate, pct`` for every dimension in one pass.

    Each row becomes one (dimension, value) pair per dimension; the partial
    aggregation collapses these before the shuffle. The groups of a dimension add
    up to all bookings.
    """
    dims = dims or ["service_type", "payment_method", "branch", "day_of_week"]
    pairs = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("dimension"), C(name).cast("string").alias("value"))
                for name in dims
            ]
        )
    )
    total = F.sum("bookings").over(Window.partitionBy("dimension"))
    return (
        df.select(noshow_int().alias("noshow"), pairs)
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("bookings"), F.avg("noshow").alias("noshow_rate"))
        .withColumn("pct", C("bookings") / total * 100)
    )


def cohort_rates(df: DataFrame) -> DataFrame:
    """``cohort, bookings, noshow_rate`` for the nine named cohorts, from one scan."""
    wide = _cohort_row(df)
    rows = [
        F.struct(
            F.lit(name).alias("cohort"),
            C(f"{name}__n").alias("bookings"),
            C(name).alias("noshow_rate"),
        )
        for name in _cohorts()
    ]
    return wide.select(F.inline(F.array(*rows)))


def signal_spread(df: DataFrame) -> DataFrame:
    """Cash + new against prepaid + loyal, and how strong that signal is."""
    spread = C("cash_new") - C("prepaid_loyal")
    strength = F.when(spread > 0.15, "strong").when(spread > 0.08, "moderate").otherwise("weak")
    return _cohort_row(df).select(spread.alias("spread"), strength.alias("signal"))


def _cohorts() -> dict:
    visits, hour, day = C("past_visit_count"), C("hour_of_day"), C("day_of_week")
    cash, prepaid = C("payment_method") == "Cash", C("payment_method") == "Online Prepaid"
    return {
        "overall": F.lit(True),
        "new": visits == 0,
        "loyal": visits >= 10,
        "cash_new": cash & (visits == 0),
        "prepaid_loyal": prepaid & (visits >= 10),
        "evening_low_commit": (hour >= 19) & any_of(C("service_type"), K.LOW_COMMIT_SERVICES),
        "weekend_prepaid_premium": day.isin(5, 6)
        & prepaid
        & any_of(C("service_type"), K.PREMIUM_SERVICES),
        "monday_morning": (day == 0) & (hour <= 11),
        "monsoon": F.month("booking_datetime").isin(7, 8, 9),
    }


def _cohort_row(df: DataFrame) -> DataFrame:
    aggregates = []
    for name, condition in _cohorts().items():
        aggregates += [
            F.count_if(condition).alias(f"{name}__n"),
            F.avg(F.when(condition, noshow_int())).alias(name),
        ]
    return df.agg(*aggregates)


def peak_times(df: DataFrame) -> DataFrame:
    """First, last and most frequent hour and the most frequent weekday (smallest on a tie)."""
    busiest_day = F.mode("day_of_week", True)
    names = F.array(*[F.lit(name) for name in K.WEEKDAY_NAMES])
    return df.agg(
        F.min("hour_of_day").alias("first_hour"),
        F.max("hour_of_day").alias("last_hour"),
        F.mode("hour_of_day", True).alias("peak_hour"),
        busiest_day.alias("peak_day"),
    ).withColumn("peak_day_name", F.get(names, C("peak_day").cast("int")))


def risk_combos(df: DataFrame, k: int = 5, min_n: int = 20) -> DataFrame:
    """The ``k`` branch and service pairs with the highest and the lowest no-show rate."""
    cells = (
        df.groupBy("branch", "service_type")
        .agg(F.avg(noshow_int()).alias("noshow_rate"), F.count(F.lit(1)).alias("bookings"))
        .filter(C("bookings") >= min_n)
    )
    names = ["branch", "service_type"]
    highest = cells.orderBy(F.desc("noshow_rate"), *names).limit(k)
    lowest = cells.orderBy("noshow_rate", *names).limit(k)
    return highest.withColumn("side", F.lit("highest")).unionByName(
        lowest.withColumn("side", F.lit("lowest"))
    )

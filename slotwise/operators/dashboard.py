"""No-show, revenue and mix reports over bookings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from slotwise import constants as K
from slotwise.functions import rules
from slotwise.functions.expr import is_noshow, noshow_int, price
from slotwise.operators.cleaning import date_range, filter_bookings
from slotwise.operators.retention import _zero_filled
from slotwise.plans.materialize import written

C = F.col
HIGH_RISK_ABOVE = 0.35


def executive_kpis(df: DataFrame) -> DataFrame:
    lost = F.when(is_noshow(), price(K.UNKNOWN_PRICE_DASHBOARD))
    return df.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        (F.avg(noshow_int()) * 100).alias("noshow_pct"),
        F.count_if(is_noshow()).alias("noshow_count"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("revenue_lost"),
        F.count_if(rules.manual_risk_score() > HIGH_RISK_ABOVE).alias("high_risk_count"),
    )


def period_delta(
    df: DataFrame,
    first_day: str,
    last_day: str,
    branches: list[str] | None = None,
    services: list[str] | None = None,
) -> DataFrame:
    """No-show percent of the window against the window of equal length before it.

    Both windows come from one scan; without earlier bookings the delta is 0.
    """
    start, stop = date.fromisoformat(first_day), date.fromisoformat(last_day)
    before = start - (stop - start)
    current = date_range(first_day, last_day)
    previous = date_range(str(before), str(start - timedelta(days=1)))
    rows = filter_bookings(df, str(before), last_day, branches, services)
    rates = rows.agg(
        (F.avg(F.when(current, noshow_int())) * 100).alias("noshow_pct"),
        (F.avg(F.when(previous, noshow_int())) * 100).alias("previous"),
    )
    return rates.select(
        "noshow_pct",
        F.coalesce("previous", "noshow_pct").alias("previous_pct"),
        (C("noshow_pct") - F.coalesce("previous", "noshow_pct")).alias("delta"),
    )


def noshow_trend(df: DataFrame, unit: str = "day") -> DataFrame:
    """Per day or per week (weeks start on Monday)."""
    if unit not in ("day", "week"):
        raise ValueError("unit must be 'day' or 'week'")
    day = F.to_date("booking_datetime")
    period = day if unit == "day" else F.date_sub(day, F.weekday(day))
    per = df.groupBy(period.alias("period")).agg(
        F.count("outcome").alias("total"), F.sum(noshow_int()).alias("noshows")
    )
    return per.withColumn(
        "noshow_pct", F.when(C("total") > 0, C("noshows") / C("total") * 100)
    ).orderBy("period")


def branch_impact(df: DataFrame) -> DataFrame:
    return (
        df.filter(is_noshow())
        .groupBy("branch")
        .agg(
            F.count(F.lit(1)).alias("noshows"),
            F.sum(price(K.UNKNOWN_PRICE_DASHBOARD)).alias("revenue_lost"),
        )
        .orderBy("revenue_lost", "branch")
    )


def with_manual_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_score", rules.manual_risk_score()).withColumn(
        "risk_tier", rules.risk_tier(C("risk_score"))
    )


def risk_tier_distribution(df: DataFrame) -> DataFrame:
    return _zero_filled(with_manual_risk(df), "risk_tier", K.RISK_TIERS, "bookings")


def branch_service_heatmap(df: DataFrame, min_n: int = 20) -> DataFrame:
    """Rate per branch and service, null below ``min_n`` bookings; services ranked by mean rate."""
    cells = df.groupBy("branch", "service_type").agg(
        F.avg(noshow_int()).alias("rate"), F.count(F.lit(1)).alias("bookings")
    )
    shown = cells.withColumn("noshow_rate", F.when(C("bookings") >= min_n, C("rate"))).drop("rate")
    # one row per branch x service: a few dozen
    return shown.withColumn(
        "service_mean", F.avg("noshow_rate").over(Window.partitionBy("service_type"))
    )


def branch_service_pivot(df: DataFrame, min_n: int = 20) -> DataFrame:
    """One column per known service, from the lowest to the highest mean rate.

    Other values of ``service_type`` stay in ``branch_service_heatmap``.
    """
    cells = written(branch_service_heatmap(df, min_n).filter(C("service_type").isin(*K.SERVICES)))
    means = cells.select("service_type", "service_mean").distinct().collect()  # at most the known ones
    ranked = sorted(
        means,
        key=lambda row: (row["service_mean"] is None, row["service_mean"] or 0, row["service_type"]),
    )
    order = [row["service_type"] for row in ranked]
    wide = cells.groupBy("branch").pivot("service_type", order).agg(F.first("noshow_rate"))
    return wide.orderBy("branch")


def hour_dow_heatmap(df: DataFrame) -> DataFrame:
    wide = df.groupBy("hour_of_day").pivot("day_of_week", list(range(7))).agg(F.avg(noshow_int()))
    names = {str(i): name for i, name in enumerate(K.WEEKDAY_NAMES)}
    return wide.withColumnsRenamed(names).orderBy("hour_of_day")


def repeat_vs_new(df: DataFrame) -> DataFrame:
    return df.groupBy("is_repeat_customer").agg(F.count(F.lit(1)).alias("bookings"))


def lead_time_histogram(df: DataFrame, width: float = 12.0, low: float = 0.0) -> DataFrame:
    """Bookings per bin of ``width`` hours; 12 hours give 60 bins over 30 days."""
    number = F.floor((C("booking_lead_time_hours") - low) / width).cast("long")
    return (
        df.filter(C("booking_lead_time_hours").isNotNull())
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("bookings"))
        .withColumn("bin_start", C("bin") * width + low)
        .orderBy("bin")
    )


def payment_noshow(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("payment_method")
        .agg(F.avg(noshow_int()).alias("noshow_rate"), F.count(F.lit(1)).alias("bookings"))
        .withColumn("noshow_pct", C("noshow_rate") * 100)
        .orderBy("noshow_pct", "payment_method")
    )


def booking_segment_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(rules.booking_segment().alias("segment")).agg(
        F.count(F.lit(1)).alias("bookings")
    )


def filter_options(df: DataFrame) -> DataFrame:
    """``option, value``: branches, services and the first and last booking date."""
    groups = written(
        df.groupBy("branch", "service_type").agg(
            F.to_date(F.min("booking_datetime")).cast("string").alias("first"),
            F.to_date(F.max("booking_datetime")).cast("string").alias("last"),
        )
    )
    names = groups.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("option"), C(n).alias("value")) for n in ("branch", "service_type")]))
    ).distinct()
    dates = groups.agg(F.min("first").alias("first_date"), F.max("last").alias("last_date")).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("option"), C(n).alias("value")) for n in ("first_date", "last_date")]))
    )
    return names.unionByName(dates)


# --- reports that are described but have no code in the original dashboard ----


def last_days(df: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Bookings of the rolling training window."""
    end = F.lit(as_of).cast("date").cast("timestamp_ntz")
    start = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    return df.filter((C("booking_datetime") >= start) & (C("booking_datetime") < end))


def upcoming_high_risk(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Bookings of the next days whose manual risk tier is HIGH or CRITICAL."""
    start = F.lit(as_of).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    upcoming = df.filter((C("booking_datetime") >= start) & (C("booking_datetime") < end))
    return with_manual_risk(upcoming).filter(C("risk_tier").isin("HIGH", "CRITICAL"))


def revenue_recovery(
    df: DataFrame, slot_recovery: float = 0.35, intervention: float = 0.40
) -> DataFrame:
    """Revenue lost before and after refilled slots, and what intervention would save."""
    kpis = executive_kpis(df).select(C("revenue_lost").alias("gross_lost"))
    return kpis.withColumn("net_lost", C("gross_lost") * (1 - slot_recovery)).withColumn(
        "recovered", C("net_lost") * intervention
    )


def noshow_by_derived(df: DataFrame) -> DataFrame:
    """No-show rate by lead-time bucket, month and visit tier, in one pass."""
    from slotwise.functions.features import lead_bucket

    visits = C("past_visit_count")
    tier = (
        F.when(visits == 0, "0").when(visits < 3, "1-2").when(visits < 8, "3-7")
        .when(visits < 15, "8-14").otherwise("15+")
    )
    dims = {
        "lead_bucket": lead_bucket().cast("string"),
        "month": F.month("booking_datetime").cast("string"),
        "visit_tier": tier,
    }
    pairs = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("dimension"), value.alias("value"))
                for name, value in dims.items()
            ]
        )
    )
    return (
        df.select(noshow_int().alias("noshow"), pairs)
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("bookings"), F.avg("noshow").alias("noshow_rate"))
    )


def noshow_correlation(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each numeric column with no-show, in one pass."""
    names = names or K.RAW_NUMERIC
    wide = df.agg(
        *[
            F.corr(C(name).cast("double"), noshow_int().cast("double")).alias(name)
            for name in names
        ]
    )
    rows = [F.struct(F.lit(n).alias("feature"), C(n).alias("correlation")) for n in names]
    return wide.select(F.inline(F.array(*rows)))

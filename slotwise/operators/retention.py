"""Reports over customer profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise import constants as K
from slotwise.functions import rules
from slotwise.functions.expr import half_even

C = F.col


def _overall(column: str) -> Column:
    """Sum over all rows of a report by segment, trend or churn tier: at most seven rows."""
    return F.sum(column).over(Window.partitionBy())


def segment_summary(cdf: DataFrame) -> DataFrame:
    averages = {
        "avg_visits": "total_bookings",
        "avg_noshow_rate": "noshow_rate",
        "avg_ltv": "estimated_ltv",
        "avg_days_since_visit": "days_since_last_visit",
        "avg_churn_score": "churn_score",
        "avg_visit_frequency": "visit_frequency",
        "avg_ticket": "avg_ticket",
    }
    summary = cdf.groupBy("segment").agg(
        F.count("customer_id").alias("count"),
        *[half_even(F.avg(source), 2).alias(name) for name, source in averages.items()],
        half_even(F.sum("estimated_ltv"), 2).alias("total_ltv"),
        half_even(F.avg((C("churn_risk") == "HIGH").cast("int")), 2).alias("pct_high_churn"),
    )
    return summary.withColumns(
        {
            "pct_of_customers": half_even(C("count") / _overall("count") * 100, 1),
            # of the already rounded totals
            "pct_of_revenue": half_even(
                F.when(
                    _overall("total_ltv") > 0,
                    C("total_ltv") / _overall("total_ltv") * 100,
                ),
                1,
            ),
        }
    )


def _sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def revenue_at_risk(cdf: DataFrame) -> DataFrame:
    high, medium = C("churn_risk") == "HIGH", C("churn_risk") == "MEDIUM"
    ltv = C("estimated_ltv")
    return cdf.agg(
        F.count_if(high).alias("high_risk_customers"),
        _sum_where(high, ltv).alias("high_risk_ltv"),
        _sum_where(high, C("projected_annual_value")).alias("high_risk_annual_value"),
        F.count_if(medium).alias("medium_risk_customers"),
        _sum_where(medium, ltv).alias("medium_risk_ltv"),
        _sum_where(high | medium, ltv).alias("total_at_risk_ltv"),
    )


def retention_strategy_metrics(cdf: DataFrame) -> DataFrame:
    """One row with the numbers behind the four strategies; empty groups give 0."""
    segment, ltv = C("segment"), C("estimated_ltv")
    at_risk, new, hibernating = segment == "At-Risk", segment == "New", segment == "Hibernating"
    top = segment.isin("VIP", "Loyal")
    top_churning = top & C("churn_risk").isin("MEDIUM", "HIGH")

    def mean(condition, value):
        return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))

    base = cdf.agg(
        F.count_if(at_risk).alias("at_risk_customers"),
        _sum_where(at_risk, ltv).alias("at_risk_ltv"),
        mean(at_risk, ltv).alias("at_risk_avg_ltv"),
        F.count_if(at_risk & (C("days_since_last_visit") > 45)).alias("at_risk_dormant"),
        (mean(at_risk, C("pct_risky_payment")) * 100).alias("at_risk_risky_payment_pct"),
        F.count_if(new).alias("new_customers"),
        mean(new, C("noshow_rate")).alias("new_noshow_rate"),
        (mean(new, C("pct_risky_payment")) * 100).alias("new_cash_pct"),
        F.avg("noshow_rate").alias("overall_noshow_rate"),
        F.avg("avg_ticket").alias("overall_avg_ticket"),
        F.count_if(top).alias("vip_loyal_customers"),
        _sum_where(top, ltv).alias("vip_loyal_ltv"),
        mean(top, ltv).alias("vip_loyal_avg_ltv"),
        F.count_if(top_churning).alias("vip_loyal_churning"),
        _sum_where(top_churning, ltv).alias("vip_loyal_churning_ltv"),
        F.count_if(top & (C("visit_trend") == "declining")).alias("vip_loyal_declining"),
        F.count_if(hibernating).alias("hibernating_customers"),
        mean(hibernating, C("total_bookings")).alias("hibernating_avg_visits"),
        mean(hibernating, ltv).alias("hibernating_avg_ltv"),
        _sum_where(hibernating, ltv).alias("hibernating_ltv"),
    )
    return base.withColumns(
        {
            "at_risk_dormant_pct": C("at_risk_dormant")
            / F.greatest(C("at_risk_customers"), F.lit(1))
            * 100,
            # projected impacts, truncated to whole currency units
            "at_risk_recovered": (C("at_risk_ltv") * 0.25).cast("long"),
            "new_converted_value": (
                C("new_customers") * 0.3 * C("vip_loyal_avg_ltv") * 0.3
            ).cast("long"),
            "new_yearly_revenue": (
                C("new_customers") * 0.3 * 4 * F.coalesce("overall_avg_ticket", F.lit(0.0))
            ).cast("long"),
            "vip_loyal_saved": (C("vip_loyal_churning_ltv") * 0.5).cast("long"),
            "hibernating_recovered": (C("hibernating_ltv") * 0.12).cast("long"),
        }
    )


def retention_strategies(cdf: DataFrame) -> DataFrame:
    """Three or four rows of text; the last only if some customers hibernate."""

    def whole(name):
        return F.format_number(C(name), 0)

    def percent(value):
        return F.format_number(value, 0)

    arguments = {
        "at_risk": {
            "target_segment": [whole("at_risk_customers")],
            "rationale": [
                percent(C("at_risk_dormant_pct")), whole("at_risk_ltv"),
                whole("at_risk_avg_ltv"), percent(C("at_risk_risky_payment_pct")),
            ],
            "projected_impact": [whole("at_risk_recovered")],
        },
        "new": {
            "target_segment": [whole("new_customers")],
            "rationale": [
                percent(C("new_noshow_rate") * 100), percent(C("overall_noshow_rate") * 100),
                percent(C("new_cash_pct")), whole("vip_loyal_avg_ltv"),
                whole("new_converted_value"),
            ],
            "projected_impact": [C("new_customers").cast("string"), whole("new_yearly_revenue")],
        },
        "vip_loyal": {
            "target_segment": [whole("vip_loyal_customers"), whole("vip_loyal_ltv")],
            "rationale": [
                C("vip_loyal_churning").cast("string"), whole("vip_loyal_churning_ltv"),
                C("vip_loyal_declining").cast("string"), whole("vip_loyal_avg_ltv"),
                F.rint(C("vip_loyal_avg_ltv") / K.UNKNOWN_PRICE_RETENTION)
                .cast("long")
                .cast("string"),
            ],
            "projected_impact": [whole("vip_loyal_saved")],
        },
        "hibernating": {
            "target_segment": [whole("hibernating_customers")],
            "rationale": [F.format_number("hibernating_avg_visits", 1), whole("hibernating_ltv")],
            "projected_impact": [
                C("hibernating_customers").cast("string"),
                whole("hibernating_recovered"),
            ],
        },
    }
    rows = []
    for position, (key, texts) in enumerate(K.STRATEGY_TEXT.items(), 1):
        fields = [F.lit(position).alias("position")]
        for name, pattern in texts.items():
            values = arguments[key].get(name)
            text = F.format_string(pattern, *values) if values else F.lit(pattern)
            fields.append(text.alias(name))
        size = C("hibernating_customers") if key == "hibernating" else F.lit(1).cast("long")
        fields.append(size.alias("size"))
        rows.append(F.struct(*fields))
    return (
        retention_strategy_metrics(cdf)
        .select(F.inline(F.array(*rows)))
        .filter(C("size") > 0)
        .drop("size")
        .orderBy("position")
    )


def _zero_filled(df: DataFrame, column: str, names: list[str], count: str) -> DataFrame:
    """Counts per fixed name in one aggregation; absent names get 0."""
    counted = df.agg(*[F.count_if(C(column) == name).alias(name) for name in names])
    rows = [F.struct(F.lit(name).alias(column), C(f"`{name}`").alias(count)) for name in names]
    return counted.select(F.inline(F.array(*rows)))


def churn_distribution(cdf: DataFrame) -> DataFrame:
    return _zero_filled(cdf, "churn_risk", K.CHURN_TIERS, "customers")


def segment_breakdown(cdf: DataFrame) -> DataFrame:
    per = cdf.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("estimated_ltv").alias("avg_ltv")
    )
    return per.withColumn("pct", C("customers") / _overall("customers") * 100)


def trend_breakdown(cdf: DataFrame) -> DataFrame:
    per = _zero_filled(cdf, "visit_trend", K.VISIT_TRENDS, "customers")
    total = _overall("customers")
    return per.withColumn("pct", F.when(total > 0, C("customers") / total * 100))


def overall_kpis(cdf: DataFrame) -> DataFrame:
    return cdf.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("estimated_ltv").alias("avg_ltv"),
        F.coalesce(F.sum("estimated_ltv"), F.lit(0.0)).alias("total_ltv"),
        F.avg("noshow_rate").alias("avg_noshow_rate"),
    )


def with_recovery_priority(cdf: DataFrame) -> DataFrame:
    """HIGH and MEDIUM churn customers with ``recovery_priority`` and an action."""
    candidates = cdf.filter(C("churn_risk").isin("HIGH", "MEDIUM"))
    highest = candidates.agg(F.greatest(F.max("estimated_ltv"), F.lit(1.0))).scalar()
    return candidates.withColumns(
        {
            "recovery_priority": C("churn_score") * 0.5 + C("estimated_ltv") / highest * 0.5,
            "suggested_action": rules.retention_action(),
        }
    )


def at_risk_customers(cdf: DataFrame, n: int = 20) -> DataFrame:
    return (
        with_recovery_priority(cdf)
        .orderBy(F.desc("recovery_priority"), "customer_id")
        .limit(n)
    )


def upgrade_opportunities(cdf: DataFrame) -> DataFrame:
    """Customers close to the next segment, fewest missing visits first."""
    n, rate = C("total_bookings"), C("noshow_rate")
    to_loyal = (C("segment") == "Occasional") & (n >= 4) & (rate < 0.2)
    to_vip = (C("segment") == "Loyal") & (n >= 12) & (rate < 0.15)
    goal = F.when(to_loyal, 6).when(to_vip, 15)
    return (
        cdf.withColumns(
            {
                "upgrade_target": F.when(to_loyal, "Loyal").when(to_vip, "VIP"),
                "visits_needed": F.greatest(goal - n, F.lit(1)),
            }
        )
        .filter(C("upgrade_target").isNotNull())
        .orderBy("visits_needed", "customer_id")
    )


def churn_histogram(cdf: DataFrame) -> DataFrame:
    """Customers per tenth of the churn score."""
    tenth = F.least(F.floor(C("churn_score") * 10), F.lit(9)).cast("long")
    return cdf.groupBy(tenth.alias("score_bin")).agg(F.count(F.lit(1)).alias("customers"))


def rfm_points(scored: DataFrame) -> DataFrame:
    """Data of the recency / frequency / monetary scatter, from scored profiles."""
    return scored.select(
        "customer_id", "segment", "days_since_last_visit", "total_bookings", "total_revenue",
        "r_score", "f_score", "m_score", "rfm_score",
    )

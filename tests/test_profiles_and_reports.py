import pytest
from pyspark.sql import functions as F

from slotwise import constants as K
from slotwise.operators import dashboard, dataset, profiles, retention

REF = "2025-12-31 00:00:00"


def visits(customer, days, month="2025-12", **fields):
    """One booking per day number of the month, at noon."""
    return [
        dict(customer_id=customer, booking_datetime=f"{month}-{day:02d} 12:00:00", **fields)
        for day in days
    ]


def profile(make, rows):
    return {r["customer_id"]: r for r in profiles.customer_profiles(make(*rows), REF).collect()}


def test_new_customer_gets_segment_new(make):
    row = profile(make, visits("N", [30]))["N"]
    assert (row["segment"], row["visit_trend"], row["customer_tenure_days"]) == ("New", "new", 1)
    assert row["visit_frequency"] == 1.0 and row["days_since_last_visit"] == 0


def test_segments_by_rule(make):
    rows = (
        visits("vip", range(1, 17))
        + visits("loyal", range(1, 31, 5))
        + visits("dormant", range(1, 31, 5), month="2025-09")
        + visits("risky", [1, 20], outcome="No-Show")
        + visits("asleep", [1, 20], month="2025-06")
        + visits("rare", [1, 20])
    )
    found = {k: r["segment"] for k, r in profile(make, rows).items()}
    assert found == {
        "vip": "VIP", "loyal": "Loyal", "dormant": "At-Risk", "risky": "At-Risk",
        "asleep": "Hibernating", "rare": "Occasional",
    }


def test_trend_compares_halves(make):
    rows = visits("up", [1, 15, 20, 21]) + visits("down", [1, 2, 10, 28]) + visits("few", [1, 2, 3])
    found = {k: r["visit_trend"] for k, r in profile(make, rows).items()}
    assert found == {"up": "accelerating", "down": "declining", "few": "new"}


def test_favourites_take_the_smallest_on_a_tie_and_unknown_services_a_default_price(make):
    row = profile(
        make,
        [dict(customer_id="A", service_type="Waxing"), dict(customer_id="A", service_type="Color"),
         dict(customer_id="A", service_type="Massage", outcome="No-Show")],
    )["A"]
    assert row["primary_service"] == "Color" and row["unique_services"] == 3
    assert row["total_revenue"] == 4800 and row["avg_ticket"] == (800 + 4000 + 1800) / 3


def test_bookings_without_customer_are_left_out(make):
    assert set(profile(make, [dict(customer_id=None), dict(customer_id="A")])) == {"A"}


def test_churn_score_parts(make):
    row = profile(make, visits("C", [1], month="2025-06", payment_method="Cash", outcome="No-Show"))["C"]
    days = row["days_since_last_visit"]
    expected = 0.25 + 0.4 * 0.20 + 0.20 + 0.10 + days / (1 + days) * 0.15
    assert row["churn_score"] == pytest.approx(round(expected, 4))
    assert row["churn_risk"] == "HIGH"


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 11, 24, 25, 26])
def test_quintiles_by_rank(make, size):
    rows = [r for i in range(size) for r in visits(f"C{i:03d}", [1 + i])]
    scored = profiles.rfm_scores(profiles.customer_profiles(make(*rows), REF))
    found = [r["f_score"] for r in scored.orderBy("customer_id").collect()]
    expected = [1 if size == 1 else max(1, -(-5 * rank // (size - 1))) for rank in range(size)]
    assert found == expected
    recency = [r["r_score"] for r in scored.orderBy("customer_id").collect()]
    assert recency == [6 - b for b in expected][::-1] if size > 1 else recency == [5]


def test_reports_on_no_customers(make):
    empty = profiles.customer_profiles(make({}).limit(0))
    assert retention.segment_summary(empty).count() == 0
    assert profiles.rfm_scores(empty).count() == 0
    assert retention.at_risk_customers(empty).count() == 0
    row = retention.revenue_at_risk(empty).first()
    assert row["high_risk_customers"] == 0 and row["total_at_risk_ltv"] == 0.0
    assert [r["customers"] for r in retention.churn_distribution(empty).collect()] == [0, 0, 0]


def test_strategies_have_a_fourth_row_only_with_hibernating_customers(make):
    awake = profiles.customer_profiles(make(*visits("A", [1, 20])), REF)
    assert retention.retention_strategies(awake).count() == 3
    asleep = profiles.customer_profiles(make(*visits("A", [1, 20], month="2025-06")), REF)
    rows = retention.retention_strategies(asleep).collect()
    assert [r["position"] for r in rows] == [1, 2, 3, 4]
    assert rows[3]["target_segment"] == "Hibernating (1 customers)"
    assert "averaged 2.0 visits" in rows[3]["rationale"]
    assert rows[0]["projected_impact"].endswith("generate ₹0 in recovered revenue.")


def test_top_at_risk_is_ordered_and_limited(spark, sf_dir):
    from slotwise.catalog import tables

    rows = retention.at_risk_customers(tables.profiles(spark, sf_dir), 5).collect()
    priorities = [r["recovery_priority"] for r in rows]
    assert len(rows) == 5 and priorities == sorted(priorities, reverse=True)
    assert all(r["suggested_action"] in K.RETENTION_ACTIONS.values() for r in rows)


def test_empty_previous_period_gives_no_change(make):
    row = dashboard.period_delta(make(dict(outcome="No-Show")), "2025-06-01", "2025-06-30").first()
    assert (row["noshow_pct"], row["previous_pct"], row["delta"]) == (100.0, 100.0, 0.0)


def test_week_starts_on_monday(make):
    df = dashboard.noshow_trend(make(dict(booking_datetime="2025-06-08 10:00:00")), "week")
    assert str(df.first()["period"]) == "2025-06-02"
    with pytest.raises(ValueError):
        dashboard.noshow_trend(make({}), "month")


def test_small_cells_have_no_rate(make):
    row = dashboard.branch_service_heatmap(make(*[{}] * 19)).first()
    assert row["bookings"] == 19 and row["noshow_rate"] is None
    assert dashboard.branch_service_heatmap(make(*[{}] * 20)).first()["noshow_rate"] == 0.0


def test_every_dimension_adds_up(bookings):
    total = bookings.count()
    sums = dataset.noshow_by(bookings).groupBy("dimension").agg(
        F.sum("bookings").alias("n"), F.round(F.sum("pct"), 6).alias("p")
    )
    assert {(r["n"], r["p"]) for r in sums.collect()} == {(total, 100.0)}


def test_booking_segment_differs_from_customer_segment(make):
    df = make(
        dict(past_visit_count=15, past_noshow_count=1), dict(past_visit_count=6, past_noshow_count=6),
        dict(past_visit_count=1, past_noshow_count=1), dict(past_visit_count=2), {},
    )
    counts = dashboard.booking_segment_distribution(df).collect()
    assert {r["segment"] for r in counts} == {"VIP", "Loyal", "At-Risk", "Occasional", "New"}


def test_undated_bookings_come_last_and_undated_customers_have_no_score(make):
    rows = visits("A", [1, 15, 20, 21]) + [dict(customer_id="A", booking_datetime=None)] * 2
    rows += [dict(customer_id="U", booking_datetime=None)] * 6
    found = profile(make, rows)
    # halves are days 1, 15, 20 and day 21 with the two undated ones
    assert found["A"]["visit_trend"] == "accelerating" and found["A"]["total_bookings"] == 6
    undated = found["U"]
    assert (undated["visit_trend"], undated["segment"]) == ("stable", "Loyal")
    assert undated["churn_score"] is None and undated["churn_risk"] == "LOW"
    assert undated["visit_frequency"] is None and undated["customer_tenure_days"] is None


def test_undated_bookings_follow_the_dated_ones_in_history(make):
    from slotwise.operators.history import customer_history

    rows = [dict(customer_id="A", booking_datetime=None, outcome="No-Show")] + visits("A", [1, 2])
    found = {r["booking_id"]: r["prior_visits"] for r in customer_history(make(*rows)).collect()}
    assert found == {"B000": 2, "B001": 0, "B002": 1}

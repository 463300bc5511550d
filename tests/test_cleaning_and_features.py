import math

import pytest
from pyspark.sql import functions as F

from slotwise import constants as K
from slotwise.functions import rules
from slotwise.functions.expr import half_even, whole_days
from slotwise.functions.features import lead_bucket, row_features
from slotwise.operators import cleaning, features


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_there_are_55_features_in_model_order():
    names = features.feature_list()
    assert len(names) == len(set(names)) == 55
    assert names[0] == "booking_lead_time_hours" and names[-1] == "staff_id_label"
    assert names.index("staff_noshow_rate") == names.index("reliability_score") + 1


@pytest.mark.parametrize(
    "lead,bucket",
    [(None, 3), (-1, 3), (0, 0), (2, 0), (3, 1), (6, 1), (7, 2), (24, 2), (25, 3), (72, 3),
     (73, 4), (168, 4), (169, 5), (336, 5), (337, 6), (720, 6), (721, 3)],
)
def test_lead_bucket(spark, lead, bucket):
    df = spark.createDataFrame([(lead,)], "booking_lead_time_hours long")
    assert df.select(lead_bucket()).first()[0] == bucket


@pytest.mark.parametrize(
    "p,tier",
    [(0.0, "LOW"), (0.2499, "LOW"), (0.25, "MEDIUM"), (0.5, "HIGH"), (0.6999, "HIGH"),
     (0.7, "CRITICAL"), (1.0, "CRITICAL"), (-0.1, "CRITICAL"), (float("nan"), "CRITICAL"),
     (None, "CRITICAL")],
)
def test_risk_tier(spark, p, tier):
    df = spark.createDataFrame([(p,)], "p double")
    found = df.select(rules.risk_tier(F.col("p")).alias("t")).select(
        "t", rules.recommended_action(F.col("t"))
    )
    assert tuple(found.first()) == (tier, K.RECOMMENDED_ACTIONS[tier])


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125, 2.5)], "a double, b double")
    assert one(df.select(half_even(F.col("a"), 2).alias("a"), half_even(F.col("b"), 0).alias("b")),
               "a", "b") == (0.12, 2.0)


@pytest.mark.parametrize(
    "later,earlier,days",
    [("2025-01-03 01:00:00", "2025-01-01 02:00:00", 1), ("2025-01-01 01:00:00", "2025-01-01 02:00:00", -1),
     ("2025-01-03 00:00:00", "2025-01-01 00:00:00", 2), ("2025-03-30 12:00:00", "2025-03-29 12:00:00", 1)],
)
def test_whole_days_floor(spark, later, earlier, days):
    when = [F.lit(t).cast("timestamp_ntz") for t in (later, earlier)]
    assert spark.range(1).select(whole_days(*when)).first()[0] == days


def test_row_features_of_named_bookings(make):
    df = row_features(
        make(
            dict(service_type="Pedicure", branch="Chandkheda", booking_lead_time_hours=1,
                 hour_of_day=20, payment_method="Cash", past_visit_count=8,
                 past_cancellation_count=4, past_noshow_count=5),
            dict(service_type="Bridal", day_of_week=6, payment_method="Online Prepaid",
                 past_visit_count=20),
            dict(service_type="Massage", branch="Elsewhere", payment_method="Barter"),
        )
    ).orderBy("booking_id").collect()
    chronic, safe, unknown = df
    assert chronic["noshow_rate_historical"] == 5 / 8 and chronic["is_chronic_nosho"] == 1
    assert chronic["evening_cash_chronic"] == chronic["evening_x_low_commit"] == 1
    assert chronic["cash_x_chronic"] == 1 and chronic["cash_x_new"] == 0
    assert safe["is_vip"] == safe["weekend_premium_prepaid"] == safe["prepaid_x_loyal"] == 1
    assert safe["reliability_score"] == pytest.approx(math.log(21))
    assert unknown["payment_risk_encoded"] == unknown["service_commitment"] == 2
    assert unknown["branch_tier"] == 2


def test_null_inputs_give_zero_flags(make):
    row = row_features(make(dict(past_visit_count=None, day_of_week=None, payment_method=None))).first()
    assert row["is_new_customer"] == row["is_monday"] == row["cash_x_new"] == 0
    assert row["noshow_rate_historical"] is None


def test_month_from_timestamp_then_field_then_june(make):
    base = make(dict(booking_datetime="2025-11-05 10:00:00"))
    assert row_features(base).first()["month"] == 11
    bare = base.drop("booking_datetime")
    assert row_features(bare.withColumn("month", F.lit(8))).first()["month"] == 8
    assert row_features(bare).first()["month"] == 6


def test_staff_rates_are_smoothed_and_unknown_staff_gets_the_overall_rate(make):
    df = make(*[dict(staff_id="S01", outcome="No-Show")] * 2, *[dict(staff_id="S02")] * 6)
    rates = {r["staff_id"]: r["staff_noshow_rate"] for r in features.fit_staff_rates(df).collect()}
    assert rates["S01"] == pytest.approx((2 + 50 * 0.25) / 52)
    assert rates["S02"] == pytest.approx((0 + 50 * 0.25) / 56)
    added = features.add_staff_rate(make(dict(staff_id="S99")), features.fit_staff_rates(df), 0.25)
    assert added.first()["staff_noshow_rate"] == 0.25


def test_labels_are_sorted_positions_and_unseen_is_minus_one(make):
    maps = features.fit_label_maps(make(dict(branch="Memnagar"), dict(branch="Chandkheda")))
    labelled = features.add_labels(
        make(dict(branch="Memnagar"), dict(branch="Chandkheda"), dict(branch="Airport")), maps
    )
    assert [r["branch_label"] for r in labelled.orderBy("booking_id").collect()] == [1, 0, -1]


def test_target_codes(make):
    df = features.add_target(make(dict(outcome="Show"), dict(outcome="No-Show"), dict(outcome="?")))
    found = [(r["target"], r["label"]) for r in df.orderBy("booking_id").collect()]
    assert found == [(1, 0.0), (0, 1.0), (-1, 0.0)]


def test_missing_feature_is_named(make):
    with pytest.raises(ValueError, match="staff_noshow_rate"):
        features.feature_matrix(row_features(make({})))


def test_sanitize_clips_infinite_values_only(spark):
    df = spark.createDataFrame(
        [(float("nan"), 1), (float("inf"), 2), (float("-inf"), 3), (5e7, 4), (None, 5)],
        "x double, id int",
    )
    found = [r["x"] for r in cleaning.sanitize_features(df, ["x"]).orderBy("id").collect()]
    assert found == [0.0, 1e6, -1e6, 5e7, 0.0]


def test_validation_names_every_broken_rule(make):
    valid, rejected = cleaning.validate_bookings(
        make({}, dict(service_type="Massage", hour_of_day=24), dict(day_of_week=None),
             dict(past_visit_count=None))
    )
    assert valid.count() == 2
    found = {r["booking_id"]: r["violations"] for r in rejected.collect()}
    assert found == {
        "B001": ["service_type is not allowed", "hour_of_day is outside 0..23"],
        "B002": ["day_of_week is required"],
    }


def test_defaults_fill_missing_fields_and_columns(spark):
    df = spark.createDataFrame([(None, 5)], "service_type string, hour_of_day long")
    row = cleaning.fill_request_defaults(df, "2025-11-20").first()
    assert (row["service_type"], row["hour_of_day"], row["staff_id"], row["month"]) == (
        "Haircut", 5, "S01", 11,
    )


def test_date_filter_reaches_the_scan(bookings, capsys):
    df = cleaning.filter_bookings(bookings, "2025-06-01", "2025-06-30")
    df.select("booking_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(booking_datetime,2025-06-01T00:00)" in plan
    assert "LessThan(booking_datetime,2025-07-01T00:00)" in plan
    assert "ReadSchema: struct<booking_id:string,booking_datetime:timestamp_ntz>" in plan

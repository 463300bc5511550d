"""Whole jobs, from files to files."""

import pytest

from slotwise import jobs
from slotwise.operators.drift import read_drift_history
from slotwise.operators.training import QUICK
from slotwise.sources.bookings import write_bookings


@pytest.fixture(scope="module")
def source(bookings, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("jobs") / "bookings")
    write_bookings(bookings, path)
    return path


def test_train_then_score(spark, bookings, tmp_path):
    out = str(tmp_path / "trained")
    jobs.train(spark, bookings, out, QUICK)
    assert spark.read.csv(f"{out}/model_comparison", header=True).count() == 6
    assert spark.read.json(f"{out}/feature_ranges").count() == 55
    for place in ("primary", "secondary"):
        assert spark.read.csv(f"{out}/feature_importance/{place}", header=True).count() == 55
    requests = tmp_path / "requests.json"
    good = (
        '{"service_type": "Haircut", "branch": "Memnagar", "payment_method": "Cash", '
        '"booking_lead_time_hours": 1, "day_of_week": 0, "hour_of_day": 20}'
    )
    requests.write_text('{"bookings": [%s, {"service_type": "Massage"}]}\n' % good)
    jobs.main(
        ["score", "--model", f"{out}/model", "--requests", str(requests),
         "--out", str(tmp_path / "scored"), "--as-of", "2026-03-16"]
    )
    rows = spark.read.parquet(str(tmp_path / "scored/scores")).collect()
    assert len(rows) == 1 and 0 <= rows[0]["noshow_probability"] <= 1
    rejected = spark.read.json(str(tmp_path / "scored/rejected")).collect()
    assert "service_type is not allowed" in rejected[0]["violations"]


def test_retention_reports(spark, source, tmp_path):
    out = str(tmp_path)
    jobs.main(["retain", "--bookings", source, "--out", out])
    customers = spark.read.parquet(f"{out}/profiles").count()
    segments = spark.read.json(f"{out}/segment_summary").collect()
    assert sum(r["count"] for r in segments) == customers == 150
    assert spark.read.json(f"{out}/strategies").count() in (3, 4)
    assert spark.read.json(f"{out}/at_risk_customers").count() <= 20


def test_overview_of_a_filtered_period(spark, source, tmp_path):
    out = str(tmp_path)
    jobs.main(
        ["overview", "--bookings", source, "--out", out, "--first-day", "2025-06-01",
         "--last-day", "2025-06-30", "--branch", "Memnagar", "--branch", "Chandkheda"]
    )
    days = spark.read.json(f"{out}/noshow_trend_daily")
    assert {r["period"][:7] for r in days.select("period").collect()} == {"2025-06"}
    branches = spark.read.json(f"{out}/noshow_by").filter("dimension = 'branch'")
    assert {r["value"] for r in branches.collect()} == {"Memnagar", "Chandkheda"}


def test_drift_log(spark, source, tmp_path):
    log = str(tmp_path / "log")
    for day in ("2026-03-16", "2026-03-17"):
        jobs.main(
            ["drift", "--bookings", source, "--reference", source, "--out", str(tmp_path / "out"),
             "--log", log, "--timestamp", day]
        )
    assert [r["drift_score"] for r in read_drift_history(spark, log).collect()] == [0.0, 0.0]

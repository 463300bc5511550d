"""Reports from stored daily partials equal the reports over bookings."""

import pytest
from pyspark.sql import functions as F

from slotwise.operators import dashboard, dataset, rollup
from slotwise.operators.cleaning import filter_bookings

RANGE = ("2025-06-01", "2025-08-31")


@pytest.fixture(scope="module")
def path(bookings, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup") / "days")
    rollup.write_rollup(bookings, path)
    return path


def rows(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


@pytest.mark.parametrize("days", [(None, None), RANGE, ("1999-01-01", "1999-01-02")])
def test_reports_equal_those_over_bookings(spark, bookings, path, days):
    stored, plain = rollup.read_rollup(spark, path, *days), filter_bookings(bookings, *days)
    assert rows(rollup.executive_kpis(stored)) == rows(dashboard.executive_kpis(plain).select(
        "total_bookings", "noshow_pct", "noshow_count", "revenue_lost", "high_risk_count"))
    for unit in ("day", "week"):
        assert rows(rollup.noshow_trend(stored, unit)) == rows(dashboard.noshow_trend(plain, unit))
    found, want = rollup.dataset_summary(stored).first(), dataset.dataset_summary(plain).first()
    for name in ("rows", "noshow_rate", "first_date", "last_date", "gross_lost"):
        assert found[name] == want[name]
    assert found["avg_price"] == (want["avg_price"] if want["avg_price"] is None else pytest.approx(want["avg_price"]))
    assert found["customers"] == pytest.approx(want["customers"], rel=0.05)


def test_branches_and_services(spark, bookings, path):
    places, services = ["Memnagar"], ["Haircut", "Color"]
    stored = rollup.read_rollup(spark, path, *RANGE, places, services)
    plain = filter_bookings(bookings, *RANGE, places, services)
    assert rows(rollup.executive_kpis(stored)) == rows(dashboard.executive_kpis(plain))
    assert rollup.executive_kpis(rollup.read_rollup(spark, path, branches=[])).first()["total_bookings"] == 0


def test_a_report_reads_its_days_only(spark, path):
    stored = rollup.read_rollup(spark, path, "2025-07-01", "2025-07-03")
    plan = rollup.executive_kpis(stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "customers" not in plan.split("ReadSchema")[1]
    files = [r[0] for r in stored.select(F.input_file_name()).distinct().collect()]
    assert 0 < len(files) <= 3 and all("day=2025-07-0" in f for f in files)


def test_corrected_days_replace_themselves_only(spark, bookings, tmp_path):
    path = str(tmp_path / "days")
    rollup.write_rollup(bookings, path)
    before = {f for f in rollup.read_rollup(spark, path).inputFiles() if "day=2025-07-0" not in f}
    day = F.to_date("booking_datetime").cast("string")
    # the first of July loses all its bookings, the second its no-shows
    corrected = bookings.filter((day != "2025-07-01") & ~((day == "2025-07-02") & (F.col("outcome") == "No-Show")))
    for _ in range(2):  # repeating changes nothing
        rollup.write_rollup(corrected, path, "2025-07-01", "2025-07-02")
        stored = rollup.read_rollup(spark, path)
        assert rows(rollup.executive_kpis(stored)) == rows(dashboard.executive_kpis(corrected))
        assert rows(rollup.noshow_trend(stored)) == rows(dashboard.noshow_trend(corrected))
    assert before <= set(stored.inputFiles())


def test_nulls_and_unpriced_services(spark, make, tmp_path):
    path = str(tmp_path / "days")
    df = make(
        {"customer_id": None, "branch": None, "service_type": None, "outcome": "No-Show"},
        {"customer_id": None, "service_type": "Massage", "outcome": None},
        {"booking_datetime": None},
    )
    rollup.write_rollup(df, path)
    stored = rollup.read_rollup(spark, path)
    assert rows(rollup.executive_kpis(stored)) == rows(dashboard.executive_kpis(df))
    found = rollup.dataset_summary(stored).first()
    assert (found["rows"], found["customers"]) == (3, 1)
    assert rollup.executive_kpis(rollup.read_rollup(spark, path, "2025-06-02", "2025-06-02")).first()[0] == 2

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotwise.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "slotwise-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def bookings(spark, sf_dir):
    from slotwise.catalog import tables

    return tables.bookings(spark, sf_dir)


@pytest.fixture(scope="session")
def trained(spark, sf_dir):
    from slotwise.catalog import tables

    return tables.trained(spark, sf_dir)


def booking(**fields):
    """One booking with harmless defaults."""
    row = {
        "booking_id": "B1", "customer_id": "C1", "service_type": "Haircut",
        "branch": "Science City", "booking_datetime": "2025-06-02 12:00:00",
        "booking_lead_time_hours": 24, "day_of_week": 0, "hour_of_day": 12,
        "payment_method": "UPI", "past_visit_count": 0, "past_cancellation_count": 0,
        "past_noshow_count": 0, "is_repeat_customer": False, "service_duration_mins": 60,
        "staff_id": "S01", "outcome": "Show",
    }
    row.update(fields)
    return row


@pytest.fixture(scope="session")
def make(spark):
    """Bookings from dicts of fields that differ from the defaults."""
    from pyspark.sql import functions as F, types as T

    from slotwise import schema

    text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == "booking_datetime" else f.dataType)
            for f in schema.BOOKINGS.fields
        ]
    )

    def build(*rows):
        full = [booking(**{"booking_id": f"B{i:03d}", **row}) for i, row in enumerate(rows)]
        df = spark.createDataFrame([tuple(r[n] for n in schema.BOOKINGS.names) for r in full], text)
        return df.withColumn("booking_datetime", F.col("booking_datetime").cast("timestamp_ntz"))

    return build

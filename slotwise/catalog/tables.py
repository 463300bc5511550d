"""Tables the queries share, each derived once per application and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise.catalog.orders_view import map_bookings
from slotwise.operators import profiles as pr
from slotwise.operators import rollup as daily
from slotwise.operators.training import REGISTERED, Trained, train_all
from slotwise.plans.materialize import shared_folder, written
from slotwise.sources.bookings import read_bookings, write_bookings

_made: dict[tuple, object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[str], object]):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made[key] = make(f"{kind}-{sf_dir.strip('/').replace('/', '_')}")
    return _made[key]


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings mapped from all of ``orders``, written and read back by the library's own source."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def make(name: str) -> DataFrame:
        path = f"{shared_folder(spark)}/{name}"
        write_bookings(map_bookings(orders), path, mode="overwrite")
        return read_bookings(spark, path)

    return _once("bookings", spark, sf_dir, make)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer profiles for the reports that read them."""
    source = bookings(spark, sf_dir)
    return _once(
        "profiles", spark, sf_dir, lambda name: written(pr.customer_profiles(source), name)
    )


def rollup(spark: SparkSession, sf_dir: str, first_day: str, last_day: str) -> str:
    """Folder of the daily partials of all bookings, the given days written once more."""
    source = bookings(spark, sf_dir)

    def make(name: str) -> str:
        path = f"{shared_folder(spark)}/{name}"
        daily.write_rollup(source, path)
        daily.write_rollup(source, path, first_day, last_day)
        return path

    return _once(f"rollup-{first_day}-{last_day}", spark, sf_dir, make)


def trained(spark: SparkSession, sf_dir: str) -> Trained:
    """Models trained on all bookings with the sizes of ``REGISTERED``, which the reports return."""
    source = bookings(spark, sf_dir)
    return _once("trained", spark, sf_dir, lambda name: train_all(source, REGISTERED))


# Request fields as a careless client would send them: unknown, missing and
# out-of-range values by booking number. The same expressions run on DuckDB.
REQUEST_FIELDS = {
    "booking_id": "booking_id",
    "service_type": "CASE WHEN n % 17 = 0 THEN NULL WHEN n % 19 = 0 THEN 'Massage'"
    " ELSE service_type END",
    "branch": "CASE WHEN n % 23 = 0 THEN 'Airport' ELSE branch END",
    "payment_method": "CASE WHEN n % 29 = 0 THEN NULL ELSE payment_method END",
    "booking_lead_time_hours": "booking_lead_time_hours * 2",
    "day_of_week": "CASE WHEN n % 13 = 0 THEN NULL ELSE day_of_week END",
    "hour_of_day": "CASE WHEN n % 31 = 0 THEN hour_of_day + 15 ELSE hour_of_day END",
    "past_visit_count": "past_visit_count * 6",
    "past_cancellation_count": "CASE WHEN n % 37 = 0 THEN NULL ELSE past_cancellation_count END",
    "past_noshow_count": "past_noshow_count",
    "service_duration_mins": "service_duration_mins * 3",
    "staff_id": "CASE WHEN n % 41 = 0 THEN NULL ELSE staff_id END",
}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = bookings(spark, sf_dir).selectExpr("*", "CAST(booking_id AS BIGINT) AS n")
    return numbered.selectExpr(*[f"{sql} AS {name}" for name, sql in REQUEST_FIELDS.items()])

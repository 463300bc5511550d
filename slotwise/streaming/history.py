"""Running per-customer counters over a booking stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from slotwise.functions.expr import noshow_int
from slotwise.operators.history import customer_history
from slotwise.plans.dims import bounded
from slotwise.streaming.io import for_each_batch

C = F.col
_TOTALS = "visits long, noshows long"
_CUSTOMER = f"customer_id string, {_TOTALS}"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _CustomerTotals(StatefulProcessor):
    """One value per customer in the state store, removed ``keep_ms`` after its last update."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        visits, noshows = self.totals.get() or (0, 0)
        for row in rows:
            visits, noshows = visits + row.visits, noshows + row.noshows
        self.totals.update((visits, noshows))
        yield Row(customer_id=key[0], visits=visits, noshows=noshows)

    def close(self) -> None:
        pass


def _partial_totals(batches):
    """Totals per customer and Arrow batch, so that a busy customer sends few rows."""
    for rows in batches:
        grouped = rows.groupby("customer_id", sort=False)["noshows"]
        yield grouped.agg(visits="size", noshows="sum").reset_index()


def running_totals(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Per micro-batch one row per customer in it: the customer's totals after the batch.

    Without a time to keep them the totals are a streaming aggregation, which stays in
    the JVM; only one with a time needs a processor of its own.
    """
    partial = rows.select("customer_id", noshow_int().cast("long").alias("noshows"))
    if keep_ms is None:
        return partial.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("visits"), F.sum("noshows").alias("noshows")
        )
    return (
        partial.mapInPandas(_partial_totals, _CUSTOMER)
        .groupBy("customer_id")
        .transformWithState(_CustomerTotals(keep_ms), _CUSTOMER, "Update", "ProcessingTime")
    )


@contextmanager
def _state_settings(spark: SparkSession):
    """A query copies the settings when it starts; the caller's are put back afterwards."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # state that expires is removed by the next batch with data
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    old = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def history_stream(
    bookings: DataFrame, path: str, checkpoint: str, keep_ms: int | None = None
) -> StreamingQuery:
    """Each booking with its customer's earlier visits and no-shows.

    A customer's totals lie in the state store of the query, below ``checkpoint``; a
    micro-batch reads and writes those of its own customers only. Inside a micro-batch
    bookings are ordered by (time, id) with the skew-proof running sums, to which the
    totals of earlier batches (those after the batch less its own) are added. Results are numbered by batch, so a repeated
    batch, which starts from the same state, rewrites the same files. Exact when no
    booking arrives in a later batch than one that follows it.

    With ``keep_ms`` the totals of a customer without bookings for that many
    milliseconds of processing time are removed, and the customer counts from 0 again.
    The state of the two kinds differs, so a checkpoint stays with its kind.
    """
    known = bookings.filter(C("customer_id").isNotNull())
    rows = known.select(
        "booking_id",
        "customer_id",
        "booking_datetime",
        "outcome",
        F.lit(None).cast("long").alias("visits"),
        F.lit(None).cast("long").alias("noshows"),
    )
    both = rows.withColumn("is_booking", F.lit(True)).unionByName(
        running_totals(known, keep_ms).withColumn("is_booking", F.lit(False)), allowMissingColumns=True
    )

    def process(batch: DataFrame, number: int) -> None:
        rows = batch.filter("is_booking").drop("visits", "noshows")
        after = batch.filter("NOT is_booking").select("customer_id", "visits", "noshows")
        own = rows.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("own_visits"), F.sum(noshow_int()).alias("own_noshows")
        )
        before, few = bounded(
            after.join(own, "customer_id").select(
                "customer_id",
                (C("visits") - C("own_visits")).alias("visits"),
                (C("noshows") - C("own_noshows")).alias("noshows"),
            )
        )
        placed = customer_history(rows)
        placed.join(F.broadcast(before) if few else before, "customer_id").select(
            "booking_id",
            "customer_id",
            (C("prior_visits") + C("visits")).alias("prior_visits"),
            (C("prior_noshows") + C("noshows")).alias("prior_noshows"),
        ).write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _state_settings(bookings.sparkSession):
        return for_each_batch(both, process, checkpoint, "update")

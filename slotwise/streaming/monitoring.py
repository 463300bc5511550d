"""No-show rate and drift of a booking stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.functions.expr import noshow_int
from slotwise.operators import drift
from slotwise.streaming.io import for_each_batch

C = F.col


def noshow_rate_stream(bookings: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Bookings and no-shows per tumbling window of booking time.

    Rows later than ``delay`` are dropped; in append mode a window appears once the
    watermark has passed its end. Works on a batch as well, without dropping.
    """
    timed = bookings.withColumn("event_time", C("booking_datetime").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.sum(noshow_int()).alias("noshows"))
        .select(
            C("w.start").cast("timestamp_ntz").alias("window_start"),
            C("w.end").cast("timestamp_ntz").alias("window_end"),
            "total",
            "noshows",
            (C("noshows") / C("total")).alias("noshow_rate"),
        )
    )


def with_divergence(rates: DataFrame, predicted: float, limit: float = 0.05) -> DataFrame:
    gap = F.abs(C("noshow_rate") - predicted)
    return rates.withColumn("divergence", gap).withColumn("alert", gap > limit)


def rate_divergence_stream(
    scored: DataFrame,
    outcomes: DataFrame,
    width: str = "7 days",
    delay: str = "1 day",
    limit: float = 0.05,
) -> DataFrame:
    """Actual against predicted no-show rate per window of booking time.

    Scores (``booking_id, booking_datetime, score``) wait for the outcome of the same
    booking (``booking_id, booking_datetime, outcome``) or the other way round. Both
    sides have a watermark of ``delay``: a row later than that is dropped and counted
    (``late_rows``), and one without its other half is forgotten. In append mode a
    window appears once the slower side has passed its end. Bookings without a time, a
    score or an outcome are left out. Works on batches as well, without dropping.
    """
    timed = [
        side.withColumn("event_time", C("booking_datetime").cast("timestamp"))
        .withWatermark("event_time", delay)
        .select("booking_id", "event_time", value.alias(name))
        .filter(C(name).isNotNull())
        for side, value, name in (
            (scored, C("score"), "score"),
            (outcomes, F.when(C("outcome").isNotNull(), noshow_int()), "noshow"),
        )
    ]
    rates = (
        timed[0]
        .join(timed[1], ["booking_id", "event_time"])
        .groupBy(F.window("event_time", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.avg("noshow").alias("actual_rate"),
            F.avg("score").alias("predicted_rate"),
        )
        .select(
            C("w.start").cast("timestamp_ntz").alias("window_start"),
            C("w.end").cast("timestamp_ntz").alias("window_end"),
            "total",
            "actual_rate",
            "predicted_rate",
        )
    )
    gap = F.abs(C("actual_rate") - C("predicted_rate"))
    return rates.withColumn("divergence", gap).withColumn("alert", gap > limit)


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped as late, over the micro-batches it still reports."""
    return sum(
        state["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )


def drift_stream(
    bookings: DataFrame, reference: drift.Reference, log_path: str, checkpoint: str
) -> StreamingQuery:
    """Compare every micro-batch with the reference and log the summary.

    The log has one folder per batch, so a repeated batch does not log twice.
    """

    def process(batch: DataFrame, number: int) -> None:
        report = drift.drift_report(reference, batch)
        summary = drift.drift_summary(report, f"batch-{number:08d}")
        summary.write.mode("overwrite").json(f"{log_path}/batch={number}")

    return for_each_batch(bookings, process, checkpoint)

"""Streams give what the same plan gives on a batch."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from slotwise import schema
from slotwise.operators import drift, history, scoring
from slotwise.streaming.history import history_stream
from slotwise.streaming.io import stream_bookings, stream_requests, write_stream
from slotwise.streaming.monitoring import (
    drift_stream,
    late_rows,
    noshow_rate_stream,
    rate_divergence_stream,
    with_divergence,
)
from slotwise.streaming.scoring import enrich, history_snapshot, rejected_stream, score_stream

ORDER = ["booking_datetime", "booking_id"]


@pytest.fixture(scope="module")
def source(bookings, tmp_path_factory):
    """The bookings in five files, written one after the other in time order."""
    path = str(tmp_path_factory.mktemp("source") / "bookings")
    bounds = ["2025-01-01", "2025-06-01", "2025-08-01", "2025-10-01", "2026-01-01", "2027-01-01"]
    for low, high in zip(bounds, bounds[1:]):
        part = bookings.filter(
            (F.col("booking_datetime") >= F.lit(low).cast("timestamp_ntz"))
            & (F.col("booking_datetime") < F.lit(high).cast("timestamp_ntz"))
        )
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_a_repeated_batch_changes_nothing(spark, source, tmp_path):
    """A run that stopped after its work but before its commit does the last batch again."""
    stream = stream_bookings(spark, source, files_per_trigger=1)
    out, mark = (str(tmp_path / name) for name in ("out", "mark"))
    history_stream(stream, out, mark).awaitTermination()
    first = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    last = "4"
    shutil.copytree(
        mark,
        tmp_path / "again",
        ignore=lambda folder, names: [n for n in names if n.strip(".crc") == last]
        if folder.endswith("commits")
        else [],
    )
    history_stream(stream, out, str(tmp_path / "again")).awaitTermination()
    assert os.path.exists(tmp_path / "again" / "commits" / last)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == first


def test_history_over_several_batches(spark, bookings, source, tmp_path):
    stream = stream_bookings(spark, source, files_per_trigger=1)
    out = str(tmp_path / "out")
    history_stream(stream, out, str(tmp_path / "mark")).awaitTermination()
    columns = ["booking_id", "prior_visits", "prior_noshows"]
    found = spark.read.parquet(out)
    assert found.select("batch").distinct().count() == 5
    batch = history.customer_history(bookings).select(columns)
    assert found.select(columns).exceptAll(batch).count() == 0 and found.count() == batch.count()


def _one_customer(make, path, *ids):
    rows = [dict(booking_id=i, customer_id="one", outcome="No-Show") for i in ids]
    make(*rows).coalesce(1).write.mode("append").parquet(path)


def _found(spark, path):
    rows = spark.read.parquet(path).collect()
    return {r["booking_id"]: (r["prior_visits"], r["prior_noshows"]) for r in rows}


def test_a_batch_reads_only_its_own_customers(spark, make, tmp_path):
    path, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    make(*[dict(customer_id=f"C{i}") for i in range(500)]).coalesce(1).write.parquet(path)
    _one_customer(make, path, "one-1")
    history_stream(stream_bookings(spark, path), out, mark).awaitTermination()
    _one_customer(make, path, "one-2", "one-3")
    second = history_stream(stream_bookings(spark, path), out, mark)
    second.awaitTermination()
    (state,) = second.lastProgress["stateOperators"]
    assert state["numRowsTotal"] == 501 and state["numRowsUpdated"] == 1
    assert state["customMetrics"]["rocksdbGetCount"] <= 4
    found = _found(spark, out)
    assert [found[f"one-{i}"] for i in (1, 2, 3)] == [(0, 0), (1, 1), (2, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_totals_without_bookings_for_long_are_removed(spark, make, tmp_path):
    path, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    left = []
    for number, customers in enumerate(["AB", "C", "A"]):
        rows = [dict(booking_id=f"{c}{number}", customer_id=c) for c in customers]
        make(*rows).coalesce(1).write.mode("append").parquet(path)
        query = history_stream(stream_bookings(spark, path), out, mark, keep_ms=1000)
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(2)
    assert set(_found(spark, out).values()) == {(0, 0)} and left[1:] == [1, 1]


def test_noshow_rate_of_closed_windows(spark, bookings, source, tmp_path):
    rates = noshow_rate_stream(stream_bookings(spark, source, files_per_trigger=1))
    write_stream(rates, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    streamed = spark.read.schema(rates.schema).parquet(str(tmp_path / "out"))
    batch = noshow_rate_stream(bookings)
    assert streamed.exceptAll(batch).count() == 0
    closed = bookings.agg(F.max("booking_datetime")).first()[0]
    expected = batch.filter(F.col("window_end") <= F.lit(closed) - F.expr("INTERVAL 1 DAY")).count()
    assert streamed.count() == expected
    assert with_divergence(batch, 2.0).filter("alert").count() == batch.count()


def _day(make, day, *ids, outcome="Show"):
    when = f"2025-06-{day:02d} 12:00:00"
    return make(*[dict(booking_id=i, booking_datetime=when, outcome=outcome) for i in ids])


def test_scores_meet_outcomes_of_another_stream(spark, make, tmp_path):
    """Outcomes come first, last, never or too late; the rest equals the batch join."""
    asked, known, out, mark = (str(tmp_path / n) for n in ("asked", "known", "out", "mark"))
    scores = [("a", 2, 0.5), ("b", 2, 0.25), ("never", 3, 0.5), ("no score", 3, None), ("end", 20, 0.5), ("late", 2, 0.5)]
    outcomes = [_day(make, 2, "b", "only outcome", outcome="No-Show"), _day(make, 3, "no score"),
                _day(make, 2, "a"), _day(make, 20, "end"), _day(make, 2, "late")]
    on_time = []
    for number, rows in enumerate([scores[:2], scores[2:4], [], scores[4:5], scores[5:]]):
        side = spark.createDataFrame(rows, "booking_id string, day int, score double").selectExpr(
            "booking_id", "make_timestamp_ntz(2025, 6, day, 12, 0, 0) AS booking_datetime", "score")
        side.coalesce(1).write.mode("append").parquet(asked)
        outcomes[number].coalesce(1).write.mode("append").parquet(known)
        schema_of = spark.read.parquet(asked).schema
        streams = (spark.readStream.schema(schema_of).parquet(asked), stream_bookings(spark, known))
        rates = rate_divergence_stream(*streams, width="1 day", delay="2 days")
        query = write_stream(rates, out, mark)
        query.awaitTermination()
        dropped = late_rows(query)
        if number < 4:
            on_time.append((spark.read.parquet(asked), spark.read.parquet(known)))
            assert dropped == 0
    assert dropped == 2  # the score and the outcome of the late booking
    found = spark.read.schema(rates.schema).parquet(out).collect()
    batch = rate_divergence_stream(*on_time[-1], width="1 day").filter("day(window_start) < 20").collect()
    assert found == batch
    assert [(r["total"], r["actual_rate"], r["predicted_rate"], r["alert"]) for r in found] == [(2, 0.5, 0.375, True)]


def test_scores_equal_the_batch(spark, bookings, trained, tmp_path):
    path = str(tmp_path / "in")
    wrong_hour = F.when(F.col("staff_id") == "S03", 99).otherwise(F.col("hour_of_day"))
    requests = bookings.select(
        *[c for c in schema.REQUEST.names if c != "month"]
    ).withColumn("hour_of_day", wrong_hour)
    requests.write.json(path)
    stream = stream_requests(spark, path)
    scored = score_stream(stream, trained, "2025-06-15")
    write_stream(scored, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    streamed = spark.read.schema(scored.schema).parquet(str(tmp_path / "out"))
    valid = spark.read.schema(stream.schema).json(path).filter("hour_of_day < 24")
    batch = scoring.score(valid, trained, "2025-06-15")
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count() > 0
    rejected = rejected_stream(stream)
    write_stream(rejected, str(tmp_path / "bad"), str(tmp_path / "mark2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == requests.count() - batch.count()


def test_enrichment_fills_unknown_customers(make):
    past = history_snapshot(make(dict(customer_id="A", outcome="No-Show"), dict(customer_id="A")))
    rows = enrich(make(dict(customer_id="A"), dict(customer_id="Z"), dict(customer_id=None)), past)
    found = [(r["past_visit_count"], r["past_noshow_count"]) for r in rows.orderBy("booking_id").collect()]
    assert found == [(2, 1), (0, 0), (0, 0)]


def test_drift_of_every_batch_is_logged(spark, bookings, source, tmp_path):
    reference = drift.fit_reference(bookings)
    log = str(tmp_path / "log")
    drift_stream(
        stream_bookings(spark, source, files_per_trigger=1), reference, log, str(tmp_path / "mark")
    ).awaitTermination()
    logged = drift.read_drift_history(spark, log).collect()
    assert [r["timestamp"] for r in logged] == [f"batch-{i:08d}" for i in range(5)]
    first = bookings.filter("booking_datetime < TIMESTAMP_NTZ'2025-06-01 00:00:00'")
    expected = drift.drift_summary(drift.drift_report(reference, first), "").first()
    assert logged[0]["drifted_features"] == expected["drifted_features"]

"""Drift from merged sketches against the exact statistic."""

import pytest
from pyspark.sql import functions as F

from slotwise import schema
from slotwise.operators import drift, drift_windows as dw
from slotwise.streaming.io import stream_bookings

EVEN, SKEWED, TIES = "booking_lead_time_hours", "past_visit_count", "hour_of_day"
NAMES = [EVEN, SKEWED, TIES]


def many(spark, rows: int, seed: int, shift: float):
    """Values with and without ties, over some ten weeks."""
    day = F.expr("timestampadd(DAY, CAST(id % 70 AS INT), TIMESTAMP_NTZ'2025-01-02 10:00:00')")
    return spark.range(rows).select(
        day.alias("booking_datetime"),
        (F.rand(seed) * 1000 + shift).alias(EVEN),
        F.exp(F.randn(seed + 1) + shift / 1000).alias(SKEWED),
        F.floor(F.rand(seed + 2) * 5 + shift / 200).alias(TIES),
    )


def by_feature(df, column="statistic"):
    return {r["feature"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("k,cuts", [(1024, 400), (64, 50)])
def test_statistic_is_within_the_bound_of_the_exact_one(spark, k, cuts):
    reference, current = many(spark, 60000, 1, 0.0), many(spark, 60000, 11, 120.0)
    panes = dw.pane_sketches(current, NAMES, k=k)
    windows = dw.window_sketches(panes, 28, 7, k)
    found = dw.window_drift(dw.reference_sketches(reference, NAMES, k), windows, cuts)
    rows = {(str(r["window_start"]), r["feature"]): r for r in found.collect()}
    assert len({start for start, _ in rows}) == 13
    for start in ("2025-01-02", "2025-01-30", "2025-02-27"):
        day = F.to_date("booking_datetime")
        part = current.filter((day >= F.lit(start).cast("date")) & (day < F.date_add(F.lit(start).cast("date"), 28)))
        exact = drift.ks_2samp(reference, part, NAMES).collect()
        assert len(exact) == 3
        for want in exact:
            row = rows[start, want["feature"]]
            assert (row["n_ref"], row["n_cur"]) == (want["n_ref"], want["n_cur"])
            assert abs(row["statistic"] - want["statistic"]) <= dw.error_bound(k, cuts)


def test_all_mass_just_below_a_heavy_value(spark):
    reference = spark.range(500).select(F.lit(5.0).alias(EVEN))
    current = spark.range(500).select(
        F.lit(4.9).alias(EVEN), F.lit("2025-01-02 00:00:00").cast("timestamp_ntz").alias("booking_datetime")
    )
    windows = dw.window_sketches(dw.pane_sketches(current, [EVEN]), 7, 7)
    assert by_feature(dw.window_drift(dw.reference_sketches(reference, [EVEN]), windows)) == {EVEN: 1.0}


def test_nulls_empty_tables_and_missing_columns(spark, make):
    rows = make(
        {"hour_of_day": None, "booking_datetime": "2025-01-02 00:00:00"},
        {"hour_of_day": 9, "booking_datetime": "2025-01-02 00:00:00"},
        {"hour_of_day": 10, "booking_datetime": None},
    )
    panes = dw.pane_sketches(rows, ["hour_of_day", "no_such_column"])
    windows = dw.window_sketches(panes, 14, 7)
    reference = dw.reference_sketches(rows, ["hour_of_day"])
    found = dw.window_drift(reference, windows).orderBy("window_start").collect()
    assert [(str(r["window_start"]), str(r["window_end"]), r["n_ref"], r["n_cur"]) for r in found] == [
        ("2024-12-26", "2025-01-09", 2, 1), ("2025-01-02", "2025-01-16", 2, 1),
    ]
    assert found[0]["statistic"] == pytest.approx(0.5) and found[0]["lowest"] == found[0]["highest"] == 9.0
    none = rows.limit(0)
    assert dw.window_drift(reference, dw.window_sketches(dw.pane_sketches(none), 7, 7)).count() == 0
    assert dw.window_drift(dw.reference_sketches(none), windows).count() == 0
    with pytest.raises(ValueError):
        dw.window_sketches(panes, 10, 7)


def test_stream_stores_sketches_that_merge_to_the_same_windows(spark, bookings, tmp_path):
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    # parts cut across panes, so that several batches hold the same pane
    for part in range(3):
        bookings.filter(F.pmod(F.xxhash64("booking_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(source)
    dw.drift_sketch_stream(stream_bookings(spark, source, files_per_trigger=1), out, mark).awaitTermination()
    stored = dw.read_panes(spark, out)
    assert set(stored.columns).isdisjoint(set(schema.BOOKINGS.names))
    compact = dw.compact_panes(stored)
    assert stored.count() > compact.count() == compact.select("pane", "feature").distinct().count()
    reference = dw.reference_sketches(bookings)
    batch = dw.window_drift(reference, dw.window_sketches(dw.pane_sketches(bookings)))
    for panes in (stored, compact):
        streamed = dw.window_drift(reference, dw.window_sketches(panes))
        # windows so small that their sketches hold every value: equal, not only close
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))

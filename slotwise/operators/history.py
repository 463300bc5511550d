"""Point-in-time customer history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.functions.expr import noshow_int
from slotwise.plans.ordered import LARGEST, LAST, SUM, TASK_ROWS, in_time, prior_scans, prior_sums

C = F.col
COUNTERS = ["past_visit_count", "past_noshow_count", "past_cancellation_count"]


def customer_history(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Add the customer's visits, no-shows and cancellations before each booking.

    Bookings are ordered by (booking_datetime, booking_id). Every booking counts
    as a visit. Cancellations are counted from a 0/1 column ``cancelled`` if the
    input has one.
    """
    sums = {"prior_visits": F.lit(1).cast("long"), "prior_noshows": noshow_int().cast("long")}
    if "cancelled" in df.columns:
        sums["prior_cancellations"] = F.col("cancelled").cast("long")
    known = df.filter(F.col("customer_id").isNotNull())
    return prior_sums(known, ["customer_id"], in_time(), sums, task_rows)


def requested_at() -> Column:
    """When a booking was made: its lead time before the appointment."""
    lead = F.make_dt_interval(hours=C("booking_lead_time_hours").cast("int"))
    return C("booking_datetime") - lead


def _timeline(left: DataFrame, right: DataFrame, keys, left_time, right_time, equal: bool, tie):
    """Both sides in one frame, so that one scan in order of time serves all rows.

    Rows travel as structs: no column of theirs can clash with those of the scan. At
    equal times the left row comes first, so that it does not see the right row, or
    last if ``equal``.
    """
    ids = [f"k{i}" for i in range(len(keys))]
    named = [C(f"`{key}`").alias(name) for key, name in zip(keys, ids)]
    whole = lambda df: F.struct(*[C(f"`{name}`") for name in df.columns])
    asked = left.select(
        *named, left_time.alias("at"), F.lit(equal).alias("late"), whole(left).alias("asked")
    )
    known = right.select(
        *named, right_time.alias("at"), F.lit(not equal).alias("late"), whole(right).alias("known")
    )
    present = " AND ".join(f"{name} IS NOT NULL" for name in [*ids, "at"])
    line = asked.filter(present).unionByName(known.filter(present), allowMissingColumns=True)
    return line, asked.filter(f"NOT ({present})"), ids, ["at", "late", *[f"known.`{t}`" for t in tie]]


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: Column,
    right_time: Column,
    columns: list[str],
    tie: list[str],
    equal: bool = False,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Every left row with ``columns`` of the last right row of its keys before it.

    ``equal`` lets a right row of the same time count. Right rows of one time are
    ordered by ``tie``, which must make the order total; nulls come first. Left rows
    without a key, a time or an earlier row get nulls; right rows without key or time
    match nothing. Left columns named like one of ``columns`` are replaced.
    """
    line, unplaced, ids, order = _timeline(left, right, keys, left_time, right_time, equal, tie)
    value = F.when(C("known").isNotNull(), F.struct(*[C(f"known.`{name}`") for name in columns]))
    placed = prior_scans(line, ids, order, {"found": (value, LAST)}, task_rows)
    rest = [name for name in left.columns if name not in columns]
    found = placed.filter("asked IS NOT NULL").unionByName(unplaced, allowMissingColumns=True)
    return found.select(
        *[C(f"asked.`{name}`") for name in rest], *[C(f"found.`{name}`") for name in columns]
    )


def history_as_of(
    requests: DataFrame, bookings: DataFrame, moment: Column, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Requests with their customer's counters as they were at ``moment`` of the request.

    Only bookings whose time is earlier count; ``past_cancellation_count`` is the
    largest an earlier booking had. Requests of an unknown or null customer, or without
    a moment, get 0. All come from one shuffle on the customer; a customer of many
    bookings or requests is cut into slices.
    """
    needed = bookings.select(
        "booking_id", "customer_id", "booking_datetime", "past_cancellation_count",
        noshow_int().alias("noshow"),
    )
    line, unplaced, ids, order = _timeline(
        requests, needed, ["customer_id"], moment, C("booking_datetime"), False, ["booking_id"]
    )
    one = C("known").isNotNull()
    scans = {
        "past_visit_count": (F.when(one, 1).otherwise(0).cast("long"), SUM),
        "past_noshow_count": (
            F.when(one, C("known.noshow")).otherwise(0).cast("long"), SUM,
        ),
        "past_cancellation_count": (C("known.past_cancellation_count"), LARGEST),
    }
    placed = prior_scans(line, ids, order, scans, task_rows)
    found = placed.filter("asked IS NOT NULL").unionByName(unplaced, allowMissingColumns=True)
    rest = [name for name in requests.columns if name not in COUNTERS]
    return found.select(
        *[C(f"asked.`{name}`") for name in rest],
        *[F.coalesce(C(name), F.lit(0).cast("long")).alias(name) for name in COUNTERS],
    )

"""Drift over sliding windows of booking time, from small sketches instead of rows.

Time is cut into panes of ``slide_days``. A pane keeps one KLL sketch per numeric column;
sketches merge, so a window is the merge of its panes, and a stream stores a few
kilobytes per batch, pane and column, however many bookings came. ``drift.ks_2samp`` is
the exact way.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise import constants as K
from slotwise.operators.drift import ks_of_counts, value_counts
from slotwise.plans.materialize import written
from slotwise.plans.ordered import TASK_ROWS
from slotwise.streaming.io import for_each_batch

C = F.col

SKETCH_K = 1024  # some 13 kB a full sketch
CUTS = 400
PANES = "pane date, feature string, sketch binary, lowest double, highest double"


def rank_error(k: int = SKETCH_K) -> float:
    """Error of a rank in a KLL sketch of size ``k``, at 99 % confidence."""
    return 2.296 / k**0.9021


def error_bound(k: int = SKETCH_K, cuts: int = CUTS) -> float:
    """How far ``window_drift`` may be from the exact statistic, at 99 % per rank.

    Two ranks are compared (an error each); between neighbouring cuts the reference
    grows by one step of the cuts, which are ranks with an error themselves.
    """
    return 4 * rank_error(k) + 1 / cuts


def _cells(df: DataFrame, names: list[str], keys: list[Column]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(name).alias("feature"), C(name).cast("double").alias("value")) for name in names]
    )
    rows = df.select(*keys, F.inline(cells))
    return rows.filter(C("value").isNotNull() & ~F.isnan("value"))


def _sketched(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    return cells.groupBy(*keys, "feature").agg(
        F.kll_sketch_agg_double("value", k).alias("sketch"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


def _merged(sketches: DataFrame, keys: list[str], k: int) -> DataFrame:
    return sketches.groupBy(*keys, "feature").agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
    )


def _present(df: DataFrame, names: list[str] | None) -> list[str]:
    return [name for name in names or K.DRIFT_NUMERIC if name in df.columns]


def pane_start(slide_days: int) -> Column:
    """First day of the pane of a booking; panes are counted from 1970-01-01."""
    place = F.floor(F.unix_date(F.to_date("booking_datetime")) / slide_days)
    return F.date_from_unix_date((place * slide_days).cast("int"))


def pane_sketches(
    df: DataFrame, names: list[str] | None = None, slide_days: int = 7, k: int = SKETCH_K
) -> DataFrame:
    """``pane, feature, sketch, lowest, highest`` in one pass; sketches combine before the shuffle.

    Nulls, NaN and bookings without a time are left out; a pane without values of a
    column has no row for it, columns that ``df`` lacks are left out.
    """
    timed = df.filter(C("booking_datetime").isNotNull())
    cells = _cells(timed, _present(df, names), [pane_start(slide_days).alias("pane")])
    return _sketched(cells, ["pane"], k)


def reference_sketches(df: DataFrame, names: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """``feature, sketch, lowest, highest`` of the reference set.

    Written once: a sketch drops values at random, so that another run gives another sketch.
    """
    return written(_sketched(_cells(df, _present(df, names), []), [], k))


def window_sketches(
    panes: DataFrame, width_days: int = 28, slide_days: int = 7, k: int = SKETCH_K
) -> DataFrame:
    """``window_start, window_end, feature, sketch, lowest, highest``: panes merged to windows.

    A window opens every ``slide_days``; those at both ends hold what there is of them.
    Panes may come in parts, as several batches leave them.
    """
    if width_days % slide_days:
        raise ValueError("the width must be a multiple of the slide")
    back = F.sequence(F.lit(0), F.lit(width_days - slide_days), F.lit(slide_days))
    opened = F.explode(F.transform(back, lambda days: F.date_sub(C("pane"), days)))
    spread = panes.select(opened.alias("window_start"), "feature", "sketch", "lowest", "highest")
    merged = _merged(spread, ["window_start"], k)
    end = F.date_add("window_start", width_days)
    return merged.select("window_start", end.alias("window_end"), *merged.columns[1:])


def window_drift(reference: DataFrame, windows: DataFrame, cuts: int = CUTS) -> DataFrame:
    """``window_start, window_end, feature, n_ref, n_cur, statistic, lowest, highest``.

    The statistic is the largest distance of the two distribution functions at, and just
    below, ``cuts`` quantiles of the reference (``error_bound``). These are fetched once,
    a few hundred numbers per column, and become literals; the windows are read in place,
    without a join. Columns the reference lacks are left out; an empty reference gives no
    rows.
    """
    steps = F.array(*[F.lit(i / cuts) for i in range(cuts + 1)])
    quantiles = reference.select(
        "feature", F.kll_sketch_get_quantile_double("sketch", steps).alias("cuts")
    ).collect()  # one row per tested column
    points = {
        row["feature"]: sorted({x for cut in row["cuts"] for x in (cut, float(np.nextafter(cut, -math.inf)))})
        for row in quantiles
    }
    if not points:
        return windows.select(
            "window_start", "window_end", "feature", F.lit(0).cast("long").alias("n_ref"),
            F.lit(0).cast("long").alias("n_cur"), F.lit(0.0).alias("statistic"), "lowest", "highest",
        ).limit(0)

    def ranks(feature: str) -> Column:
        return F.kll_sketch_get_rank_double("sketch", F.array(*[F.lit(x) for x in points[feature]]))

    known = {
        row["feature"]: row
        for row in reduce(
            DataFrame.unionByName,
            [
                reference.filter(C("feature") == name).select(
                    "feature", ranks(name).alias("ranks"), F.kll_sketch_get_n_double("sketch").alias("n")
                )
                for name in points
            ],
        ).collect()
    }
    statistic = n_ref = F.lit(None)
    for name, row in known.items():
        here = C("feature") == name
        gaps = F.zip_with(ranks(name), F.array(*[F.lit(x) for x in row["ranks"]]), lambda a, b: F.abs(a - b))
        statistic = F.when(here, F.array_max(gaps)).otherwise(statistic)
        n_ref = F.when(here, F.lit(row["n"])).otherwise(n_ref)
    return windows.filter(C("feature").isin(*known)).select(
        "window_start",
        "window_end",
        "feature",
        n_ref.alias("n_ref"),
        F.kll_sketch_get_n_double("sketch").alias("n_cur"),
        statistic.alias("statistic"),
        "lowest",
        "highest",
    )


def exact_window_drift(
    reference: DataFrame,
    current: DataFrame,
    names: list[str] | None = None,
    width_days: int = 28,
    slide_days: int = 7,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``window_start, feature, n_ref, n_cur, statistic`` from counts of distinct values.

    What the sketches approximate. Every window is set against all distinct values of the
    reference, so it costs windows times these.
    """
    names = [name for name in _present(reference, names) if name in current.columns]
    timed = current.filter(C("booking_datetime").isNotNull())
    per_pane = (
        _cells(timed, names, [pane_start(slide_days).alias("pane")])
        .groupBy("pane", "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    back = F.sequence(F.lit(0), F.lit(width_days - slide_days), F.lit(slide_days))
    opened = F.explode(F.transform(back, lambda days: F.date_sub(C("pane"), days)))
    found = written(
        per_pane.select(opened.alias("window_start"), "feature", "value", "n")
        .groupBy("window_start", "feature", "value")
        .agg(F.sum("n").alias("n"))
    )
    known = value_counts(reference, names, "double")
    keys = found.select("window_start", "feature").distinct()
    zero = F.lit(0).cast("long")
    both = (
        known.join(keys, "feature")
        .select("window_start", "feature", "value", C("n").alias("ref"), zero.alias("cur"))
        .unionByName(found.select("window_start", "feature", "value", zero.alias("ref"), C("n").alias("cur")))
        .groupBy("window_start", "feature", "value")
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )
    keyed = both.select(F.struct("window_start", "feature").alias("feature"), "value", "ref", "cur")
    return ks_of_counts(keyed, task_rows).select(
        "feature.window_start", "feature.feature", "n_ref", "n_cur", "statistic"
    )


def drift_sketch_stream(
    bookings: DataFrame, path: str, checkpoint: str, slide_days: int = 7, k: int = SKETCH_K
) -> StreamingQuery:
    """Store the pane sketches of every micro-batch, and no bookings.

    One folder per batch, so that a repeated batch replaces itself.
    """

    def process(batch: DataFrame, number: int) -> None:
        panes = pane_sketches(batch, slide_days=slide_days, k=k)
        panes.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return for_each_batch(bookings, process, checkpoint)


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    """What ``drift_sketch_stream`` stored, as it came: a pane may have a row per batch."""
    return spark.read.schema(PANES).parquet(path).select("pane", "feature", "sketch", "lowest", "highest")


def compact_panes(panes: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One row per pane and column."""
    return _merged(panes, ["pane"], k)

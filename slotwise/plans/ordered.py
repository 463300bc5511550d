"""Ordered running values that never put one large group into one task.

A window over a key sorts all rows of that key in a single task, and a window
without a key sorts the whole table there. Here keys with more than
``task_rows`` rows are found first, from a sample. All other rows
use an ordinary window. Rows of the heavy keys are range partitioned on
(key, order), so that one key spans many partitions; each partition folds its own
slice, and the totals of the slices before it, at most one row per partition and
key, are put before them. A scan says how: sums, largest values, or the last value
that is not null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise.plans.materialize import materialize, written

TASK_ROWS = 1_000_000
_SAMPLED_ROWS = 1000


class Scan(NamedTuple):
    """A running value: folded over rows, over a slice, and over earlier slices."""

    running: Callable[[Column], Column]
    total: Callable[[Column, Column], Column]  # of a slice, given the order of its rows
    join: Callable[[Column, Column], Column]  # within the slice, before the slice
    start: Callable[[Column], Column] = lambda value: value  # where no row came before


SUM = Scan(
    F.sum,
    lambda value, _: F.sum(value),
    lambda here, before: here + before,
    lambda value: F.coalesce(value, F.lit(0)),
)
LARGEST = Scan(F.max, lambda value, _: F.max(value), lambda here, before: F.greatest(here, before))
LAST = Scan(
    lambda value: F.last(value, ignorenulls=True),
    lambda value, place: F.max_by(value, F.when(value.isNotNull(), place)),
    lambda here, before: F.coalesce(here, before),
)


def in_time() -> list:
    """Bookings of a key in order of time, undated ones last, the id deciding ties."""
    return [F.col("booking_datetime").asc_nulls_last(), "booking_id"]


def heavy_keys(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame | None:
    """Keys with more than ``task_rows`` rows and their row counts, or None.

    Candidates come from a sample in which such a key has about a thousand rows, so
    the usual answer, none, costs one pass over the key columns and a small shuffle.
    Only the candidates are counted exactly. The sample decides how work is split,
    never which rows are kept. However many there are, they stay a written table,
    whose size decides how it is joined.
    """
    if task_rows > _SAMPLED_ROWS:
        fraction = _SAMPLED_ROWS / task_rows
        likely = _keys_above(df.sample(fraction, seed=42), keys, _SAMPLED_ROWS // 2)
        if likely is None:
            return None
        df = df.join(likely.drop("_key_rows"), keys, "left_semi")
    return _keys_above(df, keys, task_rows)


def _keys_above(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    counts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_key_rows"))
        .filter(F.col("_key_rows") > limit)
    )
    kept = written(counts)
    return None if kept.isEmpty() else kept


def split_by_weight(
    df: DataFrame, keys: list[str], heavy: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of heavy keys with ``_key_rows`` or None)."""
    if heavy is None:
        return df, None
    return df.join(heavy, keys, "left_anti"), df.join(heavy, keys, "inner")


def _window_scans(df: DataFrame, keys, order, scans: dict[str, tuple[Column, Scan]]) -> DataFrame:
    before = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumns(
        {name: scan.start(scan.running(value).over(before)) for name, (value, scan) in scans.items()}
    )


def _spread_scans(
    df: DataFrame, keys, order, scans: dict[str, tuple[Column, Scan]], rows: int, task_rows: int
) -> DataFrame:
    """``rows`` of ``df`` are cut into slices of at most about ``task_rows``."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))
    terms = {f"_term_{name}": value for name, (value, _) in scans.items()}
    ranged = materialize(
        df.withColumns(terms)
        .repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_seq", 33))

    # one row per (slice, key): ranges are contiguous, so at most slices + keys rows
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {name: scan for name, (_, scan) in scans.items()}
    offsets = (
        ranged.groupBy("_slice", *keys)
        .agg(
            *[
                scan.total(F.col(f"_term_{name}"), F.col("_seq")).alias(f"_total_{name}")
                for name, scan in kinds.items()
            ]
        )
        .select(
            "_slice",
            *keys,
            *[
                scan.start(scan.running(F.col(f"_total_{name}")).over(earlier)).alias(f"_offset_{name}")
                for name, scan in kinds.items()
            ],
        )
    )
    local = (
        Window.partitionBy("_slice", *keys)
        .orderBy("_seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    scanned = ranged.withColumns(
        {
            name: scan.start(scan.running(F.col(f"_term_{name}")).over(local))
            for name, scan in kinds.items()
        }
    ).join(offsets, ["_slice", *keys], "inner")
    return scanned.withColumns(
        {name: scan.join(F.col(name), F.col(f"_offset_{name}")) for name, scan in kinds.items()}
    ).drop("_slice", "_seq", *terms, *[f"_offset_{name}" for name in kinds])


def _summing(sums: dict[str, Column]) -> dict[str, tuple[Column, Scan]]:
    return {name: (value, SUM) for name, value in sums.items()}


def prior_sums(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Add, per row, sums over the rows of the same key that come before it.

    ``order``, names or sort columns, must be a total order within a key; ``keys`` may
    be empty and must not be null. Columns named in ``sums`` are appended; no row is dropped.
    """
    return prior_scans(df, keys, order, _summing(sums), task_rows)


def prior_scans(
    df: DataFrame,
    keys: list[str],
    order: list,
    scans: dict[str, tuple[Column, Scan]],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``prior_sums`` for any scan: ``{name: (value, SUM, LARGEST or LAST)}``.

    Largest and last values are null where no row before has one.
    """
    if not keys:
        rows = df.count()
        if rows <= task_rows:
            return _window_scans(df, [], order, scans)
        return _spread_scans(df, [], order, scans, rows, task_rows)
    return _scans_given(df, keys, order, scans, heavy_keys(df, keys, task_rows), task_rows)


def prior_sums_given(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    heavy: DataFrame | None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``prior_sums`` with the heavy keys already found, for several sums over one table."""
    return _scans_given(df, keys, order, _summing(sums), heavy, task_rows)


def _scans_given(df, keys, order, scans, heavy: DataFrame | None, task_rows: int) -> DataFrame:
    light, spread = split_by_weight(df, keys, heavy)
    result = _window_scans(light, keys, order, scans)
    if spread is None:
        return result
    names = [*df.columns, *scans]
    rows = heavy.agg(F.sum("_key_rows")).first()[0]
    spread = _spread_scans(spread.drop("_key_rows"), keys, order, scans, rows, task_rows)
    return result.select(names).unionByName(spread.select(names))


def with_position(
    df: DataFrame, keys: list[str], order: list, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Add ``position`` (from 1) and ``key_rows`` per key; one shuffle on the key.

    The result of the ordinary keys stays hash partitioned on ``keys``, so a
    following aggregation by the same keys adds no exchange.
    """
    heavy = heavy_keys(df, keys, task_rows)
    light, heavy_rows = split_by_weight(df, keys, heavy)
    per_key = Window.partitionBy(*keys)
    result = light.withColumns(
        {
            "position": F.row_number().over(per_key.orderBy(*order)).cast("long"),
            "key_rows": F.count(F.lit(1)).over(per_key),
        }
    )
    if heavy is None:
        return result
    names = [*df.columns, "position", "key_rows"]
    rows = heavy.agg(F.sum("_key_rows")).first()[0]
    spread = (
        _spread_scans(heavy_rows, keys, order, _summing({"position": F.lit(1)}), rows, task_rows)
        .withColumn("position", F.col("position").cast("long") + 1)
        .withColumnRenamed("_key_rows", "key_rows")
    )
    return result.select(names).unionByName(spread.select(names))

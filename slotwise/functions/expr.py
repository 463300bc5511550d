"""Small column expressions shared by all operators."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, functions as F

from slotwise import constants as K


def half_even(value: Column, places: int) -> Column:
    """Round half to even; ``round`` rounds half up."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def flag(condition: Column) -> Column:
    """1 or 0; a null condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def any_of(value: Column, names: list) -> Column:
    return value.isin(*names)


def choose(value: Column, table: dict, default) -> Column:
    """Constant-table lookup as one CASE; unknown and null give ``default``."""
    chain = reduce(
        lambda case, item: case.when(value == item[0], F.lit(item[1])), table.items(), F
    )
    return chain.otherwise(F.lit(default))


def at_least_one(value: Column) -> Column:
    """max(value, 1), null stays null (``greatest`` would give 1)."""
    return F.when(value < 1, F.lit(1).cast("long")).otherwise(value)


def clip01(value: Column) -> Column:
    """Into 0..1; null gives 0."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def is_noshow() -> Column:
    return F.col("outcome") == K.NO_SHOW


def noshow_int() -> Column:
    return flag(is_noshow())


_FAR = timedelta(days=200_000)


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of the elapsed 24-hour periods between two zone-free timestamps.

    Extracting days truncates towards zero, so the difference is first moved well
    above zero.
    """
    shifted = later - earlier + F.lit(_FAR)
    return (F.extract(F.lit("DAY"), shifted) - _FAR.days).cast("long")


def price(default: int) -> Column:
    return choose(F.col("service_type"), K.SERVICE_PRICE, default)


def share_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)

"""Basic columns, filters, validation and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise import constants as K
from slotwise.functions.expr import at_least_one, noshow_int


def with_basics(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "outcome_binary": noshow_int(),
            "booking_date": F.to_date("booking_datetime"),
            "booking_month": F.date_format("booking_datetime", "yyyy-MM"),
            "noshow_rate_hist": F.col("past_noshow_count")
            / at_least_one(F.col("past_visit_count")),
        }
    )


def date_range(first_day: str, last_day: str) -> Column:
    """Both days included, written as half-open timestamp bounds so the scan can use it."""
    start = F.lit(first_day).cast("date").cast("timestamp_ntz")
    stop = F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")
    return (F.col("booking_datetime") >= start) & (F.col("booking_datetime") < stop)


def filter_bookings(
    df: DataFrame,
    first_day: str | None = None,
    last_day: str | None = None,
    branches: list[str] | None = None,
    services: list[str] | None = None,
) -> DataFrame:
    """None means no restriction; an empty list keeps nothing."""
    if first_day is not None and last_day is not None:
        df = df.filter(date_range(first_day, last_day))
    if branches is not None:
        df = df.filter(F.col("branch").isin(*branches))
    if services is not None:
        df = df.filter(F.col("service_type").isin(*services))
    return df


def with_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``: one text per broken rule, in rule order.

    Optional fields may be null (a default fills them later), required ones may not.
    """
    enums = {
        "service_type": K.SERVICES,
        "branch": K.BRANCHES,
        "payment_method": K.PAYMENT_METHODS,
    }
    rules = []
    for name, allowed in enums.items():
        value = F.col(name)
        rules.append(
            F.when(value.isNull(), f"{name} is required").when(
                ~value.isin(*allowed), f"{name} is not allowed"
            )
        )
    for name, (low, high) in K.REQUEST_RANGES.items():
        value = F.col(name)
        outside = f"{name} is outside {low}..{high}"
        if name in K.REQUIRED_NUMBERS:
            rules.append(
                F.when(value.isNull(), f"{name} is required").when(
                    ~value.between(low, high), outside
                )
            )
        else:
            rules.append(F.when(~value.between(low, high), outside))
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def validate_bookings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``violations``)."""
    checked = with_violations(df)
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    return valid, checked.filter(F.size("violations") > 0)


def fill_request_defaults(df: DataFrame, as_of: str) -> DataFrame:
    """Fill missing request fields; a missing month becomes the month of ``as_of``."""
    present = set(df.columns)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in present else F.lit(value)
        for name, value in K.REQUEST_DEFAULTS.items()
    }
    fallback = F.month(F.lit(as_of).cast("date")).cast("long")
    filled["month"] = F.coalesce(F.col("month"), fallback) if "month" in present else fallback
    return df.withColumns(filled)


def require_features(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df


def clean_value(name: str) -> str:
    """SQL for a column as a double: null and NaN are 0, only infinite values are clipped."""
    value = f"CAST(`{name}` AS DOUBLE)"
    return f"""CASE WHEN `{name}` IS NULL OR isnan({value}) THEN 0D
        WHEN {value} = DOUBLE('inf') THEN 1e6D WHEN {value} = DOUBLE('-inf') THEN -1e6D
        ELSE {value} END"""


def sanitize_features(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns without null, NaN and infinite values (those become ±1e6)."""
    cleaned = {name: f"{clean_value(name)} AS `{name}`" for name in names}
    return df.selectExpr(*[cleaned.get(name, f"`{name}`") for name in df.columns])


def cast_features(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in names})


def _unpivot(summary: DataFrame, names: list[str], parts: list[str]) -> DataFrame:
    """One row per feature from a one-row summary with columns ``<part>__<feature>``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"), *[F.col(f"{part}__{name}").alias(part) for part in parts]
            )
            for name in names
        ]
    )
    return summary.select(F.inline(rows))


def nan_report(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without a number (null or NaN) per feature, in one pass."""
    aggregates = [
        F.count_if(F.col(name).isNull() | F.isnan(F.col(name).cast("double"))).alias(
            f"missing__{name}"
        )
        for name in names
    ]
    report = _unpivot(df.agg(*aggregates), names, ["missing"])
    return report.filter(F.col("missing") > 0)


def feature_ranges(df: DataFrame, names: list[str]) -> DataFrame:
    aggregates = []
    for name in names:
        value = F.col(name).cast("double")
        aggregates += [
            F.min(value).alias(f"min_value__{name}"),
            F.max(value).alias(f"max_value__{name}"),
            F.avg(value).alias(f"mean_value__{name}"),
        ]
    return _unpivot(df.agg(*aggregates), names, ["min_value", "max_value", "mean_value"])

"""Reports over any range of days from a stored table of daily partial results.

One row per day, branch and service holds sums and a sketch of the customers. The table is
partitioned by day: a report reads the days it asks for and no bookings, and new or
corrected bookings replace their days only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slotwise import constants as K
from slotwise.functions import rules
from slotwise.functions.expr import is_noshow, noshow_int, price
from slotwise.operators.cleaning import filter_bookings
from slotwise.operators.dashboard import HIGH_RISK_ABOVE

C = F.col

LG_K = 12  # HLL registers: 2^12, some 1.6 % standard error
ROLLUP = (
    "branch string, service_type string, bookings long, with_outcome long, noshows long, high_risk long, "
    "revenue_lost long, price_sum long, priced long, gross_lost long, customers binary, day date"
)
_SUMS = [
    "bookings", "with_outcome", "noshows", "high_risk", "revenue_lost", "price_sum", "priced", "gross_lost",
]


def daily_partials(df: DataFrame) -> DataFrame:
    """One row per ``day, branch, service_type``; null values of these are groups of their own.

    One shuffle of partial sums and sketches, however many bookings a day has. Null
    customers are not counted.
    """
    listed = price(None)
    return df.groupBy(F.to_date("booking_datetime").alias("day"), "branch", "service_type").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.count("outcome").alias("with_outcome"),
        F.sum(noshow_int()).alias("noshows"),
        F.count_if(rules.manual_risk_score() > HIGH_RISK_ABOVE).alias("high_risk"),
        F.coalesce(F.sum(F.when(is_noshow(), price(K.UNKNOWN_PRICE_DASHBOARD))), F.lit(0)).alias("revenue_lost"),
        F.coalesce(F.sum(listed), F.lit(0)).alias("price_sum"),
        F.count(listed).alias("priced"),
        F.coalesce(F.sum(F.when(is_noshow(), listed)), F.lit(0)).alias("gross_lost"),
        F.hll_sketch_agg(C("customer_id"), LG_K).alias("customers"),
    )


def write_rollup(
    bookings: DataFrame, path: str, first_day: str | None = None, last_day: str | None = None
) -> None:
    """Store the partials of all bookings, or replace those of a range of days (ends included).

    ``bookings`` holds all bookings of the days it touches. Only these days are
    overwritten; a day of the range that has no bookings any more is replaced by a row of
    zeros. Repeating the call changes nothing.
    """
    spark = bookings.sparkSession
    partials = daily_partials(filter_bookings(bookings, first_day, last_day))
    if first_day is not None and last_day is not None:
        last = (date.fromisoformat(last_day) - date.fromisoformat(first_day)).days
        start = F.lit(first_day).cast("date")
        days = spark.range(last + 1).select(F.date_add(start, C("id").cast("int")).alias("day"))
        partials = partials.unionByName(
            days.select("day", *[F.lit(0).cast("long").alias(name) for name in _SUMS]), allowMissingColumns=True
        )
    (
        partials.select(*[C(f.name).cast(f.dataType) for f in _schema(spark).fields])
        .repartition("day")  # one file a day
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def _schema(spark: SparkSession):
    return spark.createDataFrame([], ROLLUP).schema


def read_rollup(
    spark: SparkSession,
    path: str,
    first_day: str | None = None,
    last_day: str | None = None,
    branches: list[str] | None = None,
    services: list[str] | None = None,
) -> DataFrame:
    """Partials of a range of days (ends included); None means no restriction.

    The days prune partitions, the other filters reach the files.
    """
    rows = spark.read.schema(_schema(spark)).parquet(path)
    if first_day is not None:
        rows = rows.filter(C("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.filter(C("day") <= F.lit(last_day).cast("date"))
    if branches is not None:
        rows = rows.filter(C("branch").isin(*branches))
    if services is not None:
        rows = rows.filter(C("service_type").isin(*services))
    return rows


def _noshow_share() -> Column:
    return F.when(F.sum("bookings") > 0, F.sum("noshows") / F.sum("bookings"))


def executive_kpis(rollup: DataFrame) -> DataFrame:
    """The row of ``dashboard.executive_kpis``."""
    return rollup.agg(
        F.coalesce(F.sum("bookings"), F.lit(0)).alias("total_bookings"),
        (_noshow_share() * 100).alias("noshow_pct"),
        F.coalesce(F.sum("noshows"), F.lit(0)).alias("noshow_count"),
        F.coalesce(F.sum("revenue_lost"), F.lit(0)).alias("revenue_lost"),
        F.coalesce(F.sum("high_risk"), F.lit(0)).alias("high_risk_count"),
    )


def noshow_trend(rollup: DataFrame, unit: str = "day") -> DataFrame:
    """The rows of ``dashboard.noshow_trend``; weeks start on Monday."""
    if unit not in ("day", "week"):
        raise ValueError("unit must be 'day' or 'week'")
    period = C("day") if unit == "day" else F.date_sub("day", F.weekday("day"))
    per = rollup.filter(C("bookings") > 0).groupBy(period.alias("period")).agg(
        F.sum("with_outcome").alias("total"), F.sum("noshows").alias("noshows")
    )
    return per.withColumn(
        "noshow_pct", F.when(C("total") > 0, C("noshows") / C("total") * 100)
    ).orderBy("period")


def dataset_summary(rollup: DataFrame) -> DataFrame:
    """The row of ``dataset.dataset_summary``; customers are estimated from the merged sketches."""
    seen = C("bookings") > 0
    return rollup.agg(
        F.coalesce(F.sum("bookings"), F.lit(0)).alias("rows"),
        _noshow_share().alias("noshow_rate"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("customers")), F.lit(0)).alias("customers"),
        F.min(F.when(seen, C("day"))).alias("first_date"),
        F.max(F.when(seen, C("day"))).alias("last_date"),
        F.when(F.sum("priced") > 0, F.sum("price_sum") / F.sum("priced")).alias("avg_price"),
        F.coalesce(F.sum("gross_lost"), F.lit(0)).alias("gross_lost"),
    )

"""Fitted feature tables and the full feature frame."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from slotwise import constants as K
from slotwise.functions.expr import noshow_int
from slotwise.functions.features import row_features
from slotwise.operators.cleaning import clean_value, require_features
from slotwise.plans.dims import small_rows, with_pairs, with_value
from slotwise.plans.materialize import written
from slotwise.plans.ordered import prior_sums


def feature_list() -> list[str]:
    return list(K.FEATURES)


def smoothed_rate(noshows: Column, total: Column, overall: Column) -> Column:
    weight = K.STAFF_PRIOR_WEIGHT
    return (noshows + overall * weight) / (total + weight)


def staff_counts(df: DataFrame, *more: str) -> DataFrame:
    return df.groupBy("staff_id", *more).agg(
        F.count("outcome").alias("total"),
        F.sum(noshow_int()).cast("long").alias("noshows"),
        F.count(F.lit(1)).alias("rows"),
    )


def rates_from_counts(counts: DataFrame) -> DataFrame:
    """Smoothed rates from (possibly split) ``staff_counts``."""
    per_staff = counts.groupBy("staff_id").agg(
        F.sum("total").alias("total"), F.sum("noshows").alias("noshows")
    )
    overall = counts.agg(F.sum("noshows") / F.sum("rows")).scalar()
    return per_staff.filter(F.col("staff_id").isNotNull()).select(
        "staff_id",
        smoothed_rate(F.col("noshows"), F.col("total"), overall).alias("staff_noshow_rate"),
    )


def fit_staff_rates(df: DataFrame) -> DataFrame:
    """``staff_id, staff_noshow_rate``: shares pulled towards the overall share."""
    return rates_from_counts(staff_counts(df))


def global_rate(df: DataFrame) -> float:
    """Overall no-show share, one number; the default if there are no rows."""
    share = df.agg(F.avg(noshow_int())).first()[0]
    return K.DEFAULT_GLOBAL_RATE if share is None else share


def fit_label_maps(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, value, label``: position of each value in sorted order per column.

    A null is a value of its own, spelled ``nan``.
    """
    columns = columns or K.CATEGORICAL
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.coalesce(F.col(name).cast("string"), F.lit("nan")).alias("value"),
            )
            for name in columns
        ]
    )
    distinct = df.select(F.inline(pairs)).distinct()
    return prior_sums(distinct, ["column_name"], ["value"], {"label": F.lit(1).cast("long")})


def fit_tables(df: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Staff rates, label maps and the overall share, all from one pass over ``df``.

    Every categorical value is counted with its no-shows, once and written; the
    groups of any one column add up to all rows.
    """
    cells = F.array(
        *[F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in K.CATEGORICAL]
    )
    counts = written(
        df.select("outcome", F.inline(cells)).groupBy("column_name", "value").agg(
            F.count("outcome").alias("total"),
            F.sum(noshow_int()).cast("long").alias("noshows"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    staff = counts.filter("column_name = 'staff_id'").withColumnRenamed("value", "staff_id")
    share = staff.agg(F.sum("noshows") / F.sum("rows")).first()[0]
    values = counts.select("column_name", F.coalesce("value", F.lit("nan")).alias("value")).distinct()
    labels = prior_sums(values, ["column_name"], ["value"], {"label": F.lit(1).cast("long")})
    return rates_from_counts(staff), labels, K.DEFAULT_GLOBAL_RATE if share is None else share


def add_staff_rate(df: DataFrame, staff_rates: DataFrame | None, overall: float) -> DataFrame:
    """Rate of the staff member, else the overall rate."""
    if staff_rates is None:
        return df.withColumn("staff_noshow_rate", F.lit(float(overall)))
    return with_value(
        df, staff_rates, "staff_id", "staff_noshow_rate", "staff_noshow_rate", float(overall)
    )


def add_labels(df: DataFrame, label_maps: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``<column>_label``; values not in the map get -1."""
    rows = small_rows(label_maps.select("column_name", "value", "label"))
    for name in columns or K.CATEGORICAL:
        keyed = df.withColumn("_key", F.expr(f"coalesce(CAST(`{name}` AS STRING), 'nan')"))
        label = f"{name}_label"
        if rows is not None:
            pairs = [(value, code) for column, value, code in rows if column == name]
            labelled = with_pairs(keyed, pairs, "_key", label, -1, "bigint")
        else:
            one = label_maps.filter(F.col("column_name") == name)
            one = one.select(F.col("value").alias("_key"), "label")
            labelled = with_value(keyed, one, "_key", "label", label, -1)
        df = labelled.drop("_key")
    return df


def add_target(df: DataFrame) -> DataFrame:
    """``target`` is the alphabetical code (No-Show 0, Show 1, else -1); ``label`` is 1 for No-Show."""
    return df.withColumns(
        {
            "target": F.when(F.col("outcome") == K.NO_SHOW, 0)
            .when(F.col("outcome") == K.SHOW, 1)
            .otherwise(-1),
            "label": noshow_int().cast("double"),
        }
    )


def engineer_features(
    df: DataFrame,
    staff_rates: DataFrame | None = None,
    overall: float = K.DEFAULT_GLOBAL_RATE,
) -> DataFrame:
    """All features except the four labels."""
    return add_staff_rate(row_features(df), staff_rates, overall)


def full_features(
    df: DataFrame, staff_rates: DataFrame, label_maps: DataFrame, overall: float
) -> DataFrame:
    """All 55 features, and the targets when the outcome is known."""
    features = add_labels(engineer_features(df, staff_rates, overall), label_maps)
    return add_target(features) if "outcome" in df.columns else features


def assembled(df: DataFrame, names: list[str], output: str) -> DataFrame:
    """Clean ``names`` and add them, in that order, as one vector; inputs stay as they are.

    One array expression instead of a cleaned copy of every column keeps the frame
    narrow enough for whole-stage code generation.
    """
    require_features(df, names)
    values = F.expr(f"array({', '.join(clean_value(name) for name in names)})")
    return df.withColumn(output, array_to_vector(values))


def feature_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All features, in model order, as the vector ``features``."""
    return assembled(df, names or feature_list(), "features")


def target_balance(df: DataFrame) -> DataFrame:
    """Bookings per outcome and the share of each."""
    counts = df.groupBy("outcome").agg(F.count(F.lit(1)).alias("bookings"))
    total = counts.agg(F.sum("bookings")).scalar()
    return counts.withColumn("share", F.col("bookings") / total)

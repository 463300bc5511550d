"""Drift of bookings between a reference and a current set."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slotwise import constants as K, schema
from slotwise.functions.expr import half_even
from slotwise.plans.materialize import materialize, written
from slotwise.plans.ordered import TASK_ROWS, prior_sums

C = F.col


def value_counts(df: DataFrame, names: list[str], kind: str) -> DataFrame:
    """``feature, value, n`` over the given columns in one pass; nulls and NaN are dropped."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), C(name).cast(kind).alias("value"))
            for name in names
        ]
    )
    melted = df.select(F.inline(cells)).filter(C("value").isNotNull())
    if kind == "double":
        melted = melted.filter(~F.isnan("value"))
    return melted.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def cell_counts(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``feature, number, text, n`` of numeric and categorical columns together, in one pass."""
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [
        F.struct(F.lit(name).alias("feature"), C(name).cast("double").alias("number"), no_text.alias("text"))
        for name in numeric
    ] + [
        F.struct(F.lit(name).alias("feature"), no_number.alias("number"), C(name).cast("string").alias("text"))
        for name in categorical
    ]
    melted = df.select(F.inline(F.array(*cells))).filter(
        C("text").isNotNull() | (C("number").isNotNull() & ~F.isnan("number"))
    )
    return melted.groupBy("feature", "number", "text").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Reference:
    """Value counts of the reference set, taken once and compared with many current sets."""

    counts: DataFrame
    columns: tuple[str, ...]


def fit_reference(df: DataFrame) -> Reference:
    numeric, categorical = (_present(n, df.columns) for n in (K.DRIFT_NUMERIC, K.DRIFT_CATEGORICAL))
    return Reference(written(cell_counts(df, numeric, categorical)), tuple(df.columns))


def _present(names: list[str], *column_sets) -> list[str]:
    return [name for name in names if all(name in columns for columns in column_sets)]


def _both_sides(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    """``feature, value, ref, cur`` from the value counts of both sides."""
    zero = F.lit(0).cast("long")
    ref = reference.select("feature", "value", C("n").alias("ref"), zero.alias("cur"))
    cur = current.select("feature", "value", zero.alias("ref"), C("n").alias("cur"))
    return (
        ref.unionByName(cur)
        .filter(C("feature").isin(*names))
        .groupBy("feature", "value")
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )


def ks_of_counts(counts: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``feature, n_ref, n_cur, statistic`` from ``feature, value, ref, cur``.

    Running sums go over distinct values, so ties are exact.
    """
    counts = materialize(counts)
    running = prior_sums(
        counts, ["feature"], ["value"], {"ref_below": C("ref"), "cur_below": C("cur")}, task_rows
    )
    totals = counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur")
    )
    distance = F.abs(
        (C("ref_below") + C("ref")) / C("n_ref") - (C("cur_below") + C("cur")) / C("n_cur")
    )
    # totals has one row per tested column
    return (
        running.join(F.broadcast(totals), "feature")
        .filter((C("n_ref") > 0) & (C("n_cur") > 0))
        .groupBy("feature", "n_ref", "n_cur")
        .agg(F.max(distance).alias("statistic"))
    )


def _chi2(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur")
    )
    expected = (C("ref") + C("cur")) * C("n_cur") / (C("n_ref") + C("n_cur"))
    gap = C("cur") - expected
    term = F.when((C("n_ref") > 0) & (C("n_cur") > 0), gap * gap / expected).otherwise(0.0)
    # totals has one row per tested column
    return (
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature", "n_ref", "n_cur")
        .agg(F.sum(term).alias("statistic"), F.count(F.lit(1)).alias("categories"))
    )


def ks_2samp(
    reference: DataFrame,
    current: DataFrame,
    names: list[str] | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``feature, statistic, n_ref, n_cur``: largest distance of the two distribution functions."""
    names = _present(names or K.DRIFT_NUMERIC, reference.columns, current.columns)
    ref, cur = (value_counts(df, names, "double") for df in (reference, current))
    return ks_of_counts(_both_sides(ref, cur, names), task_rows)


def chi2(
    reference: DataFrame, current: DataFrame, names: list[str] | None = None
) -> DataFrame:
    """``feature, statistic, categories, n_ref, n_cur``.

    Expected current counts follow the combined shares; only the current side is
    summed. An empty side gives statistic 0.
    """
    names = _present(names or K.DRIFT_CATEGORICAL, reference.columns, current.columns)
    ref, cur = (value_counts(df, names, "string") for df in (reference, current))
    return _chi2(_both_sides(ref, cur, names))


def kolmogorov_p(distance: Column, n_ref: Column, n_cur: Column) -> Column:
    """Two-sided p-value from the Kolmogorov series with the usual finite-size correction."""
    ref, cur = n_ref.cast("double"), n_cur.cast("double")
    root = F.sqrt(ref * cur / (ref + cur))
    x = (root + 0.12 + 0.11 / root) * distance
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def chi2_p(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom.

    The tail for ``dof`` is that for 1 or 2 plus one term for every two degrees
    more; logarithms of the terms are carried, so that none overflows. The tail
    for 1 is taken as 0 where it is below 1e-13.
    """
    half = statistic / 2
    step = F.log(half)
    odd = dof % 2 == 1

    def grown(total: Column, log_term: Column) -> Column:
        return F.struct(total.alias("total"), log_term.alias("log_term"))

    below = F.aggregate(
        F.sequence(F.lit(0), F.lit(200)),
        F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct((a["total"] + a["term"]).alias("total"), (a["term"] * half / (i + 1.5)).alias("term")),
        lambda a: a["total"],
    )
    one = F.when(half > 28, 0.0).otherwise(
        1 - 2 / math.sqrt(math.pi) * F.sqrt(half) * F.exp(-half) * below
    )
    # the term i of the sum is half^(i + s) e^-half / gamma(i + s + 1), s 0 or -1/2
    shift = F.when(odd, 0.5).otherwise(0.0)
    first = F.when(odd, one).otherwise(0.0)
    start = F.when(odd, -half + 0.5 * step - math.lgamma(1.5)).otherwise(-half)
    terms = F.floor(dof / 2).cast("int")
    numbers = F.when(terms > 0, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        numbers,
        grown(first, start),
        lambda a, i: grown(a["total"] + F.exp(a["log_term"]), a["log_term"] + step - F.log(i + shift)),
        lambda a: a["total"],
    )
    return F.when((dof < 1) | (statistic <= 0), 1.0).otherwise(F.least(total, F.lit(1.0)))


def drift_report(
    reference: DataFrame | Reference,
    current: DataFrame,
    alpha: float = K.DRIFT_ALPHA,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``feature, test, statistic, p_value, drifted``; drifted uses the unrounded p-value.

    Columns missing on either side are not tested.
    """
    known = reference if isinstance(reference, Reference) else fit_reference(reference)
    numeric, categorical = (
        _present(names, known.columns, current.columns) for names in (K.DRIFT_NUMERIC, K.DRIFT_CATEGORICAL)
    )
    found = written(cell_counts(current, numeric, categorical))

    def both(names: list[str], value: str) -> DataFrame:
        sides = (
            df.filter(C("feature").isin(*names)).select("feature", C(value).alias("value"), "n")
            for df in (known.counts, found)
        )
        return _both_sides(*sides, names)

    distances = ks_of_counts(both(numeric, "number"), task_rows).select(
        "feature", "n_ref", "n_cur", "statistic", F.lit("KS").alias("test"),
        kolmogorov_p(C("statistic"), C("n_ref"), C("n_cur")).alias("p"),
    )
    shares = _chi2(both(categorical, "text")).select(
        "feature", "n_ref", "n_cur", "statistic", F.lit("Chi-Square").alias("test"),
        chi2_p(C("statistic"), C("categories") - 1).alias("p"),
    )
    return (
        distances.unionByName(shares)
        .withColumn("p", F.when((C("n_ref") == 0) | (C("n_cur") == 0), 1.0).otherwise(C("p")))
        .select(
            "feature",
            "test",
            half_even(C("statistic"), 4).alias("statistic"),
            half_even(C("p"), 6).alias("p_value"),
            (C("p") < alpha).alias("drifted"),
        )
    )


def drift_summary(report: DataFrame, timestamp: str) -> DataFrame:
    """One row; the report has one row per tested column, so its names fit in one array."""
    tested = F.count(F.lit(1))
    score = F.count_if("drifted") / F.greatest(tested, F.lit(1))
    names = F.sort_array(F.collect_list(F.when(C("drifted"), C("feature"))))
    return report.agg(
        F.lit(timestamp).alias("timestamp"),
        half_even(score, 4).alias("drift_score"),
        names.alias("drifted_features"),
        tested.alias("total_features_tested"),
    ).withColumn("should_retrain", should_retrain())


def should_retrain():
    return C("drift_score") > K.RETRAIN_ABOVE


def append_drift_log(summary: DataFrame, path: str) -> None:
    summary.select(schema.DRIFT_LOG.names).write.mode("append").json(path)


def read_drift_history(spark: SparkSession, path: str) -> DataFrame:
    """All logged summaries, oldest first; empty if nothing was logged yet."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema.DRIFT_LOG)
    log = spark.read.schema(schema.DRIFT_LOG).json(path)
    return log.select(schema.DRIFT_LOG.names).orderBy("timestamp")

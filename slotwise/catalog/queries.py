"""One registered query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise import constants as K, schema
from slotwise.catalog import tables
from slotwise.functions import rules
from slotwise.functions.features import row_features
from slotwise.functions.reasons import ranked_reasons
from slotwise.operators import (
    attribution,
    cleaning,
    dashboard,
    dataset,
    drift,
    drift_windows,
    features,
    history,
    metrics,
    profiles,
    retention,
    rollup,
    scoring,
    training,
)
from slotwise.plans.materialize import shared_folder
from slotwise.sources import artifacts
from slotwise.sources.bookings import read_bookings, read_requests, write_bookings, write_scores
from slotwise.streaming.history import history_stream
from slotwise.streaming.io import stream_bookings, stream_requests, write_stream
from slotwise.streaming.monitoring import drift_stream, noshow_rate_stream, rate_divergence_stream
from slotwise.streaming.scoring import (
    HISTORY,
    enrich_as_of_stream,
    enrich_stream,
    history_snapshot,
    score_stream,
)

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# parameters of the parametrised reports, also used by the SQL side
WINDOW = ("2025-06-01", "2025-08-31")
SOME_BRANCHES = ["Memnagar", "Chandkheda"]
SOME_SERVICES = ["Haircut", "Color", "Bridal"]
AS_OF = "2025-12-01"
SPLIT = "2025-09-16"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places`` digits, so that engines summing in another order agree; dates as text."""

    def shown(f):
        value = C(f"`{f.name}`")
        if f.dataType.typeName() == "double":
            return F.round(value, places).alias(f.name)
        return value.cast("string") if f.dataType.typeName() == "date" else value

    return df.select([shown(f) for f in df.schema.fields])


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{sf_dir.strip('/').replace('/', '_')}"


# --- sources and sinks --------------------------------------------------------


@query
def bookings(spark, sf_dir):
    return tables.bookings(spark, sf_dir)


@query
def bookings_csv(spark, sf_dir):
    path = _folder(spark, sf_dir, "bookings-csv")
    write_bookings(tables.bookings(spark, sf_dir), path, "csv", mode="overwrite")
    return read_bookings(spark, path, "csv").select(schema.BOOKINGS.names)


@query
def request_batches(spark, sf_dir):
    path = _folder(spark, sf_dir, "requests")
    source = tables.bookings(spark, sf_dir).withColumn("month", F.month("booking_datetime").cast("long"))
    batch = F.array(F.struct(*schema.REQUEST.names)).alias("bookings")
    source.select(batch).write.mode("overwrite").json(path)
    return read_requests(spark, path)


@query
def fitted_params(spark, sf_dir):
    path = _folder(spark, sf_dir, "params")
    artifacts.save_params(
        spark, path, features.feature_list(), features.global_rate(tables.bookings(spark, sf_dir))
    )
    params = artifacts.load_params(spark, path)
    payments = ", ".join(f"{k}={v}" for k, v in sorted(params["payment_risk"].items()))
    row = ("|".join(params["feature_names"]), payments, params["global_rate"])
    return rounded(
        spark.createDataFrame([row], "features string, payment_methods string, global_rate double")
    )


@query
def fitted_dims(spark, sf_dir):
    path = _folder(spark, sf_dir, "dims")
    source = tables.bookings(spark, sf_dir)
    artifacts.save_dims(features.fit_staff_rates(source), features.fit_label_maps(source), path)
    rates, maps = artifacts.load_dims(spark, path)
    staff = maps.filter(C("column_name") == "staff_id").select(C("value").alias("staff_id"), "label")
    return rounded(rates.join(staff, "staff_id"))


# --- cleaning -----------------------------------------------------------------


@query
def basics(spark, sf_dir):
    df = cleaning.with_basics(tables.bookings(spark, sf_dir))
    return rounded(
        df.select("booking_id", "outcome_binary", "booking_date", "booking_month", "noshow_rate_hist")
    )


@query
def filtered_bookings(spark, sf_dir):
    df = tables.bookings(spark, sf_dir)
    return cleaning.filter_bookings(df, *WINDOW, SOME_BRANCHES, SOME_SERVICES).select(
        "booking_id", "booking_datetime", "branch", "service_type"
    )


@query
def valid_requests(spark, sf_dir):
    """Accepted requests with their optional fields filled."""
    valid = cleaning.validate_bookings(tables.requests(spark, sf_dir))[0]
    return cleaning.fill_request_defaults(valid, AS_OF)


@query
def rejected_requests(spark, sf_dir):
    rejected = cleaning.validate_bookings(tables.requests(spark, sf_dir))[1]
    return rejected.select(
        "booking_id",
        F.size("violations").alias("n_violations"),
        F.array_join("violations", "; ").alias("reasons"),
    )


@query
def request_defaults(spark, sf_dir):
    return cleaning.fill_request_defaults(tables.requests(spark, sf_dir), AS_OF)


def _with_gaps(spark, sf_dir) -> DataFrame:
    n = C("booking_id").cast("long")
    lead = C("booking_lead_time_hours").cast("double")
    duration = C("service_duration_mins").cast("double")
    return tables.bookings(spark, sf_dir).select(
        "booking_id",
        F.when(n % 7 == 0, float("nan")).when(n % 11 == 0, float("inf")).otherwise(lead).alias("lead"),
        F.when(n % 13 == 0, float("-inf")).when(n % 5 != 0, duration * 1e5).alias("duration"),
        C("past_visit_count").cast("double").alias("visits"),
    )


@query
def sanitized_features(spark, sf_dir):
    names = ["lead", "duration", "visits"]
    return cleaning.sanitize_features(_with_gaps(spark, sf_dir), names)


@query
def nan_report(spark, sf_dir):
    return cleaning.nan_report(_with_gaps(spark, sf_dir), ["lead", "duration", "visits"])


# --- features -----------------------------------------------------------------


def _feature_group(spark, sf_dir, *groups: str) -> DataFrame:
    names = [name for group in groups for name in K.FEATURE_GROUPS[group]]
    df = row_features(tables.bookings(spark, sf_dir))
    return rounded(df.select("booking_id", *[n for n in names if n != "staff_noshow_rate"]))


@query
def features_rates_and_flags(spark, sf_dir):
    return _feature_group(spark, sf_dir, "raw", "rates", "flags")


@query
def features_lead_and_time(spark, sf_dir):
    return _feature_group(spark, sf_dir, "lead", "temporal")


@query
def features_domain(spark, sf_dir):
    return _feature_group(spark, sf_dir, "ordinals", "interactions", "composite")


@query
def staff_rates(spark, sf_dir):
    return rounded(features.fit_staff_rates(tables.bookings(spark, sf_dir)))


@query
def label_maps(spark, sf_dir):
    return features.fit_label_maps(tables.bookings(spark, sf_dir))


def _all_features(spark, sf_dir) -> DataFrame:
    df = tables.bookings(spark, sf_dir)
    return features.full_features(df, *features.fit_tables(df))


@query
def features_fitted(spark, sf_dir):
    names = ["staff_noshow_rate", *K.FEATURE_GROUPS["labels"], "target", "label"]
    return rounded(_all_features(spark, sf_dir).select("booking_id", *names))


@query
def feature_matrix(spark, sf_dir):
    """Every place of the vector as a column of its own."""
    matrix = features.feature_matrix(_all_features(spark, sf_dir)).select(
        "booking_id", vector_to_array("features").alias("x")
    )
    places = [C("x")[i].alias(f"x{i:02d}") for i in range(len(features.feature_list()))]
    return rounded(matrix.select("booking_id", F.size("x").alias("width"), *places), 5)


@query
def feature_ranges(spark, sf_dir):
    return rounded(
        cleaning.feature_ranges(_all_features(spark, sf_dir), features.feature_list()), 5
    )


@query
def target_balance(spark, sf_dir):
    return rounded(features.target_balance(tables.bookings(spark, sf_dir)))


# --- customer profiles and retention ------------------------------------------


@query
def customer_history(spark, sf_dir):
    flagged = tables.bookings(spark, sf_dir).withColumn(
        "cancelled", (C("booking_lead_time_hours") % 10 == 3).cast("int")
    )
    return history.customer_history(flagged).select(
        "booking_id", "customer_id", "prior_visits", "prior_noshows", "prior_cancellations"
    )


@query
def requests_as_of(spark, sf_dir):
    """Every request with its customer's counters at the moment it was made."""
    all_bookings = tables.bookings(spark, sf_dir)
    found = history.history_as_of(all_bookings, all_bookings, history.requested_at())
    return found.select("booking_id", "customer_id", *HISTORY)


@query
def previous_visit(spark, sf_dir):
    """Every request with the last visit before it was made."""
    all_bookings = tables.bookings(spark, sf_dir)
    visits = all_bookings.select(
        "booking_id", "customer_id", "booking_datetime",
        C("branch").alias("previous_branch"), C("outcome").alias("previous_outcome"),
    )
    return history.asof_join(
        all_bookings, visits, ["customer_id"], history.requested_at(), C("booking_datetime"),
        ["previous_branch", "previous_outcome"], ["booking_id"],
    ).select("booking_id", "customer_id", "previous_branch", "previous_outcome")


@query
def customer_profiles(spark, sf_dir):
    return rounded(profiles.customer_profiles(tables.bookings(spark, sf_dir)))


@query
def visit_trend(spark, sf_dir):
    return profiles.visit_trend(tables.bookings(spark, sf_dir))


@query
def ranked_values(spark, sf_dir):
    return profiles.ranked_values(tables.profiles(spark, sf_dir))


@query
def rfm_scores(spark, sf_dir):
    return rounded(retention.rfm_points(profiles.rfm_scores(tables.profiles(spark, sf_dir))))


@query
def segment_summary(spark, sf_dir):
    """End to end from the bookings; the reports below share the written profiles."""
    return retention.segment_summary(profiles.customer_profiles(tables.bookings(spark, sf_dir)))


@query
def revenue_at_risk(spark, sf_dir):
    return rounded(retention.revenue_at_risk(tables.profiles(spark, sf_dir)), 2)


@query
def retention_strategy_metrics(spark, sf_dir):
    return rounded(retention.retention_strategy_metrics(tables.profiles(spark, sf_dir)), 4)


@query
def retention_strategies(spark, sf_dir):
    return retention.retention_strategies(tables.profiles(spark, sf_dir))


@query
def churn_distribution(spark, sf_dir):
    return retention.churn_distribution(tables.profiles(spark, sf_dir))


@query
def segment_breakdown(spark, sf_dir):
    return rounded(retention.segment_breakdown(tables.profiles(spark, sf_dir)), 4)


@query
def trend_breakdown(spark, sf_dir):
    return rounded(retention.trend_breakdown(tables.profiles(spark, sf_dir)), 4)


@query
def overall_kpis(spark, sf_dir):
    return rounded(retention.overall_kpis(tables.profiles(spark, sf_dir)), 4)


@query
def retention_actions(spark, sf_dir):
    df = retention.with_recovery_priority(tables.profiles(spark, sf_dir))
    return rounded(df.select("customer_id", "recovery_priority", "suggested_action"))


@query
def at_risk_customers(spark, sf_dir):
    df = retention.at_risk_customers(tables.profiles(spark, sf_dir))
    return rounded(
        df.select(
            "customer_id", "segment", "total_bookings", "noshow_rate", "days_since_last_visit",
            "estimated_ltv", "churn_risk", "recovery_priority", "suggested_action",
        )
    )


@query
def upgrade_opportunities(spark, sf_dir):
    df = retention.upgrade_opportunities(tables.profiles(spark, sf_dir))
    return df.select("customer_id", "segment", "total_bookings", "upgrade_target", "visits_needed")


@query
def churn_histogram(spark, sf_dir):
    return retention.churn_histogram(tables.profiles(spark, sf_dir))


# --- reports over bookings ----------------------------------------------------


@query
def executive_kpis(spark, sf_dir):
    return rounded(dashboard.executive_kpis(tables.bookings(spark, sf_dir)))


@query
def period_delta(spark, sf_dir):
    df = tables.bookings(spark, sf_dir)
    return rounded(dashboard.period_delta(df, *WINDOW, SOME_BRANCHES, SOME_SERVICES))


@query
def noshow_trend_daily(spark, sf_dir):
    return rounded(dashboard.noshow_trend(tables.bookings(spark, sf_dir), "day"))


@query
def noshow_trend_weekly(spark, sf_dir):
    return rounded(dashboard.noshow_trend(tables.bookings(spark, sf_dir), "week"))


@query
def branch_impact(spark, sf_dir):
    return dashboard.branch_impact(tables.bookings(spark, sf_dir))


@query
def manual_risk(spark, sf_dir):
    df = dashboard.with_manual_risk(tables.bookings(spark, sf_dir))
    return rounded(
        df.select(
            "booking_id",
            "risk_score",
            "risk_tier",
            rules.recommended_action(C("risk_tier")).alias("recommended_action"),
            rules.would_flag(C("risk_score"), 0.3).alias("would_flag"),
        )
    )


@query
def risk_tier_distribution(spark, sf_dir):
    return dashboard.risk_tier_distribution(tables.bookings(spark, sf_dir))


@query
def branch_service_heatmap(spark, sf_dir):
    return rounded(dashboard.branch_service_heatmap(tables.bookings(spark, sf_dir)))


@query
def branch_service_pivot(spark, sf_dir):
    return rounded(dashboard.branch_service_pivot(tables.bookings(spark, sf_dir)))


@query
def hour_dow_heatmap(spark, sf_dir):
    return rounded(dashboard.hour_dow_heatmap(tables.bookings(spark, sf_dir)))


@query
def repeat_vs_new(spark, sf_dir):
    return dashboard.repeat_vs_new(tables.bookings(spark, sf_dir))


@query
def lead_time_histogram(spark, sf_dir):
    return dashboard.lead_time_histogram(tables.bookings(spark, sf_dir))


@query
def payment_noshow(spark, sf_dir):
    return rounded(dashboard.payment_noshow(tables.bookings(spark, sf_dir)))


@query
def booking_segment_distribution(spark, sf_dir):
    return dashboard.booking_segment_distribution(tables.bookings(spark, sf_dir))


@query
def dataset_summary(spark, sf_dir):
    return rounded(dataset.dataset_summary(tables.bookings(spark, sf_dir)))


@query
def noshow_by(spark, sf_dir):
    return rounded(dataset.noshow_by(tables.bookings(spark, sf_dir)))


@query
def cohort_rates(spark, sf_dir):
    return rounded(dataset.cohort_rates(tables.bookings(spark, sf_dir)))


@query
def signal_spread(spark, sf_dir):
    return rounded(dataset.signal_spread(tables.bookings(spark, sf_dir)))


@query
def peak_times(spark, sf_dir):
    return dataset.peak_times(tables.bookings(spark, sf_dir))


@query
def risk_combos(spark, sf_dir):
    return rounded(dataset.risk_combos(tables.bookings(spark, sf_dir)))


@query
def filter_options(spark, sf_dir):
    return dashboard.filter_options(tables.bookings(spark, sf_dir))


@query
def rolling_window(spark, sf_dir):
    return dashboard.last_days(tables.bookings(spark, sf_dir), AS_OF).select("booking_id", "outcome")


@query
def upcoming_high_risk(spark, sf_dir):
    df = dashboard.upcoming_high_risk(tables.bookings(spark, sf_dir), AS_OF)
    return rounded(df.select("booking_id", "booking_datetime", "risk_score", "risk_tier"))


@query
def revenue_recovery(spark, sf_dir):
    return rounded(dashboard.revenue_recovery(tables.bookings(spark, sf_dir)), 2)


@query
def noshow_by_derived(spark, sf_dir):
    return rounded(dashboard.noshow_by_derived(tables.bookings(spark, sf_dir)))


@query
def noshow_correlation(spark, sf_dir):
    return rounded(dashboard.noshow_correlation(tables.bookings(spark, sf_dir)))


@query
def risk_factors(spark, sf_dir):
    df = tables.bookings(spark, sf_dir)
    return df.select("booking_id", ranked_reasons(df.columns).alias("found")).select(
        "booking_id", F.size("found").alias("n"), F.array_join("found", " | ").alias("factors")
    )


# --- metrics over a score that needs no model -----------------------------------


def _scored(spark, sf_dir) -> DataFrame:
    df = features.add_target(row_features(tables.bookings(spark, sf_dir)))
    return df.select("booking_id", "label", F.round("risk_score_v2", 6).alias("score"))


@query
def class_weights(spark, sf_dir):
    return rounded(training.class_weights(features.add_target(tables.bookings(spark, sf_dir))))


@query
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_scored(spark, sf_dir)))


@query
def precision_recall(spark, sf_dir):
    return metrics.precision_recall(_scored(spark, sf_dir))


@query
def best_f1_threshold(spark, sf_dir):
    return rounded(metrics.best_f1_threshold(_scored(spark, sf_dir)))


@query
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(_scored(spark, sf_dir), 0.15))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir), 0.15)


@query
def calibration_curve(spark, sf_dir):
    return rounded(metrics.calibration_curve(_scored(spark, sf_dir)))


@query
def rate_divergence(spark, sf_dir):
    return rounded(metrics.rate_divergence(_scored(spark, sf_dir)))


@query
def soft_vote(spark, sf_dir):
    df = dashboard.with_manual_risk(row_features(tables.bookings(spark, sf_dir)))
    votes = ["risk_score", "risk_score_v2", "noshow_intensity"]
    return rounded(df.select("booking_id", training.soft_vote(votes).alias("score")))


def _three_scores(spark, sf_dir) -> DataFrame:
    """``model_name, label, score`` of three scores that need no model."""
    df = dashboard.with_manual_risk(row_features(tables.bookings(spark, sf_dir)))
    names = ["risk_score", "risk_score_v2", "noshow_intensity"]
    each = F.array(*[F.struct(F.lit(n).alias("model_name"), F.round(C(n), 6).alias("score")) for n in names])
    return features.add_target(df).select("label", F.inline(each))


@query
def score_comparison(spark, sf_dir):
    """The comparison report over three scores, written and read back."""
    path = _folder(spark, sf_dir, "score-comparison")
    artifacts.write_model_comparison(metrics.compare_models(_three_scores(spark, sf_dir)), path)
    return rounded(spark.read.option("header", True).option("inferSchema", True).csv(path))


@query
def score_calibration(spark, sf_dir):
    """The calibration report over three scores, written and read back."""
    path = _folder(spark, sf_dir, "score-calibration")
    artifacts.write_calibration(
        metrics.calibration_curve(_three_scores(spark, sf_dir), keys=["model_name"]), path
    )
    return rounded(
        spark.read.schema("model_name string, bin int, fraction_positives double, mean_predicted double").json(path)
    )


# --- reports from daily partials ---------------------------------------------------


def _stored(spark, sf_dir, *filters) -> DataFrame:
    return rollup.read_rollup(spark, tables.rollup(spark, sf_dir, *WINDOW), *filters)


@query
def rollup_kpis(spark, sf_dir):
    return rounded(rollup.executive_kpis(_stored(spark, sf_dir, *WINDOW, SOME_BRANCHES, SOME_SERVICES)))


@query
def rollup_trend(spark, sf_dir):
    return rounded(rollup.noshow_trend(_stored(spark, sf_dir, *WINDOW), "week"))


@query
def rollup_summary(spark, sf_dir):
    """The summary from all partials, and whether its customers are within 5 % of the exact number."""
    exact = tables.bookings(spark, sf_dir).agg(F.count_distinct("customer_id")).scalar()
    found = rollup.dataset_summary(_stored(spark, sf_dir))
    close = F.abs(C("customers") - exact) <= 0.05 * exact
    return rounded(found.withColumn("customers_close", close).drop("customers"))


# --- drift ----------------------------------------------------------------------


def _periods(spark, sf_dir, shifted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bookings before and after the split; the shifted case loses its cash bookings."""
    df = tables.bookings(spark, sf_dir)
    split = F.lit(SPLIT).cast("date").cast("timestamp_ntz")
    current = df.filter(C("booking_datetime") >= split)
    if shifted:
        current = current.filter(C("payment_method") != "Cash")
    return df.filter(C("booking_datetime") < split), current


@query
def drift_numeric(spark, sf_dir):
    return rounded(drift.ks_2samp(*_periods(spark, sf_dir)))


@query
def drift_categorical(spark, sf_dir):
    return rounded(drift.chi2(*_periods(spark, sf_dir, shifted=True)), 3)


@query
def drift_report(spark, sf_dir):
    return drift.drift_report(*_periods(spark, sf_dir, shifted=True))


@query
def drift_history(spark, sf_dir):
    path = _folder(spark, sf_dir, f"drift-log-{spark.sparkContext.startTime}")
    for day, shifted in (("2026-03-16", False), ("2026-03-17", True)):
        report = drift.drift_report(*_periods(spark, sf_dir, shifted))
        drift.append_drift_log(drift.drift_summary(report, day), path)
    return _flat(drift.read_drift_history(spark, path))


@query
def drift_by_window(spark, sf_dir):
    """Exact distance per window of the second period, and whether that of the sketches is in its bound."""
    before, after = _periods(spark, sf_dir)
    panes = drift_windows.pane_sketches(after)
    sketched = drift_windows.window_drift(
        drift_windows.reference_sketches(before), drift_windows.window_sketches(panes)
    )
    exact = drift_windows.exact_window_drift(before, after)
    gap = F.abs(C("sketched") - C("statistic"))
    return rounded(
        exact.join(
            sketched.select("window_start", "feature", C("statistic").alias("sketched"), "lowest", "highest"),
            ["window_start", "feature"],
        ).select(
            "window_start", "feature", "n_ref", "n_cur", "statistic", "lowest", "highest",
            (gap <= drift_windows.error_bound()).alias("sketch_within_bound"),
        )
    )


@query
def stream_drift_panes(spark, sf_dir):
    """Panes that a stream stored as sketches, put together from its batches."""
    path = _in_files(spark, sf_dir, "panes-in", _periods(spark, sf_dir))
    source = stream_bookings(spark, path, files_per_trigger=2)
    out = _run(spark, sf_dir, "panes", lambda out, mark: drift_windows.drift_sketch_stream(source, out, mark))
    panes = drift_windows.compact_panes(drift_windows.read_panes(spark, out))
    n = F.kll_sketch_get_n_double("sketch").alias("n")
    return rounded(panes.select("pane", "feature", n, "lowest", "highest"))


def _flat(log: DataFrame) -> DataFrame:
    return log.withColumn("drifted_features", F.array_join("drifted_features", ", "))


# --- models -----------------------------------------------------------------------


@query
def stratified_folds(spark, sf_dir):
    """Every booking with its fold of five."""
    df = features.add_target(tables.bookings(spark, sf_dir))
    return training.stratified_folds(df).select("booking_id", "label", "fold")


@query
def sampled_rows(spark, sf_dir):
    """The 5,000 bookings that come first in the order of their digests."""
    return attribution.sample_rows(tables.bookings(spark, sf_dir)).select("booking_id", "outcome")


@query
def model_comparison(spark, sf_dir):
    path = _folder(spark, sf_dir, "model-comparison")
    artifacts.write_model_comparison(tables.trained(spark, sf_dir).comparison, path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


@query
def model_calibration(spark, sf_dir):
    path = _folder(spark, sf_dir, "calibration")
    artifacts.write_calibration(tables.trained(spark, sf_dir).calibration, path)
    return spark.read.schema(
        "model_name string, bin int, fraction_positives double, mean_predicted double"
    ).json(path)


@query
def scored_bookings(spark, sf_dir):
    requests = tables.bookings(spark, sf_dir).select("booking_id", *_request_columns())
    scored = scoring.score(requests, tables.trained(spark, sf_dir), AS_OF)
    path = _folder(spark, sf_dir, "scores")
    write_scores(scored, path, by_tier=True, mode="overwrite")
    return spark.read.schema(scored.schema).parquet(path)


def _request_columns() -> list[str]:
    return [name for name in schema.REQUEST.names if name != "month"]


@query
def scored_fast(spark, sf_dir):
    requests = tables.requests(spark, sf_dir)
    return scoring.score_fast(requests, tables.trained(spark, sf_dir), AS_OF)


@query
def model_info(spark, sf_dir):
    path = _folder(spark, sf_dir, "model")
    artifacts.save_model(spark, tables.trained(spark, sf_dir), path)
    return scoring.model_info(spark, artifacts.load_model(spark, path))


@query
def feature_importance(spark, sf_dir):
    """Top 15 by impurity importance of the forest."""
    return attribution.feature_importances(
        tables.trained(spark, sf_dir).models[training.FOREST]
    ).limit(15)


def _attribution_frame(spark, sf_dir) -> DataFrame:
    """Features of all bookings."""
    model = tables.trained(spark, sf_dir)
    full = features.full_features(tables.bookings(spark, sf_dir), model.staff_rates, model.label_maps, model.overall)
    return features.feature_matrix(full).select("booking_id", "label", "features")


@query
def permutation_importance(spark, sf_dir):
    model = tables.trained(spark, sf_dir).models[training.FOREST]
    return attribution.permutation_importance(_attribution_frame(spark, sf_dir), model)


@query
def contribution_importance(spark, sf_dir):
    path = _folder(spark, sf_dir, "feature-importance")
    found = attribution.attribute(tables.trained(spark, sf_dir), _attribution_frame(spark, sf_dir))
    artifacts.write_feature_importance(found.filter("is_primary"), path)
    return found


@query
def shapley_values(spark, sf_dir):
    """Attribution of every booking's score under the best boosted model, written and read back."""
    model = tables.trained(spark, sf_dir)
    best = model.models[attribution.best_tree_models(model, 1)[0]]
    found = attribution.shapley_values(_attribution_frame(spark, sf_dir), best, model.feature_names)
    path = _folder(spark, sf_dir, "contributions")
    artifacts.write_contributions(found, path)
    return spark.read.schema(found.schema).parquet(path).select(found.columns)


# --- streams ------------------------------------------------------------------------


def _in_files(spark, sf_dir, name: str, parts: list[DataFrame]) -> str:
    """Write the parts one after the other, two files each: the source of a stream.

    File streams take older files first, so with two files per trigger each part is
    one micro-batch.
    """
    path = _folder(spark, sf_dir, name)
    for number, part in enumerate(parts):
        mode = "append" if number else "overwrite"
        part.repartitionByRange(2, "booking_id").write.mode(mode).parquet(path)
    return path


def _run(spark, sf_dir, name: str, start) -> str:
    """Run one stream in new folders and return the folder of its results."""
    root = f"{_folder(spark, sf_dir, name)}-{uuid.uuid4().hex[:8]}"
    start(f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


@query
def stream_noshow_rate(spark, sf_dir):
    source = _in_files(spark, sf_dir, "rate-in", _periods(spark, sf_dir))
    rates = noshow_rate_stream(stream_bookings(spark, source, files_per_trigger=2))
    out = _run(spark, sf_dir, "rate", lambda path, mark: write_stream(rates, path, mark))
    return rounded(spark.read.schema(rates.schema).parquet(out))


@query
def stream_rate_divergence(spark, sf_dir):
    """Rule scores of a request stream meet the outcomes, which come as a stream of their own."""
    parts = _periods(spark, sf_dir)
    requests = [part.drop("outcome") for part in parts]
    asked = _in_files(spark, sf_dir, "divergence-requests", requests)
    known = _in_files(spark, sf_dir, "divergence-outcomes", parts)
    scored = dashboard.with_manual_risk(stream_bookings(spark, asked, files_per_trigger=2))
    rates = rate_divergence_stream(
        scored.withColumnRenamed("risk_score", "score"),
        stream_bookings(spark, known, files_per_trigger=2),
    )
    out = _run(spark, sf_dir, "divergence", lambda path, mark: write_stream(rates, path, mark))
    return rounded(spark.read.schema(rates.schema).parquet(out))


@query
def stream_history(spark, sf_dir):
    path = _in_files(spark, sf_dir, "history-in", _periods(spark, sf_dir))
    source = stream_bookings(spark, path, files_per_trigger=2)
    out = _run(spark, sf_dir, "history", lambda out, mark: history_stream(source, out, mark))
    return spark.read.parquet(out).drop("batch")


@query
def stream_enriched(spark, sf_dir):
    before, after = _periods(spark, sf_dir)
    path = _in_files(spark, sf_dir, "enrich-in", [after])
    source, past = stream_bookings(spark, path), history_snapshot(before)
    out = _run(spark, sf_dir, "enrich", lambda out, mark: enrich_stream(source, past, out, mark))
    return spark.read.parquet(out).select("booking_id", "customer_id", *HISTORY)


@query
def stream_enriched_as_of(spark, sf_dir):
    """Requests of the second period, each with the bookings before it was made."""
    path = _in_files(spark, sf_dir, "as-of-in", [_periods(spark, sf_dir)[1]])
    source, past = stream_bookings(spark, path), tables.bookings(spark, sf_dir)
    out = _run(
        spark,
        sf_dir,
        "as-of",
        lambda out, mark: enrich_as_of_stream(source, past, history.requested_at(), out, mark),
    )
    return spark.read.parquet(out).select("booking_id", "customer_id", *HISTORY)


@query
def stream_scored(spark, sf_dir):
    model = tables.trained(spark, sf_dir)
    path = _folder(spark, sf_dir, "score-in")
    tables.requests(spark, sf_dir).drop("booking_id").repartition(2).write.mode("overwrite").json(path)
    scored = score_stream(stream_requests(spark, path), model, AS_OF)
    out = _run(spark, sf_dir, "score", lambda out, mark: write_stream(scored, out, mark))
    return spark.read.schema(scored.schema).parquet(out)


@query
def stream_drift(spark, sf_dir):
    before, after = _periods(spark, sf_dir, shifted=True)
    reference = drift.fit_reference(before)
    middle = F.lit(AS_OF).cast("date").cast("timestamp_ntz")
    halves = [after.filter(C("booking_datetime") < middle), after.filter(C("booking_datetime") >= middle)]
    path = _in_files(spark, sf_dir, "drift-in", halves)
    source = stream_bookings(spark, path, files_per_trigger=2)
    out = _run(spark, sf_dir, "drift", lambda out, mark: drift_stream(source, reference, out, mark))
    return _flat(drift.read_drift_history(spark, out))

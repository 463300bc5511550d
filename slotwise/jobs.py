"""Whole jobs for spark-submit: ``python -m slotwise.jobs train --bookings ... --out ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise import constants as K
from slotwise.operators import (
    attribution,
    cleaning,
    dashboard,
    dataset,
    drift,
    features,
    profiles,
    retention,
    scoring,
    training,
)
from slotwise.plans.materialize import materialize
from slotwise.sources import artifacts
from slotwise.sources.bookings import read_bookings, read_requests, write_scores


def _write_report(df: DataFrame, path: str) -> None:
    """A report has a handful of rows: one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def train(
    spark: SparkSession,
    bookings: DataFrame,
    out: str,
    settings: training.Settings = training.Settings(),
) -> training.Trained:
    """Train, compare, attribute and save: ``model``, three reports and feature ranges."""
    trained = training.train_all(bookings, settings)
    artifacts.save_model(spark, trained, f"{out}/model")
    artifacts.write_model_comparison(trained.comparison, f"{out}/model_comparison")
    artifacts.write_calibration(trained.calibration, f"{out}/calibration")

    def full(df: DataFrame) -> DataFrame:
        return features.full_features(
            df, trained.staff_rates, trained.label_maps, trained.overall
        )

    known = bookings.filter(F.col("outcome").isNotNull())
    sample = features.feature_matrix(full(known))
    frame = sample.select("booking_id", "label", "features")
    for place, name in enumerate(attribution.best_tree_models(trained)):
        found = attribution.contribution_importance(frame, trained.models[name])
        folder = "primary" if place == 0 else "secondary"
        artifacts.write_feature_importance(
            found.withColumn("model_name", F.lit(name)), f"{out}/feature_importance/{folder}"
        )
    _write_report(cleaning.feature_ranges(full(known), K.FEATURES), f"{out}/feature_ranges")
    return trained


def retain(spark: SparkSession, bookings: DataFrame, out: str, ref_date: str) -> None:
    """Write customer profiles once, then every retention report from them."""
    scored = profiles.rfm_scores(materialize(profiles.customer_profiles(bookings, ref_date)))
    scored.write.mode("overwrite").parquet(f"{out}/profiles")
    customers = spark.read.schema(scored.schema).parquet(f"{out}/profiles")
    reports = {
        "segment_summary": retention.segment_summary,
        "strategies": retention.retention_strategies,
        "at_risk_customers": retention.at_risk_customers,
        "revenue_at_risk": retention.revenue_at_risk,
        "churn_distribution": retention.churn_distribution,
        "churn_histogram": retention.churn_histogram,
        "segment_breakdown": retention.segment_breakdown,
        "trend_breakdown": retention.trend_breakdown,
        "overall_kpis": retention.overall_kpis,
    }
    for name, report in reports.items():
        _write_report(report(customers), f"{out}/{name}")
    # one row per customer near an upgrade: as large as the customer base
    retention.upgrade_opportunities(customers).write.mode("overwrite").parquet(
        f"{out}/upgrade_opportunities"
    )


def overview(bookings: DataFrame, out: str) -> None:
    """The booking reports, over already filtered bookings."""
    reports = {
        "executive_kpis": dashboard.executive_kpis,
        "noshow_trend_daily": dashboard.noshow_trend,
        "noshow_trend_weekly": lambda df: dashboard.noshow_trend(df, "week"),
        "branch_impact": dashboard.branch_impact,
        "risk_tiers": dashboard.risk_tier_distribution,
        "branch_service_heatmap": dashboard.branch_service_heatmap,
        "hour_dow_heatmap": dashboard.hour_dow_heatmap,
        "repeat_vs_new": dashboard.repeat_vs_new,
        "lead_time_histogram": dashboard.lead_time_histogram,
        "payment_noshow": dashboard.payment_noshow,
        "booking_segments": dashboard.booking_segment_distribution,
        "dataset_summary": dataset.dataset_summary,
        "noshow_by": dataset.noshow_by,
        "cohort_rates": dataset.cohort_rates,
        "peak_times": dataset.peak_times,
        "risk_combos": dataset.risk_combos,
    }
    for name, report in reports.items():
        _write_report(report(bookings), f"{out}/{name}")


def score(spark: SparkSession, model: str, requests: str, out: str, as_of: str) -> None:
    """Score the valid requests of JSON batches; the rejected ones are written with reasons."""
    valid, rejected = cleaning.validate_bookings(read_requests(spark, requests))
    trained = artifacts.load_model(spark, model)
    write_scores(scoring.score(valid, trained, as_of), f"{out}/scores", mode="overwrite")
    rejected.write.mode("overwrite").json(f"{out}/rejected")


def check_drift(
    reference: DataFrame, current: DataFrame, out: str, log: str, timestamp: str
) -> None:
    report = drift.drift_report(reference, current)
    _write_report(report, f"{out}/drift_report")
    drift.append_drift_log(drift.drift_summary(report, timestamp), log)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="slotwise.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("train", "retain", "overview", "score", "drift"):
        job = jobs.add_parser(name)
        job.add_argument("--out", required=True)
        job.add_argument("--format", default="parquet")
        if name != "score":
            job.add_argument("--bookings", required=True)
        if name == "retain":
            job.add_argument("--ref-date", default=K.REFERENCE_DATE)
        if name == "overview":
            job.add_argument("--first-day")
            job.add_argument("--last-day")
            job.add_argument("--branch", action="append")
            job.add_argument("--service", action="append")
        if name == "score":
            job.add_argument("--model", required=True)
            job.add_argument("--requests", required=True)
            job.add_argument("--as-of", required=True)
        if name == "drift":
            job.add_argument("--reference", required=True)
            job.add_argument("--log", required=True)
            job.add_argument("--timestamp", required=True)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"slotwise-{args.job}").getOrCreate()

    def bookings(path: str) -> DataFrame:
        return read_bookings(spark, path, args.format)

    if args.job == "train":
        train(spark, bookings(args.bookings), args.out)
    elif args.job == "retain":
        retain(spark, bookings(args.bookings), args.out, args.ref_date)
    elif args.job == "overview":
        chosen = cleaning.filter_bookings(
            bookings(args.bookings), args.first_day, args.last_day, args.branch, args.service
        )
        overview(chosen, args.out)
    elif args.job == "score":
        score(spark, args.model, args.requests, args.out, args.as_of)
    else:
        check_drift(
            bookings(args.reference), bookings(args.bookings), args.out, args.log, args.timestamp
        )


if __name__ == "__main__":
    main()

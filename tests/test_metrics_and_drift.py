import math

import pytest
from pyspark.sql import functions as F

from slotwise.operators import drift, metrics


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.4), (1, 0.4), (0, 0.1), (0, 0.1), (1, 0.1)]
    return spark.createDataFrame([(float(a), b) for a, b in rows], "label double, score double")


def pairs_auc(rows):
    pos = [s for label, s in rows if label == 1]
    neg = [s for label, s in rows if label == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / len(pos) / len(neg)


def test_auc_counts_ties_half(scored):
    rows = [tuple(r) for r in scored.collect()]
    assert metrics.roc_auc(scored).first()[0] == pytest.approx(pairs_auc(rows))


def test_auc_of_one_class_is_null(scored):
    assert metrics.roc_auc(scored.filter("label = 1")).first()[0] is None


def test_best_threshold_is_the_lowest_of_the_best(spark):
    rows = [(1.0, 0.9), (1.0, 0.5), (0.0, 0.2)]
    best = metrics.best_f1_threshold(spark.createDataFrame(rows, "label double, score double")).first()
    assert best["threshold"] == 0.5 and best["best_f1"] == pytest.approx(1.0)
    none = metrics.best_f1_threshold(spark.createDataFrame([], "label double, score double")).first()
    assert none["threshold"] == 0.5 and none["best_f1"] is None


def test_metrics_and_matrix_at_a_threshold(scored):
    row = metrics.metrics_at(scored, 0.8).first()
    assert (row["precision"], row["recall"], row["accuracy"]) == (2 / 3, 0.5, 5 / 8)
    cells = {(r["label"], r["predicted"]): r["bookings"] for r in
             metrics.confusion_matrix(scored, 0.8).collect()}
    assert cells == {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 1): 2}


def test_compare_models_agrees_with_the_single_metrics(scored):
    long = scored.withColumn("model_name", F.lit("a")).unionByName(
        scored.withColumn("model_name", F.lit("b")).withColumn("score", 1 - F.col("score"))
    )
    rows = {r["model_name"]: r for r in metrics.compare_models(long).collect()}
    best = metrics.best_f1_threshold(scored).first()
    single = metrics.binary_metrics(scored, best["threshold"]).first()
    assert rows["a"]["optimal_threshold"] == best["threshold"]
    assert all(rows["a"][n] == pytest.approx(single[n]) for n in single.asDict())
    assert rows["a"]["f1_default_thresh"] == pytest.approx(metrics.metrics_at(scored, 0.5).first()["f1"])
    assert rows["b"]["roc_auc"] == pytest.approx(1 - rows["a"]["roc_auc"])
    assert sum(map(sum, rows["a"]["confusion_matrix"])) == 8


def test_calibration_bins_are_right_closed_and_empty_ones_absent(spark):
    rows = [(0.0, 0.0), (1.0, 0.1), (0.0, 0.11), (1.0, 1.0)]
    bins = metrics.calibration_curve(spark.createDataFrame(rows, "label double, score double"))
    assert {r["bin"]: r["bookings"] for r in bins.collect()} == {0: 2, 1: 1, 9: 1}


def test_ks_against_a_direct_computation(spark):
    left = [1.0, 2.0, 2.0, 3.0, float("nan"), None]
    right = [2.0, 3.0, 4.0]
    make = lambda values: spark.createDataFrame([(v,) for v in values], "x double")
    row = drift.ks_2samp(make(left), make(right), ["x"]).first()
    assert row["n_ref"] == 4 and row["n_cur"] == 3
    assert row["statistic"] == pytest.approx(0.75 - 1 / 3)


def test_chi_square_uses_the_current_side_only(spark):
    make = lambda text: spark.createDataFrame([(c,) for c in text], "x string")
    row = drift.chi2(make("aabb"), make("aaab"), ["x"]).first()
    expected_a, expected_b = 5 * 4 / 8, 3 * 4 / 8
    assert row["statistic"] == pytest.approx(
        (3 - expected_a) ** 2 / expected_a + (1 - expected_b) ** 2 / expected_b
    )
    assert drift.chi2(make("aab"), make(""), ["x"]).first()["statistic"] == 0.0


@pytest.mark.parametrize(
    "statistic,dof,p",
    [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (14.06714, 7, 0.05),
     (13.27670, 4, 0.01), (0.0, 3, 1.0), (3000.0, 9, 0.0), (2000.0, 2000, 0.495795), (100.0, 1, 0.0)],
)
def test_chi_square_tail(spark, statistic, dof, p):
    tail = drift.chi2_p(F.lit(float(statistic)), F.lit(dof))
    assert spark.range(1).select(tail).first()[0] == pytest.approx(p, abs=1e-6)


def test_kolmogorov_tail(spark):
    def tail(d, n):
        value = drift.kolmogorov_p(F.lit(float(d)), F.lit(n), F.lit(n))
        return spark.range(1).select(value).first()[0]

    # asymptotic 5 % point of the two-sided statistic
    n = 10**8
    d = 1.358099 / math.sqrt(n * n / (2 * n))
    assert tail(d, n) == pytest.approx(0.05, abs=1e-4)
    assert tail(0.0, 10) == 1.0
    assert tail(1.0, 1000) < 1e-12


def test_report_of_a_set_against_itself_finds_nothing(bookings):
    rows = drift.drift_report(bookings, bookings).collect()
    assert len(rows) == 10 and not any(r["drifted"] for r in rows)
    assert {r["p_value"] for r in rows} == {1.0}


def test_report_finds_the_missing_payment_method_and_logs_it(spark, bookings, tmp_path):
    reference = drift.fit_reference(bookings)
    current = bookings.filter("payment_method <> 'Cash'").drop("branch")
    report = drift.drift_report(reference, current)
    rows = {r["feature"]: r for r in report.collect()}
    assert len(rows) == 9 and rows["payment_method"]["drifted"]
    log = str(tmp_path / "log")
    assert drift.read_drift_history(spark, log).count() == 0
    for day in ("2026-01-02", "2026-01-01"):
        drift.append_drift_log(drift.drift_summary(report, day), log)
    history = drift.read_drift_history(spark, log).collect()
    assert [r["timestamp"] for r in history] == ["2026-01-01", "2026-01-02"]
    assert history[0]["total_features_tested"] == 9
    assert history[0]["drifted_features"] == sorted(n for n, r in rows.items() if r["drifted"])
    assert history[0]["should_retrain"] == (history[0]["drift_score"] > 0.3)


def test_empty_current_side(bookings):
    rows = drift.drift_report(bookings, bookings.limit(0)).collect()
    assert not any(r["drifted"] for r in rows)

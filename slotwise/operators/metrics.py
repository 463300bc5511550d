"""Classification metrics over a scored table with ``label`` (0/1) and ``score``.

Scores are counted per distinct value first; ranks and precision-recall points
then come from running sums over distinct scores, which keeps ties exact. The
positive class is No-Show (label 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slotwise.plans.dims import left_lookup
from slotwise.plans.materialize import written
from slotwise.plans.ordered import TASK_ROWS, prior_sums

C = F.col


def score_counts(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score, written once for the jobs that follow."""
    positive = C("label") == 1
    return written(
        scored.groupBy(*(keys or []), "score").agg(
            F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
        )
    )


def roc_auc(
    scored: DataFrame, keys: list[str] | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``roc_auc`` (per key): chance that a positive outranks a negative, ties count half."""
    return auc_of_counts(score_counts(scored, keys), keys or [], task_rows)


def auc_of_counts(counts: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``roc_auc`` from ``pos`` and ``neg`` per score."""
    below = prior_sums(counts, keys, ["score"], {"neg_below": C("neg")}, task_rows)
    wins = C("pos") * (C("neg_below") + C("neg") / 2)
    totals = below.groupBy(*keys).agg(
        F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    return totals.select(
        *keys, F.when((C("p") > 0) & (C("n") > 0), C("wins") / C("p") / C("n")).alias("roc_auc")
    )


def precision_recall(
    scored: DataFrame, keys: list[str] | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``score, tp, fp, positives`` when everything at or above ``score`` is called positive."""
    return _points(score_counts(scored, keys), keys or [], task_rows)


def _points(counts: DataFrame, keys: list[str], task_rows: int) -> DataFrame:
    downwards = counts.withColumn("below_top", -C("score"))
    above = prior_sums(
        downwards, keys, ["below_top"], {"tp_above": C("pos"), "fp_above": C("neg")}, task_rows
    )
    points = above.select(
        *keys,
        "score",
        (C("tp_above") + C("pos")).alias("tp"),
        (C("fp_above") + C("neg")).alias("fp"),
    )
    if not keys:
        return points.withColumn("positives", counts.agg(F.sum("pos")).scalar())
    return left_lookup(points, counts.groupBy(*keys).agg(F.sum("pos").alias("positives")), keys)


def best_f1_threshold(
    scored: DataFrame, keys: list[str] | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``threshold, best_f1``: the lowest score with the highest F1; 0.5 if there are no rows."""
    return _threshold(score_counts(scored, keys), keys or [], task_rows)


def _threshold(counts: DataFrame, keys: list[str], task_rows: int) -> DataFrame:
    precision = C("tp") / (C("tp") + C("fp"))
    recall = F.when(C("positives") > 0, C("tp") / C("positives")).otherwise(1.0)
    f1 = 2 * (precision * recall) / (precision + recall + 1e-8)
    highest = F.max(F.struct(f1.alias("f1"), (-C("score")).alias("minus_score")))
    return (
        _points(counts, keys, task_rows)
        .groupBy(*keys)
        .agg(highest.alias("best"))
        .select(
            *keys,
            F.coalesce(-C("best.minus_score"), F.lit(0.5)).alias("threshold"),
            C("best.f1").alias("best_f1"),
        )
    )


def confusion_matrix(scored: DataFrame, threshold: float) -> DataFrame:
    """``label, predicted, bookings`` with all four cells."""
    predicted = (C("score") >= threshold).cast("int")
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    counted = scored.agg(
        *[
            F.count_if((C("label") == a) & (predicted == b)).alias(f"cell_{a}{b}")
            for a, b in cells
        ]
    )
    rows = [
        F.struct(
            F.lit(a).alias("label"), F.lit(b).alias("predicted"), C(f"cell_{a}{b}").alias("bookings")
        )
        for a, b in cells
    ]
    return counted.select(F.inline(F.array(*rows)))


def _ratios(suffix: str = "") -> list:
    """Metrics from ``tp, fp, fn, tn`` columns; an undefined ratio is 0."""
    tp, fp, fn, tn = (C(name + suffix) for name in ("tp", "fp", "fn", "tn"))

    def ratio(part, whole):
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return [
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1" + suffix),
        ratio(tp, tp + fp).alias("precision" + suffix),
        ratio(tp, tp + fn).alias("recall" + suffix),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy" + suffix),
    ]


def _cells(called, suffix: str = "") -> list:
    """``tp, fp, fn, tn`` as sums over score counts."""

    def total(condition, side):
        return F.coalesce(F.sum(F.when(condition, C(side))), F.lit(0))

    return [
        total(called, "pos").alias("tp" + suffix),
        total(called, "neg").alias("fp" + suffix),
        total(~called, "pos").alias("fn" + suffix),
        total(~called, "neg").alias("tn" + suffix),
    ]


def metrics_at(scored: DataFrame, threshold: float) -> DataFrame:
    """``f1, precision, recall, accuracy`` at a threshold."""
    positive = C("label") == 1
    sides = scored.select(
        "score", positive.cast("long").alias("pos"), (~positive).cast("long").alias("neg")
    )
    return sides.agg(*_cells(C("score") >= threshold)).select(*_ratios())


DEFAULT = "_default_thresh"


def compare_models(scored: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per ``model_name``: AUC, tuned threshold, metrics there and at 0.5.

    Input: ``model_name, label, score``. The scored rows are read once, into counts
    per distinct score; everything else works on those.
    """
    key = ["model_name"]
    counts = score_counts(scored, key)
    limits = left_lookup(auc_of_counts(counts, key, task_rows), _threshold(counts, key, task_rows), key)
    tuned, default = C("score") >= C("threshold"), C("score") >= 0.5
    cells = (
        left_lookup(counts, limits, key)
        .groupBy("model_name", "roc_auc", "threshold")
        .agg(*_cells(tuned), *_cells(default, DEFAULT))
    )
    return cells.select(
        "model_name",
        "roc_auc",
        *_ratios(),
        C("roc_auc").alias("roc_auc" + DEFAULT),
        *_ratios(DEFAULT),
        C("threshold").alias("optimal_threshold"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )


def binary_metrics(scored: DataFrame, threshold: float, task_rows: int = TASK_ROWS) -> DataFrame:
    """AUC and the metrics at a threshold, from one pass over the scored rows."""
    counts = score_counts(scored)
    auc = auc_of_counts(counts, [], task_rows).scalar()
    row = counts.agg(*_cells(C("score") >= threshold)).select(*_ratios())
    return row.withColumn("roc_auc", auc)


def calibration_curve(scored: DataFrame, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Share of positives and mean score per equal-width bin; empty bins are absent."""
    number = F.greatest(F.lit(0), F.least(F.ceil(C("score") * bins) - 1, F.lit(bins - 1)))
    return (
        scored.groupBy(*(keys or []), number.cast("int").alias("bin"))
        .agg(
            F.avg(C("label").cast("double")).alias("fraction_positives"),
            F.avg("score").alias("mean_predicted"),
            F.count(F.lit(1)).alias("bookings"),
        )
    )


def auc_drop_alert(auc: float, baseline: float, limit: float = 0.02) -> bool:
    return baseline - auc > limit


def rate_divergence(scored: DataFrame, limit: float = 0.05) -> DataFrame:
    """Actual against predicted no-show rate and whether they differ by more than ``limit``."""
    rates = scored.agg(
        F.avg(C("label").cast("double")).alias("actual_rate"), F.avg("score").alias("predicted_rate")
    )
    gap = F.abs(C("actual_rate") - C("predicted_rate"))
    return rates.withColumn("divergence", gap).withColumn("alert", gap > limit)

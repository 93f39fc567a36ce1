"""Advantage comparison and detector metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def advantage(auc: Column, baseline: Column) -> Column:
    return F.round(auc - baseline, 6)


def retained_share(observed_advantage: Column, pit_advantage: Column) -> Column:
    """Share of the observed advantage that survives the cutoff, unrounded."""
    return F.when(observed_advantage > 0, pit_advantage / observed_advantage).otherwise(F.lit(1.0))


def comparison(
    baseline: Column, observed: Column, point_in_time: Column, min_advantage: float, max_retained: float
) -> dict[str, Column]:
    """The seven comparison metrics; collapse is decided on the unrounded share."""
    seen = advantage(observed, baseline)
    rebuilt = advantage(point_in_time, baseline)
    share = retained_share(seen, rebuilt)
    return {
        "baseline_auc": baseline,
        "observed_auc": observed,
        "point_in_time_auc": point_in_time,
        "observed_advantage": seen,
        "point_in_time_advantage": rebuilt,
        "advantage_retained": F.round(share, 6),
        "collapsed": (seen >= F.lit(min_advantage)) & (share <= F.lit(max_retained)),
    }


def advantage_lost(observed_advantage: Column, advantage_retained: Column) -> Column:
    return F.round(observed_advantage * (F.lit(1.0) - advantage_retained), 6)


def lost_percent(advantage_retained: Column) -> Column:
    """Lost share in whole percent, halves to even."""
    return F.bround((F.lit(1.0) - advantage_retained) * 100).cast("bigint")


def ablation_contrast(safe_delta: Column, leaked_delta: Column) -> Column:
    return F.round(safe_delta - leaked_delta, 6)


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def detector_rates(tp: Column, fn: Column, fp: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and accuracy; empty denominators read 1, 1, 0 and 0."""
    precision = ratio(tp, tp + fp, 1.0)
    recall = ratio(tp, tp + fn, 1.0)
    f1 = ratio(2 * precision * recall, precision + recall, 0.0)
    accuracy = ratio(tp + tn, tp + fn + fp + tn, 0.0)
    return {
        "precision": F.round(precision, 4),
        "recall": F.round(recall, 4),
        "f1": F.round(f1, 4),
        "accuracy": F.round(accuracy, 4),
    }

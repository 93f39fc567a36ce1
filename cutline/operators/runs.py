"""Run history reduced to what a reviewer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.operators.ordered import newest, upper_median

_NO_DECISION = "\u0000"


def with_group(runs: DataFrame) -> DataFrame:
    """The scenario a run belongs to: its scenario, else its audit, else ``unknown``."""
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("scenario", "audit")]
    return runs.withColumn("scenario", F.coalesce(*named, F.lit("unknown")))


def run_groups(runs: DataFrame, small: bool | None = None) -> DataFrame:
    """One row per scenario: counts, agreement, newest run and upper-median runtime."""
    grouped = with_group(runs)
    decision = F.coalesce("release_decision", F.lit(_NO_DECISION))
    summary = grouped.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("release_decision") == "block").alias("blocked"),
        F.count_if(F.col("release_decision") == "allow").alias("allowed"),
        # One distinct decision, NULL counting as a value.
        (F.min(decision) == F.max(decision)).alias("consistent"),
        F.max("run_id").alias("latest_run_id"),
        F.max_by("started_at", "run_id").alias("latest_started_at"),
    )
    medians = upper_median(grouped, ["scenario"], "runtime_seconds", "median_runtime", small)
    return summary.join(medians, "scenario", "left")


def order_groups(groups: DataFrame) -> DataFrame:
    """Scenarios by newest start; one that never started comes last."""
    return groups.orderBy(F.coalesce("latest_started_at", F.lit("")).desc(), "scenario")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run id of every named scenario."""
    named = runs.where((F.col("scenario") != "") & (F.col("run_id") != ""))
    return named.groupBy("scenario").agg(F.max("run_id").alias("run_id"))


def recent_runs(runs: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` newest runs of every scenario."""
    return newest(with_group(runs), ["scenario"], [F.desc("run_id")], n)

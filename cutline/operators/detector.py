"""How well the audit detects planted leaks, from a table of judged cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.metrics import detector_rates

_DRAWS = 1_000_000


def contaminated(
    clean: Column, leaked: Column, coverage: float, key: Column, seed: int, draw: Column | None = None
) -> Column:
    """``leaked`` on a fixed share of rows. The draw depends on key and seed only, so the same
    rows are hit however the data is partitioned. ``draw`` replaces it, as a value in 0..1."""
    share = min(max(coverage, 0.0), 1.0)
    hashed = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_DRAWS)) / F.lit(_DRAWS)
    return F.when((hashed if draw is None else draw) < share, leaked).otherwise(clean)


def confusion_counts(cases: DataFrame) -> DataFrame:
    """TP, FN, FP, TN over ``is_leaked, flagged``."""
    leaked, flagged = F.col("is_leaked"), F.col("flagged")
    return cases.agg(
        F.count_if(leaked & flagged).alias("true_positive"),
        F.count_if(leaked & ~flagged).alias("false_negative"),
        F.count_if(~leaked & flagged).alias("false_positive"),
        F.count_if(~leaked & ~flagged).alias("true_negative"),
    )


def detector_metrics(cases: DataFrame) -> DataFrame:
    counts = confusion_counts(cases)
    rates = detector_rates(
        *[
            F.col(name).cast("double")
            for name in ("true_positive", "false_negative", "false_positive", "true_negative")
        ]
    )
    return counts.select("*", *[rate.alias(name) for name, rate in rates.items()])


def route_breakdown(cases: DataFrame) -> DataFrame:
    """Per coverage, over leaked cases: what was caught, and by statistics alone."""
    n = F.count(F.lit(1))
    caught = F.count_if("flagged")
    fired = F.count_if("collapsed")
    return (
        cases.where("is_leaked")
        .groupBy("coverage")
        .agg(
            n.alias("cases"),
            caught.alias("caught"),
            F.round(caught / n, 4).alias("recall"),
            fired.alias("statistical_route_fired"),
            F.round(fired / n, 4).alias("statistical_recall"),
            F.round(F.avg(F.col("observed_auc") - F.col("point_in_time_auc")), 4).alias(
                "mean_auc_delta"
            ),
        )
    )


def reach_bands(breakdown: DataFrame) -> DataFrame:
    """Each band as a whole: found by statistics, found by proof only, missed."""
    cases, fired = F.col("cases"), F.col("statistical_route_fired")
    proof_only = F.greatest(F.lit(0), F.col("caught") - fired)
    missed = F.greatest(F.lit(0), cases - F.col("caught"))
    return breakdown.where(cases > 0).select(
        F.bround(F.col("coverage") * 100).cast("bigint").alias("reach_pct"),
        "cases",
        fired.alias("statistical"),
        proof_only.alias("deterministic_only"),
        missed.alias("missed"),
        F.bround(fired / cases * 100).cast("bigint").alias("statistical_pct"),
        F.bround(proof_only / cases * 100).cast("bigint").alias("deterministic_only_pct"),
        F.round("mean_auc_delta", 4).alias("auc_delta"),
        (fired > 0).alias("statistical_fired"),
    )


def blind_from(bands: DataFrame) -> DataFrame:
    """The largest reach at which the statistical route did not fire."""
    silent = F.when(~F.col("statistical_fired"), F.col("reach_pct"))
    return bands.agg(F.max(silent).alias("blind_from_pct"))

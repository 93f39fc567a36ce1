"""As-of reconstruction of features, and feature builds with and without a cutoff."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.timing import after_cutoff, day_boundaries, known_by
from cutline.operators.ordered import running_totals
from cutline.operators.spread import (
    SLICE,
    SpreadPolicy,
    copy_rows,
    cut_rows,
    hot_keys,
    is_stand_in,
    scatter_nulls,
)

KEY = "entity_id"


def _available() -> Column:
    return F.col("available_at")


def _cutoff() -> Column:
    return F.col("prediction_time")


def latest(value: Column | str, at: Column, where: Column | None = None, ties: str = "contract") -> Column:
    """The latest non-NULL value.

    ``max_by`` would return a NULL that happens to be latest, hence the filter. Equal times
    need no order once conflicts are refused; ``ties="largest"`` makes them deterministic.
    """
    value = F.col(value) if isinstance(value, str) else value
    kept = value.isNotNull() if where is None else value.isNotNull() & where
    when = F.when(kept, at)
    if ties == "largest":
        return F.max(F.when(kept, F.struct(at.alias("at"), value.alias("v"))))["v"]
    return F.max_by(F.when(kept, value), when)


def reconstruct(
    decisions: DataFrame,
    records: DataFrame,
    by: Sequence[str] = (),
    ties: str = "contract",
    keep_unmatched: bool = False,
    spread: SpreadPolicy = SpreadPolicy(),
) -> DataFrame:
    """Rebuild a feature per decision: latest value, latest value by the cutoff, late records.

    One row per decision (and ``by`` value) that has records; ``keep_unmatched`` keeps the
    others too, with NULL values. Records are joined to the two decision columns they need
    and reduced before they are shuffled for grouping. Hot entities are cut into slices.
    """
    cutoffs = decisions.select(KEY, "prediction_time")
    rows = records.select(KEY, *by, "available_at", "feature_value")
    on = [KEY]
    if spread.applies_to(rows):
        hot = hot_keys(rows, [KEY], spread)
        if hot is not None:
            rows = cut_rows(rows, hot, [KEY], rows.columns)
            cutoffs = copy_rows(cutoffs, hot, [KEY])
            on = [KEY, SLICE]
    joined = cutoffs.join(rows, on, "left" if keep_unmatched else "inner")
    return joined.groupBy(KEY, *by).agg(
        latest("feature_value", _available(), ties=ties).alias("observed_value"),
        latest("feature_value", _available(), known_by(_available(), _cutoff()), ties).alias(
            "point_in_time_value"
        ),
        F.count_if(after_cutoff(_available(), _cutoff())).alias("excluded_records"),
    )


def reconstruct_wide(
    decisions: DataFrame,
    snapshots: DataFrame,
    features: Sequence[str],
    spread: SpreadPolicy = SpreadPolicy(),
) -> DataFrame:
    """Rebuild many features at once and collect what the contract needs, in one shuffle.

    ``snapshots`` holds ``entity_id, available_at`` and one double column per feature. The
    result has one row per entity of either side (records without an entity appear under
    stand-in keys): ``is_decision``, ``history_records``,
    ``excluded_records``, ``latest_at``, ``latest_known_at``, ``broken_keys`` and, for feature
    number i, ``observed_i``, ``pit_i``, ``nulls_i``, ``conflicts_i`` and ``late_i``.
    """
    numbered = list(enumerate(features))
    values = [F.col(f"`{name}`").alias(f"f_{i}") for i, name in numbered]
    rows = snapshots.select(
        scatter_nulls(KEY, *snapshots.columns).alias(KEY), "available_at", *values
    )
    cutoffs = decisions.select(KEY, "prediction_time", F.lit(True).alias("is_decision"))
    on = [KEY]
    hot = hot_keys(rows, [KEY], spread) if spread.applies_to(rows) else None
    if hot is not None:
        # The slice depends on the time only, so the rows of one (entity, time) stay together.
        rows = cut_rows(rows, hot, [KEY], ["available_at"])
        cutoffs = copy_rows(cutoffs, hot, [KEY])
        on = [KEY, SLICE]
    moments = (
        # One exchange serves the grouping below and the join after it.
        rows.repartition(*on)
        .groupBy(*on, "available_at")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[
                column
                for i, _ in numbered
                for column in (
                    F.min(f"f_{i}").alias(f"lo_{i}"),
                    F.max(f"f_{i}").alias(f"hi_{i}"),
                    F.count(f"f_{i}").alias(f"n_{i}"),
                )
            ],
        )
    )
    joined = cutoffs.join(moments, on, "full_outer")
    known = known_by(_available(), _cutoff())
    present = F.col("n").isNotNull()
    per_feature = [
        column
        for i, _ in numbered
        for column in (
            latest(f"hi_{i}", _available()).alias(f"observed_{i}"),
            latest(f"hi_{i}", _available(), known).alias(f"pit_{i}"),
            F.sum(F.when(present, F.col("n") - F.col(f"n_{i}"))).alias(f"nulls_{i}"),
            F.count_if(F.col(f"lo_{i}") != F.col(f"hi_{i}")).alias(f"conflicts_{i}"),
        )
    ]
    return joined.groupBy(KEY).agg(
        F.coalesce(F.bool_or("is_decision"), F.lit(False)).alias("is_decision"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("history_records"),
        F.coalesce(F.sum(F.when(after_cutoff(_available(), _cutoff()), F.col("n"))), F.lit(0)).alias(
            "excluded_records"
        ),
        F.max("available_at").alias("latest_at"),
        F.max(F.when(known, _available())).alias("latest_known_at"),
        F.count_if(present & (is_stand_in(KEY) | _available().isNull())).alias("broken_keys"),
        *per_feature,
    )


def stacked_history(*generations: DataFrame) -> DataFrame:
    """Several generations of records as one history."""
    return reduce(DataFrame.unionByName, generations)


def leaky_build(
    decisions: DataFrame, events: DataFrame, key: str, decision_key: str, counted: str
) -> DataFrame:
    """Feature build without a cutoff: count and latest ``counted`` over all events of a key.

    Events are reduced to one row per key before the join, so no pairs are ever produced.
    """
    reduced = events.groupBy(key).agg(
        F.count(counted).alias("events"), F.max(counted).alias("latest")
    )
    return decisions.join(reduced, key, "left").select(
        decision_key,
        F.coalesce("events", F.lit(0)).alias("event_count"),
        day_boundaries(F.col("latest"), _cutoff()).alias("days_since_last"),
    )


def guarded_build(
    decisions: DataFrame,
    events: DataFrame,
    key: str,
    decision_key: str,
    counted: str,
    available: str = "available_at",
    small: bool | None = None,
) -> DataFrame:
    """The same build with the cutoff in the join: only events available by the decision.

    Decisions and events of a key are put in one time line and aggregated as they run, which
    costs one pass however many decisions and events share a key. Decisions without any
    event keep a row with count 0.
    """
    line = (
        events.select(key, F.col(available).alias("_at"), F.col(counted).alias("_value"))
        .unionByName(
            decisions.select(key, _cutoff().alias("_at"), F.lit(True).alias("_asks")),
            allowMissingColumns=True,
        )
        .dropna(subset=[key, "_at"])
        .groupBy(key, "_at")
        .agg(
            F.count("_value").alias("_events"),
            F.max("_value").alias("_latest"),
            F.bool_or("_asks").alias("_asked"),
        )
    )
    answered = (
        running_totals(
            line, [key], ["_at"], {"_count": "_events"}, {"_last": "_latest"}, small=small
        )
        .where("_asked")
        .select(key, F.col("_at").alias("prediction_time"), "_count", "_last")
    )
    return decisions.join(answered, [key, "prediction_time"], "left").select(
        decision_key,
        F.coalesce("_count", F.lit(0)).alias("event_count"),
        day_boundaries(F.col("_last"), _cutoff()).alias("days_since_last"),
    )

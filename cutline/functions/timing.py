"""Clock predicates and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400_000_000


def known_by(available_at: Column, prediction_time: Column) -> Column:
    """The cutoff: a record counts if it was available at or before the decision."""
    return available_at <= prediction_time


def after_cutoff(available_at: Column, prediction_time: Column) -> Column:
    return available_at > prediction_time


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def plus_days(moment: Column, days: Column | float) -> Column:
    """``moment`` moved by a possibly fractional number of days."""
    shift = F.lit(days) if not isinstance(days, Column) else days
    moved = micros(moment) + F.round(shift.cast("double") * _MICROS_PER_DAY).cast("bigint")
    return F.timestamp_micros(moved).cast("timestamp_ntz")


def day_boundaries(earlier: Column, later: Column) -> Column:
    """Calendar-day boundaries crossed between two moments, not whole 24 h periods."""
    return F.datediff(later, earlier).cast("bigint")


def gap_days(available_at: Column, prediction_time: Column) -> Column:
    """Whole days from cutoff to availability, floored: one hour early is -1."""
    span = micros(available_at) - micros(prediction_time)
    return F.floor(span / F.lit(float(_MICROS_PER_DAY))).cast("bigint")


def is_late(available_at: Column, prediction_time: Column) -> Column:
    return gap_days(available_at, prediction_time) > 0


def gap_label(available_at: Column, prediction_time: Column) -> Column:
    gap = gap_days(available_at, prediction_time)
    unit = F.when(F.abs(gap) == 1, F.lit(" day ")).otherwise(F.lit(" days "))
    side = F.when(gap > 0, F.lit("too late")).otherwise(F.lit("earlier"))
    return F.when(gap.isNull(), F.lit("")).otherwise(
        F.concat(F.abs(gap).cast("string"), unit, side)
    )

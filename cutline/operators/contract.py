"""Binding user columns to the canonical contract, and refusing input that breaks it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.functions import casting
from cutline.functions.timing import known_by


class ContractError(ValueError):
    """The input breaks the point-in-time contract."""


# Fixed keys of the column mapping.
_SHARED_KEYS = ("entity_id", "prediction_time", "label", "split", "base_features", "safe_feature")
_LONG_KEYS = ("record_entity_id", "available_time", "feature_value")
_WIDE_KEYS = ("snapshot_entity_id", "snapshot_time", "feature")


@dataclass(frozen=True)
class Binding:
    """Which user columns play which part."""

    entity_id: str
    prediction_time: str
    label: str
    split: str
    base_features: tuple[str, ...]
    safe_feature: str
    history_entity_id: str
    history_time: str
    history_value: str
    wide: bool = False
    sweep_features: tuple[str, ...] = field(default=())

    @classmethod
    def from_mapping(cls, columns: Any, wide: bool, sweep: Sequence[str] = ()) -> Binding:
        if not isinstance(columns, dict):
            raise ContractError("columns must be a JSON object")
        history = _WIDE_KEYS if wide else _LONG_KEYS
        missing = [key for key in _SHARED_KEYS + history if not columns.get(key)]
        if missing:
            raise ContractError("columns is missing: " + ", ".join(missing))
        base = columns["base_features"]
        named = isinstance(base, list) and all(isinstance(b, str) and b.strip() for b in base)
        if not named:
            raise ContractError("columns.base_features must be a list of column names")
        single = [k for k in _SHARED_KEYS + history if k != "base_features"]
        if not all(isinstance(columns[k], str) and columns[k].strip() for k in single):
            raise ContractError("column mappings must be non-empty strings")
        shared = {k: columns[k] for k in _SHARED_KEYS if k != "base_features"}
        return cls(
            **shared,
            base_features=tuple(base),
            history_entity_id=columns[history[0]],
            history_time=columns[history[1]],
            history_value=columns[history[2]],
            wide=wide,
            sweep_features=tuple(sweep),
        )


def base_names(count: int) -> list[str]:
    return [f"base_{i}" for i in range(count)]


def canonical_decisions(raw: DataFrame, binding: Binding) -> DataFrame:
    return raw.select(
        casting.key_text(casting.column(binding.entity_id)).alias("entity_id"),
        casting.instant(casting.column(binding.prediction_time)).alias("prediction_time"),
        casting.class_label(casting.column(binding.label)).alias("label"),
        casting.split_name(casting.column(binding.split)).alias("split_name"),
        *[_number(raw, name).alias(f"base_{i}") for i, name in enumerate(binding.base_features)],
        _number(raw, binding.safe_feature).alias("safe_feature"),
    )


def _number(raw: DataFrame, name: str) -> Column:
    value = casting.column(name)
    is_text = isinstance(raw.select(value).schema[0].dataType, T.StringType)
    return casting.number(value) if is_text else value.try_cast("double")


def canonical_records(raw: DataFrame, entity_id: str, available: str, value: str) -> DataFrame:
    return raw.select(
        casting.key_text(casting.column(entity_id)).alias("entity_id"),
        casting.instant(casting.column(available)).alias("available_at"),
        _number(raw, value).alias("feature_value"),
    )


def canonical_snapshots(
    raw: DataFrame, entity_id: str, available: str, features: Sequence[str]
) -> DataFrame:
    return raw.select(
        casting.key_text(casting.column(entity_id)).alias("entity_id"),
        casting.instant(casting.column(available)).alias("available_at"),
        *[_number(raw, name).alias(name) for name in features],
    )


def wide_to_long(snapshots: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every candidate column as long records, in one scan."""
    return snapshots.unpivot(
        ["entity_id", "available_at"],
        [casting.column(name) for name in features],
        "feature",
        "feature_value",
    )


def required_nulls(columns: Sequence[str]) -> Column:
    """True for a row that lacks, or could not parse, any of the columns."""
    return reduce(or_, [F.col(name).isNull() for name in columns])


def decision_columns(base_width: int) -> list[str]:
    return ["entity_id", "prediction_time", "label", "safe_feature", *base_names(base_width)]


RECORD_COLUMNS = ["entity_id", "available_at", "feature_value"]


def rejected_rows(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that break the contract, with the columns at fault."""
    faults = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return frame.withColumn("faults", faults).where(F.size("faults") > 0)


def decision_profile(decisions: DataFrame, base_width: int) -> DataFrame:
    """One row: rows, distinct keys, invalid rows, distinct labels, train rows, test rows."""
    split = F.col("split_name")
    return decisions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("entity_id").alias("unique_ids"),
        F.count_if(required_nulls(decision_columns(base_width))).alias("invalid_rows"),
        F.count_distinct("label").alias("labels"),
        F.count_if(split == "train").alias("train_rows"),
        F.count_if(split == "test").alias("test_rows"),
    )


def decision_violations(train_rows: Column, test_rows: Column) -> Column:
    """Contract messages over a profile row; an empty array means the decisions hold."""
    declared = train_rows + test_rows
    rules = [
        (F.col("rows") != declared, "decisions do not have the declared number of rows"),
        (F.col("unique_ids") != F.col("rows"), "decision keys must be unique"),
        (F.col("invalid_rows") > 0, "decisions contain null or unparseable required values"),
        (F.col("labels") != 2, "the label must contain exactly two classes"),
        (
            (F.col("train_rows") != train_rows) | (F.col("test_rows") != test_rows),
            "split counts do not match the declared train and test rows",
        ),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))


BROKEN_RECORDS = "records contain null or unparseable required values"
CONFLICTING_RECORDS = "records have conflicting values at the same entity and timestamp"
UNCOVERED = "every decision must have at least one record"
UNKNOWN_AT_CUTOFF = "every decision needs a record available by its prediction time"


def conflicting_records(records: DataFrame, value: str = "feature_value") -> DataFrame:
    """(entity, time) groups with two different values; reduced before the shuffle."""
    return (
        records.groupBy("entity_id", "available_at")
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .where(F.col("low") != F.col("high"))
    )


def decisions_without_records(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Decisions with no record at all."""
    return decisions.join(records.select("entity_id").distinct(), "entity_id", "left_anti")


def decisions_without_known_record(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Decisions with no record by their cutoff: the earliest record is late, or none exists."""
    first = (
        records.where(F.col("feature_value").isNotNull())
        .groupBy("entity_id")
        .agg(F.min("available_at").alias("first_at"))
    )
    known = known_by(F.col("first_at"), F.col("prediction_time"))
    return (
        decisions.join(first, "entity_id", "left")
        .where(~F.coalesce(known, F.lit(False)))
        .drop("first_at")
    )

"""Fail-soft casts into the canonical contract: what cannot be read becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def column(name: str) -> Column:
    """A column by its exact name, spaces and dots included."""
    if not isinstance(name, str) or not name.strip():
        raise ValueError("column mappings must be non-empty strings")
    return F.col("`" + name.replace("`", "``") + "`")


def key_text(value: Column) -> Column:
    return value.cast("string")


def instant(value: Column) -> Column:
    """A zone-free timestamp; text with an offset is normalised to the (UTC) session zone."""
    return value.try_cast("timestamp").try_cast("timestamp_ntz")


def number(value: Column) -> Column:
    """A double. The JVM reads a trailing type letter as part of a number; data does not."""
    last = F.lower(F.right(F.rtrim(value.cast("string")), F.lit(1)))
    return F.when(~last.isin("d", "f"), value.try_cast("double"))


def class_label(value: Column) -> Column:
    """An integer class; ``1.0`` reads as 1, a fractional label reads as NULL."""
    read = number(value)
    return F.when(read == F.floor(read), read.try_cast("int"))


def split_name(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))

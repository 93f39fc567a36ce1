"""Splitting hot keys over several tasks without losing a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.session import is_small, settle

SLICE = "_slice"
STAND_IN = "\u0000null-"
_SCATTER = 1024


@dataclass(frozen=True)
class SpreadPolicy:
    """When a key counts as hot and how finely it is cut.

    Hot keys are looked for in a sample of the key column. The sample only decides
    which keys are cut; every row takes part in the result whatever it says.
    """

    sample_fraction: float = 0.01
    hot_rows: int = 4_000_000
    rows_per_slice: int = 1_000_000
    # Bounds of the broadcast list of hot keys.
    most_keys: int = 100_000
    most_bytes: int = 32 * 1024 * 1024
    seed: int = 17
    # None looks at the plan's size; True or False decides it outright.
    enabled: bool | None = None

    def applies_to(self, frame: DataFrame) -> bool:
        return not is_small(frame) if self.enabled is None else self.enabled


def scatter_nulls(key: str, *values: str) -> Column:
    """The key, with NULLs replaced by many distinct stand-ins: they match nothing anyway."""
    stand_in = F.concat(F.lit(STAND_IN), F.pmod(F.xxhash64(*values), F.lit(_SCATTER)).cast("string"))
    return F.coalesce(F.col(key), stand_in)


def is_stand_in(key: str) -> Column:
    return F.coalesce(F.col(key).startswith(STAND_IN), F.lit(False))


def hot_keys(frame: DataFrame, keys: list[str], policy: SpreadPolicy) -> DataFrame | None:
    """The settled table ``keys..., _slices`` of hot keys, or None when there are none."""
    rows = F.count(F.lit(1)) / F.lit(policy.sample_fraction)
    sampled = frame.select(*keys).dropna()
    if policy.sample_fraction < 1:
        sampled = sampled.sample(fraction=policy.sample_fraction, seed=policy.seed)
    found = (
        sampled.groupBy(*keys)
        .agg(rows.alias("_rows"))
        .where(F.col("_rows") >= policy.hot_rows)
        .orderBy(F.desc("_rows"))
        .limit(policy.most_keys)
        .select(*keys, F.ceil(F.col("_rows") / policy.rows_per_slice).cast("int").alias("_slices"))
    )
    # Settled once, so both join sides cut the same keys in the same way.
    settled = settle(found)
    size = settled.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum(reduce(add, [F.octet_length(F.col(k).cast("string")) for k in keys])).alias("bytes"),
    ).first()
    if size["keys"] == 0:
        return None
    if size["bytes"] > policy.most_bytes:
        # Very long keys: the hottest that fit are cut, the rest is left to adaptive execution.
        fitting = max(1, int(size["keys"] * policy.most_bytes / size["bytes"] / 2))
        settled = settle(settled.orderBy(F.desc("_slices")).limit(fitting))
    return settled


def cut_rows(frame: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Add a slice number to the many-rows side; equal ``by`` values share a slice."""
    number = F.pmod(F.xxhash64(*by), F.coalesce(F.col("_slices"), F.lit(1)))
    marked = frame.join(F.broadcast(hot), keys, "left")
    return marked.withColumn(SLICE, number.cast("int")).drop("_slices")


def copy_rows(frame: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Give the one-row-per-key side one copy per slice of its key."""
    marked = frame.join(F.broadcast(hot), keys, "left")
    numbers = F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)
    return marked.withColumn(SLICE, F.explode(numbers)).drop("_slices")

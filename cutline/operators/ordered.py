"""Running aggregates, exact medians and newest-N per group, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.session import is_small, settle

_PART = "_part"


def running_totals(
    frame: DataFrame,
    by: list[str],
    order: list[str],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Add running sums, running maxima and whole-group sums, in ``order`` within ``by``.

    Each mapping goes from output name to input column. Rows equal in ``order`` see each
    other. A frame that fits one task uses one window per group. Otherwise the rows are
    range-partitioned by group and order, so that a huge group spans many tasks, each chunk
    runs its own window, and chunks of a divided group receive what came before them.
    """
    sums, maxima, totals = sums or {}, maxima or {}, totals or {}
    if small if small is not None else is_small(frame):
        running = Window.partitionBy(*by).orderBy(*order)
        whole = Window.partitionBy(*by)
        return frame.select("*", *_windowed(sums, maxima, totals, running, whole))

    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The part number must not change between its two uses below: settle it.
    ranged = settle(
        frame.repartitionByRange(parts, *by, *order).withColumn(_PART, F.spark_partition_id())
    )
    running = Window.partitionBy(_PART, *by).orderBy(*order)
    whole = Window.partitionBy(_PART, *by)
    local = ranged.select("*", *_windowed(sums, maxima, totals, running, whole))

    # One row per chunk: at most (groups + parts) rows, and at most `parts` per group.
    inputs = sorted({*sums.values(), *totals.values()})
    chunks = ranged.groupBy(*by, _PART).agg(
        F.count(F.lit(1)).alias("_chunk_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in inputs],
        *[F.max(c).alias(f"_max_{c}") for c in sorted(set(maxima.values()))],
    )
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    carried = (
        chunks.withColumn("_chunks", F.count(F.lit(1)).over(group))
        # Only a group cut by a part boundary has several chunks: at most 2 * parts rows.
        .where(F.col("_chunks") > 1)
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in by],
            F.col(_PART).alias("_k_part"),
            *[F.sum(f"_sum_{c}").over(before).alias(f"_carry_{name}") for name, c in sums.items()],
            *[F.max(f"_max_{c}").over(before).alias(f"_carry_{name}") for name, c in maxima.items()],
            *[F.sum(f"_sum_{c}").over(group).alias(f"_carry_{name}") for name, c in totals.items()],
        )
    )
    same = F.col(_PART) == F.col("_k_part")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carried), same, "left")
    return joined.select(
        *[F.col(c) for c in frame.columns],
        *[_plus(F.col(n), F.col(f"_carry_{n}")).alias(n) for n in sums],
        *[F.greatest(F.col(n), F.col(f"_carry_{n}")).alias(n) for n in maxima],
        *[F.coalesce(F.col(f"_carry_{n}"), F.col(n)).alias(n) for n in totals],
    )


def _windowed(sums, maxima, totals, running, whole) -> list[Column]:
    return [
        *[F.sum(c).over(running).alias(n) for n, c in sums.items()],
        *[F.max(c).over(running).alias(n) for n, c in maxima.items()],
        *[F.sum(c).over(whole).alias(n) for n, c in totals.items()],
    ]


def _plus(left: Column, right: Column) -> Column:
    return F.when(left.isNull(), right).otherwise(left + F.coalesce(right, F.lit(0)))


def upper_median(
    frame: DataFrame, by: list[str], value: str, alias: str = "median", small: bool | None = None
) -> DataFrame:
    """The value at position n // 2 of each group, ignoring NULL and 0."""
    counted = (
        frame.where(F.col(value).isNotNull() & (F.col(value) != 0))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(
        counted, by, [value], sums={"_upto": "_n"}, totals={"_all": "_n"}, small=small
    )
    position = F.floor(F.col("_all") / 2) + 1
    chosen = (F.col("_upto") >= position) & (F.col("_upto") - F.col("_n") < position)
    return ranked.where(chosen).select(*by, F.col(value).alias(alias))


def newest(frame: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups to ``n`` before the shuffle."""
    ranked = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n)

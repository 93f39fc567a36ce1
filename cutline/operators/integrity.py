"""Recorded evidence against what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integrity_errors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries that escape the root, are missing, or have other content."""
    outside = F.col("path").rlike(r"(^|[/\\])\.\.([/\\]|$)") | F.col("path").rlike(
        r"^(/|[A-Za-z]:|[a-z0-9+.-]+://)"
    )
    joined = manifest.join(files.select("path", "actual"), "path", "left")
    error = (
        F.when(outside, F.concat(F.lit("path escapes the root: "), F.col("path")))
        .when(F.col("actual").isNull(), F.concat(F.lit("missing file: "), F.col("path")))
        .when(
            F.col("actual") != F.col("sha256"), F.concat(F.lit("sha256 mismatch: "), F.col("path"))
        )
    )
    return joined.select("path", error.alias("error")).where(F.col("error").isNotNull())


def sidecar_differences(manifest: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Paths on which the manifest and its sidecar list disagree."""
    listed = sidecar.select("path", F.col("sha256").alias("listed"))
    return (
        manifest.join(listed, "path", "full_outer")
        .where(~F.col("sha256").eqNullSafe(F.col("listed")))
        .select("path", "sha256", "listed")
    )


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every key of either side with one ``<value>_matches`` flag per compared column."""
    left = expected.select(
        *keys, *[F.col(v).alias(f"_e_{v}") for v in values], F.lit(True).alias("_expected")
    )
    right = actual.select(
        *keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_actual")
    )
    both = F.col("_expected").isNotNull() & F.col("_actual").isNotNull()
    return left.join(right, keys, "full_outer").select(
        *keys,
        *[
            (both & F.col(f"_e_{v}").eqNullSafe(F.col(f"_a_{v}"))).alias(f"{v}_matches")
            for v in values
        ],
        F.col("_expected").isNotNull().alias("is_expected"),
        F.col("_actual").isNotNull().alias("is_actual"),
    )


def all_checks(flags: DataFrame, names: list[str]) -> DataFrame:
    """One row: every check over all rows, and passed or failed."""
    held = flags.agg(*[F.coalesce(F.bool_and(n), F.lit(False)).alias(n) for n in names])
    every = F.lit(True)
    for name in names:
        every = every & F.col(name)
    return held.withColumn("status", F.when(every, F.lit("passed")).otherwise(F.lit("failed")))


def missing_fields(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Per asset, the expected fields and tags a live snapshot lacks."""
    joined = expected.join(
        live.select("urn", F.col("fields").alias("_fields"), F.col("tags").alias("_tags")),
        "urn",
        "left",
    )
    empty = F.array().cast("array<string>")
    return joined.select(
        "urn",
        F.array_except("fields", F.coalesce("_fields", empty)).alias("missing_fields"),
        F.array_except("tags", F.coalesce("_tags", empty)).alias("missing_tags"),
    )

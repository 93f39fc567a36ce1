"""User tables as CSV, Parquet or catalog tables, and a fingerprint of what was read."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.operators.contract import ContractError

FORMATS = ("csv", "parquet", "table")
BY_CONTENT, BY_LISTING, NOT_HASHED = "content", "listing", "beyond one value"
# One value of a row holds at most this many bytes, so longer files cannot be hashed by content.
LONGEST_VALUE = (1 << 31) - 16


@dataclass(frozen=True)
class Relation:
    """Where a table lives and how it is stored."""

    path: str
    format: str

    @classmethod
    def from_config(cls, value: Any, key: str, folder: str) -> Relation:
        """Relative paths belong to the folder of the configuration file."""
        if not isinstance(value, dict) or not isinstance(value.get("path"), str):
            raise ContractError(f"{key}.path is required")
        path = value["path"]
        form = value.get("format", os.path.splitext(path)[1].lstrip(".").lower())
        if form not in FORMATS:
            raise ContractError(f"{key}.format must be csv, parquet or table")
        if form != "table" and "://" not in path and not os.path.isabs(path):
            path = os.path.normpath(os.path.join(folder, path))
        return cls(path, form)


def read_relation(spark: SparkSession, relation: Relation) -> DataFrame:
    """CSV is read as text, so that keys keep leading zeros and nothing is inferred."""
    if relation.format == "table":
        return spark.table(relation.path)
    try:
        if relation.format == "parquet":
            return spark.read.parquet(relation.path)
        names = spark.read.option("header", True).csv(relation.path).columns
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise ContractError(f"not found: {relation.path}") from error
        raise
    return read_text_csv(spark, relation.path, names)


def read_text_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.schema(schema).option("header", True).csv(path)


def fingerprint(spark: SparkSession, path: str, form: str, by: str = BY_CONTENT) -> DataFrame:
    """Per-file ``path, format, sha256, bytes, hashed``; ``hashed`` says what ``sha256`` is a hash of.

    ``by`` holds for every file: its content, or its path, length and change time. By content, a file longer
    than a value can be is reported with a NULL hash instead of another kind of hash.
    """
    if by not in (BY_CONTENT, BY_LISTING):
        raise ContractError(f"files are hashed by {BY_CONTENT} or by {BY_LISTING}")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def hashed(files: DataFrame, sha256: Column, kind: str) -> DataFrame:
        return files.select("path", sha256.alias("sha256"), F.col("length").alias("bytes"), F.lit(form).alias("format"), F.lit(kind).alias("hashed"))

    if by == BY_LISTING:
        described = F.concat_ws("|", "path", "length", F.col("modificationTime").cast("string"))
        return hashed(listing, F.sha2(described, 256), BY_LISTING)
    short = F.col("length") <= LONGEST_VALUE
    return hashed(listing.where(short), F.sha2("content", 256), BY_CONTENT).unionByName(
        hashed(listing.where(~short), F.lit(None).cast("string"), NOT_HASHED)
    )


def input_summary(spark: SparkSession, relation: Relation) -> dict[str, Any]:
    """What was read, in one row: files, bytes and a hash over all files in any order."""
    if relation.format == "table":
        return {"path": relation.path, "format": relation.format}
    files = fingerprint(spark, relation.path, relation.format)
    row = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.lower(F.hex(F.bit_xor(F.xxhash64(F.substring_index("path", "/", -1), F.coalesce("sha256", F.lit("")))))).alias("digest"),
        F.max("sha256").alias("sha256"),
    ).first()
    summary = {"path": os.path.basename(relation.path.rstrip("/")), "format": relation.format}
    summary.update(files=row["files"], bytes=row["bytes"], digest=row["digest"])
    if row["files"] == 1:
        summary["sha256"] = row["sha256"]
    return summary

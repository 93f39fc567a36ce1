"""Recorded fixtures: a manifest of hashes, its sidecar list and the files themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256`` as the manifest declares them."""
    schema = "files array<struct<path string, sha256 string>>"
    manifest = spark.read.schema(schema).json(f"{root}/manifest.json", multiLine=True)
    return manifest.select(F.inline("files"))


def read_sidecar(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256`` from ``hashes.txt``."""
    line = r"^\s*(\S+)\s+(.*\S)\s*$"
    return spark.read.text(f"{root}/hashes.txt").select(
        F.regexp_extract("value", line, 2).alias("path"),
        F.regexp_extract("value", line, 1).alias("sha256"),
    ).where(F.col("path") != "")


def read_file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """``path, actual`` of every file below ``root``, hashed on executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        relative_path(F.col("path"), root).alias("path"), F.sha2("content", 256).alias("actual")
    )


def relative_path(path: Column, root: str) -> Column:
    """A listed path below ``root``, whether or not either names its file system."""
    base = root.rstrip("/") + "/"
    bare = F.regexp_replace(path, "^file:/+", "/") if "://" not in base else path
    tail = bare.substr(F.lit(len(base) + 1), F.length(bare))
    return F.when(bare.startswith(base), tail).otherwise(bare)

"""SQL files as a table of query texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.sources.manifests import relative_path

# Folders that never hold first-party transformations.
SKIPPED_FOLDERS = (".git", "node_modules", "target", "dbt_packages", "venv", ".venv")


def read_sql_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``path, sql`` of every ``*.sql`` below ``root``, or of one file.

    Folders are skipped by their place below ``root``, never by where ``root`` itself lies.
    Bytes that are no UTF-8 give a NULL text, which the scan reports as unreadable.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return corpus_from_files(files, root)


def corpus_from_files(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/")
    if base.lower().endswith(".sql"):
        base = os.path.dirname(base)
    skipped = "(^|/)(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"
    return (
        files.select(relative_path(F.col("path"), base).alias("path"), "content")
        .where(F.lower("path").endswith(".sql") & ~F.col("path").rlike(skipped))
        .select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("sql"))
    )

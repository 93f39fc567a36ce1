"""The append-only run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = (
    "run_id string, started_at string, audit string, scenario string, case_id string, "
    "verdict string, release_decision string, exit_code int, runtime_seconds double, "
    "rows bigint, target_urn string, published boolean, evidence_sha256 string"
)


def new_run_id(started_at: Column, entropy: Column) -> Column:
    """UTC stamp and six hex digits: ids sort by time."""
    stamp = F.date_format(started_at, "yyyyMMdd'T'HHmmss")
    return F.concat(stamp, F.lit("-"), F.substring(F.sha2(entropy, 256), 1, 6))


def record_runs(runs: DataFrame, path: str, grain: str = "day") -> None:
    """Append run records, partitioned by the day (or coarser grain) in their id."""
    day = F.to_date(F.substring("run_id", 1, 8), "yyyyMMdd")
    dated = runs.withColumn("run_date", F.to_date(F.date_trunc(grain, day)))
    dated.write.mode("append").partitionBy("run_date").parquet(path)


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """Run files as JSON documents; anything that is not a run object is skipped."""
    schema = RUNS + ", _corrupt string"
    read = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path, multiLine=True)
    )
    return read.where(F.col("_corrupt").isNull() & F.col("run_id").isNotNull()).drop("_corrupt")


def list_runs(runs: DataFrame, limit: int | None = 50) -> DataFrame:
    """Newest first; ``limit`` is the page size, None lists every run for aggregates."""
    return runs if limit is None else runs.orderBy(F.desc("run_id")).limit(limit)

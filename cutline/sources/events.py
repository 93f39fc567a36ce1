"""Streams of metadata change events as ``body, received_at``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_events(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """Change events from Kafka, starting with the newest."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )
    return raw.select(F.col("value").cast("string").alias("body"), F.col("timestamp").alias("received_at"))


def file_events(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Change events from a folder of text files, one JSON event per line."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.select(F.col("value").alias("body"), F.current_timestamp().alias("received_at"))

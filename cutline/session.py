"""Session helpers shared by every operator: lineage cuts, the shared folder and plan sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Inputs below this size fit one task, so a hot group cannot overload it.
SMALL_INPUT_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master; a cluster without the
    setting is refused, because executors cannot see a driver's local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="cutline-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{_checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(frame: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, evaluated exactly once."""
    _checkpoint_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the folder of ``spark.checkpoint.dir`` and read it back."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each write, as what is read on is the written table; a frame that is
    run again makes its own again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan_bytes(frame: DataFrame) -> int:
    """The optimizer's size estimate of a frame; unknown sizes come back huge."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(frame: DataFrame, limit: int = SMALL_INPUT_BYTES) -> bool:
    return plan_bytes(frame) <= limit


def _checkpoint_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()

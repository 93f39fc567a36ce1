"""Release gate over a stream of metadata change events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cutline.functions.digest import event_key
from cutline.functions.names import entity_type
from cutline.functions.verdict import (
    CaseColumns,
    confirmation_route,
    decision_exit_code,
    release_decision,
    resolved_verdict,
    sql_proof,
    verdict,
)
from cutline.operators.evidence import raise_incidents
from cutline.session import settle

PROOF = (
    "event_key string, urn string, entity_type string, audit string, case_id string, "
    "verdict string, release_decision string, confirmation_route string, exit_code int, "
    "batch_id bigint"
)

_NAMES = "entityUrn string, urn string, entityType string"
_ENVELOPE = f"{_NAMES}, meta string, event struct<{_NAMES}>"


@dataclass(frozen=True)
class GateConfig:
    """Where the gate writes and what it reacts to."""

    store: str
    audit: str = "release"
    entity_types: tuple[str, ...] = ("mlModel",)
    target_urn: str | None = None
    raise_incident: bool = True


def parse_events(raw: DataFrame) -> DataFrame:
    """``event_key, urn, entity_type, body`` of both envelope shapes.

    A body is an object, or a JSON string that holds one; the object may sit below ``event``.
    The asset is ``entityUrn``, else ``urn``; the type falls back to the one in the URN.
    """
    text = F.trim(F.col("body"))
    unwrapped = F.when(text.startswith('"'), F.get_json_object(text, "$")).otherwise(text)
    read = raw.withColumn("_read", F.from_json(unwrapped, _ENVELOPE))
    fields = ("_read.entityUrn", "_read.urn", "_read.event.entityUrn", "_read.event.urn")
    kind = F.coalesce(F.col("_read.entityType"), F.col("_read.event.entityType"))
    return (
        read.withColumn("urn", F.coalesce(*[F.col(name) for name in fields]))
        .withColumn("entity_type", F.coalesce(kind, entity_type(F.col("urn"))))
        .withColumn("event_key", event_key(F.col("urn"), F.col("body"), F.col("_read.meta")))
        .drop("_read")
    )


def watched(events: DataFrame, config: GateConfig) -> DataFrame:
    """Events with an asset, of a watched type, for the bound asset if there is one."""
    kind = F.col("entity_type")
    kept = events.where(F.col("urn").isNotNull() & (F.col("urn") != ""))
    kept = kept.where(kind.isNull() | (kind == "") | kind.isin(*config.entity_types))
    return kept if config.target_urn is None else kept.where(F.col("urn") == config.target_urn)


def unseen(events: DataFrame, proof: DataFrame) -> DataFrame:
    """Events whose key has not been audited with success.

    The batch is small next to the proof table, so the table is only filtered by the batch's
    keys and never shuffled whole; Spark broadcasts the keys when they are few.
    """
    seen = proof.select("event_key").join(events.select("event_key"), "event_key", "left_semi")
    return events.join(seen, "event_key", "left_anti")


def audit_events(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Judge events by the case of their model; ``error`` tells why one could not be judged.

    ``cases`` holds one row per ``model_urn``: the case columns plus ``subject`` and the
    ``guard_status`` of its query.
    """
    case = CaseColumns.named()
    joined = events.join(cases, events["urn"] == cases["model_urn"], "left")
    first = joined.withColumn("_point", verdict(case)).withColumn(
        "_proof", sql_proof(F.col("guard_status"), F.col("subject"))
    )
    judged = first.withColumn("verdict", resolved_verdict(F.col("_point"), F.col("_proof")))
    unknown = F.when(F.col("case_id").isNull(), F.lit("no evidence describes this asset"))
    broken = F.when(
        F.col("guard_status").isNull(), F.lit("the transformation of this asset was not checked")
    )
    return judged.select(
        *events.columns,
        "case_id",
        "verdict",
        release_decision(F.col("verdict")).alias("release_decision"),
        confirmation_route(F.col("_point"), F.col("_proof")).alias("confirmation_route"),
        decision_exit_code(release_decision(F.col("verdict"))).alias("exit_code"),
        F.coalesce(unknown, broken).alias("error"),
    )


def read_proof(spark: SparkSession, config: GateConfig) -> DataFrame:
    """The proof table, empty before the first audit."""
    from pyspark.errors import AnalysisException

    path = f"{config.store}/proof"
    try:
        return spark.read.schema(PROOF).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], PROOF)


def run_batch(batch: DataFrame, batch_id: int, cases: DataFrame, config: GateConfig) -> None:
    """Audit one micro-batch; running it again changes nothing.

    An event is remembered only by its proof row, which is written last. A failed event goes
    to the rejects of its batch and is audited again when it is delivered again.
    """
    spark = batch.sparkSession
    # The batch is read once, though it is looked up and joined.
    events = watched(parse_events(batch), config).dropDuplicates(["event_key"]).persist()
    fresh = unseen(events, read_proof(spark, config))
    judged = settle(audit_events(fresh, cases).withColumn("batch_id", F.lit(batch_id)))
    failed = judged.where(F.col("error").isNotNull())
    failed.select("event_key", "urn", "body", "error").write.mode("overwrite").parquet(
        f"{config.store}/rejects/batch_id={batch_id}"
    )
    passed = judged.where(F.col("error").isNull()).withColumn("audit", F.lit(config.audit))
    if config.raise_incident:
        blocked = passed.where(F.col("release_decision") == "block")
        raise_incidents(
            blocked.select(F.col("urn").alias("target_urn"), "case_id"), config.store
        )
    columns = [field.split()[0] for field in PROOF.split(", ")]
    passed.select(*columns).write.mode("append").parquet(f"{config.store}/proof")
    events.unpersist()


def start_gate(
    events: DataFrame, cases: DataFrame, config: GateConfig, checkpoint: str, **trigger
) -> StreamingQuery:
    """Run the gate over a stream of ``body`` texts; ``trigger`` as for ``writeStream``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        run_batch(batch, batch_id, cases, config)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def gate_summary(proof: DataFrame) -> DataFrame:
    return proof.agg(
        F.count(F.lit(1)).alias("audited"),
        F.count_if(F.col("release_decision") == "block").alias("blocked"),
    )

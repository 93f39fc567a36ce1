"""Evidence store, run records, integrity checks and the streaming release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.catalog.inputs import RUNS_SQL, runs
from cutline.catalog.registry import register, table
from cutline.operators.evidence import bound_evidence, latest_versions, publish, publish_plan, raise_incidents
from cutline.operators.integrity import (
    all_checks,
    compared,
    integrity_errors,
    missing_fields,
    sidecar_differences,
)
from cutline.session import fresh_path
from cutline.sources.events import file_events
from cutline.sources.history import new_run_id, record_runs
from cutline.sources.relations import fingerprint
from cutline.streaming.gate import GateConfig, gate_summary, read_proof, start_gate


def bundles(spark, folder) -> DataFrame:
    """One evidence bundle per order; many share a target."""
    key = F.col("o_orderkey")
    target = F.concat(F.lit("urn:li:dataset:d_"), (F.col("o_custkey") % 40).cast("string"))
    return table(spark, folder, "orders").select(
        F.concat(F.lit("case "), key.cast("string")).alias("case_id"),
        F.when(key % 10 != 3, target).otherwise("urn:li:chart:c").alias("target_urn"),
        F.when(key % 10 == 4, F.lit("urn:li:dataset:else")).when(key % 10 != 5, target).alias("bound_urn"),
        F.lit("days_since_last").alias("field"),
        (key % 10 != 6).alias("field_known"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("high_confidence").alias("verdict"),
        F.lit("block").alias("release_decision"),
        F.sha2(key.cast("string"), 256).alias("config_sha256"),
        F.lit(0.9).alias("observed_auc"),
        F.lit(0.7).alias("point_in_time_auc"),
        F.col("o_custkey").alias("excluded_records"),
        F.lit(0.2).alias("safe_delta"),
        F.lit(1.0).alias("safe_retained"),
    )


_REFUSED = """
refused AS (
  SELECT 'case ' || o_orderkey AS case_id,
    CASE WHEN o_orderkey % 10 <> 3 THEN 'urn:li:dataset:d_' || (o_custkey % 40) ELSE 'urn:li:chart:c' END AS target_urn,
    CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'high_confidence' END AS verdict,
    CASE WHEN o_orderstatus <> 'F' THEN 'only a confirmed bundle that blocks can be published'
      WHEN o_orderkey % 10 = 3 THEN 'publication needs a dataset target'
      WHEN o_orderkey % 10 = 5 THEN 'the evidence is not bound to an exact target'
      WHEN o_orderkey % 10 = 4 THEN 'the evidence is bound to another target'
      WHEN o_orderkey % 10 = 6 THEN 'the target lacks schema metadata for the field' END AS refusal
  FROM orders)"""


@register(
    "publish_plan",
    f"""WITH {_REFUSED}
SELECT case_id, target_urn, 'awaiting_human_approval' AS status,
  'field_tag,structured_property,audit_document,active_incident' AS planned_types,
  false AS mutation_performed FROM refused""",
)
def plan(spark, folder):
    return publish_plan(bundles(spark, folder)).withColumn(
        "planned_types", F.array_join("planned_types", ",")
    )


@register(
    "publish_evidence",
    f"""WITH {_REFUSED}
SELECT case_id, target_urn, verdict, CASE WHEN refusal IS NULL THEN 'published' ELSE 'refused' END AS status,
  refusal, CASE WHEN refusal IS NULL THEN 'audit-' || replace(case_id, ' ', '-') END AS document_id,
  CASE WHEN refusal IS NULL THEN true END AS audit_document_reread,
  CASE WHEN refusal IS NULL THEN true END AS active_incident_reread FROM refused""",
)
def published(spark, folder):
    """Published twice into a fresh store: the second run must reuse the first one's rows."""
    store = fresh_path(spark, "evidence")
    publish(bundles(spark, folder), store, approved=True)
    again = publish(bundles(spark, folder), store, approved=True)
    return again.select(
        "case_id", "target_urn", "verdict", "status", "refusal", "document_id",
        "audit_document_reread", "active_incident_reread",
    )


@register(
    "republished_evidence",
    f"""WITH {_REFUSED}
SELECT 'audit-' || replace(case_id, ' ', '-') AS document_id, target_urn, 'published' AS status, true AS audit_document_reread,
  CASE WHEN o_custkey % 2 = 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS observed_auc, 1 + (o_custkey + 1) % 2 AS version
FROM refused JOIN orders ON case_id = 'case ' || o_orderkey WHERE refusal IS NULL""",
)
def republished(spark, folder):
    """A second publication with new numbers for some cases: those get a second version, and are re-read as such."""
    store = fresh_path(spark, "evidence-versions")
    first = bundles(spark, folder)
    publish(first, store, approved=True)
    changed = F.when(F.col("excluded_records") % 2 == 0, 0.8).otherwise(F.col("observed_auc"))
    again = publish(first.withColumn("observed_auc", changed), store, approved=True)
    documents = latest_versions(spark.read.parquet(f"{store}/documents"))
    return again.where("refusal is null").select("document_id", "target_urn", "status", "audit_document_reread").join(
        documents.select("document_id", "target_urn", "observed_auc", "version"), ["document_id", "target_urn"]
    )


@register(
    "incident_upsert",
    """SELECT 'urn:li:dataset:d_' || (o_custkey % 40) AS target_urn, 'Release blocked: ' || o_orderpriority AS title,
  1 AS incidents FROM orders GROUP BY ALL""",
)
def incidents(spark, folder):
    store = fresh_path(spark, "incidents")
    blocked = table(spark, folder, "orders").select(
        F.concat(F.lit("urn:li:dataset:d_"), (F.col("o_custkey") % 40).cast("string")).alias("target_urn"),
        F.col("o_orderpriority").alias("case_id"),
    )
    raise_incidents(blocked, store)
    return raise_incidents(blocked, store).groupBy("target_urn", "title").agg(
        F.count(F.lit(1)).cast("int").alias("incidents")
    )


@register(
    "target_binding",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'the evidence is not bound to an exact target'
  WHEN o_custkey % 5 <> n THEN 'the evidence is bound to another target' END AS reason
FROM (SELECT *, CAST(left(o_orderpriority, 1) AS BIGINT) - 1 AS n FROM orders)""",
)
def binding(spark, folder):
    orders = table(spark, folder, "orders")
    evidence = orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("audit"),
        F.concat(F.lit("urn:"), (F.col("o_custkey") % 5).cast("string")).alias("target_urn"),
    )
    first = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    bindings = (
        orders.where(F.col("o_orderpriority") != "5-LOW")
        .select(
            F.col("o_orderpriority").alias("audit"),
            F.concat(F.lit("urn:"), first.cast("string")).alias("target_urn"),
        )
        .distinct()
    )
    return bound_evidence(evidence, bindings).select("o_orderkey", "reason")


@register(
    "record_runs",
    f"""WITH {RUNS_SQL}
SELECT run_id, scenario, release_decision, runtime_seconds, CAST(left(run_id, 4) AS INTEGER) AS run_year FROM runs""",
)
def recorded(spark, folder):
    path = fresh_path(spark, "runs")
    record_runs(runs(spark, folder), path, grain="year")
    return spark.read.parquet(path).select(
        "run_id", "scenario", "release_decision", "runtime_seconds", F.year("run_date").alias("run_year")
    )


@register(
    "new_run_id",
    """SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || '-' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS run_id
FROM events""",
)
def run_ids(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", new_run_id(F.col("ts"), F.col("event_id").cast("string")).alias("run_id")
    )


# -- integrity ----------------------------------------------------------------------------


def _manifest(spark, folder):
    """A manifest over the documents: some paths escape, some files are missing or changed."""
    n = F.col("doc_id") % 10
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    documents = table(spark, folder, "documents")
    manifest = documents.select(
        F.when(n == 0, F.concat(F.lit("../"), path)).otherwise(path).alias("path"),
        F.sha2("text", 256).alias("sha256"),
    )
    changed = F.when(n == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    files = documents.where(n != 2).select(path.alias("path"), F.sha2(changed, 256).alias("actual"))
    return manifest, files


@register(
    "manifest_integrity",
    """SELECT CASE doc_id % 10 WHEN 0 THEN '../' ELSE '' END || 'docs/' || doc_id || '.txt' AS path,
  CASE doc_id % 10 WHEN 0 THEN 'path escapes the root: ../' WHEN 1 THEN 'sha256 mismatch: '
    ELSE 'missing file: ' END || 'docs/' || doc_id || '.txt' AS error
FROM documents WHERE doc_id % 10 < 3""",
)
def integrity(spark, folder):
    return integrity_errors(*_manifest(spark, folder))


@register(
    "sidecar_differences",
    """SELECT 'docs/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 10 <> 0 THEN sha256(text) END AS sha256,
  CASE doc_id % 10 WHEN 1 THEN sha256(text || '!') WHEN 2 THEN NULL ELSE sha256(text) END AS listed
FROM documents WHERE doc_id % 10 < 3
UNION ALL SELECT '../docs/' || doc_id || '.txt', sha256(text), NULL FROM documents WHERE doc_id % 10 = 0""",
)
def sidecar(spark, folder):
    manifest, files = _manifest(spark, folder)
    return sidecar_differences(manifest, files.withColumnRenamed("actual", "sha256"))


@register(
    "expected_vs_actual",
    """SELECT o_orderkey, o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0 AND o_orderstatus <> 'P' AS verdict_matches,
  o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0 AS price_matches,
  o_orderkey % 9 <> 0 AS is_expected, o_orderkey % 8 <> 0 AS is_actual
FROM orders WHERE o_orderkey % 9 <> 0 OR o_orderkey % 8 <> 0""",
)
def expectations(spark, folder):
    return _expectations(spark, folder)


def _expectations(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("verdict"), F.col("o_totalprice").alias("price")
    )
    changed = orders.withColumn("verdict", F.when(F.col("verdict") != "P", F.col("verdict")))
    return compared(
        orders.where(F.col("o_orderkey") % 9 != 0),
        changed.where(F.col("o_orderkey") % 8 != 0),
        ["o_orderkey"],
        ["verdict", "price"],
    )


@register(
    "all_checks",
    """SELECT bool_and(o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0 AND o_orderstatus <> 'P') AS verdict_matches,
  bool_and(o_orderkey % 9 <> 0) AS is_expected, 'failed' AS status
FROM orders WHERE o_orderkey % 9 <> 0 OR o_orderkey % 8 <> 0""",
)
def conjunction(spark, folder):
    return all_checks(_expectations(spark, folder), ["verdict_matches", "is_expected"])


@register(
    "missing_fields",
    """SELECT 'urn:' || c_custkey AS urn,
  CASE WHEN c_custkey % 7 = 6 THEN 'id,days' WHEN c_custkey % 3 = 0 THEN 'days' ELSE '' END AS missing_fields,
  CASE WHEN c_custkey % 7 = 6 OR c_custkey % 5 = 0 THEN 'leak' ELSE '' END AS missing_tags
FROM customer""",
)
def drifted(spark, folder):
    key = F.col("c_custkey")
    customers = table(spark, folder, "customer")
    urn = F.concat(F.lit("urn:"), key.cast("string")).alias("urn")
    expected = customers.select(
        urn,
        F.array(F.lit("id"), F.lit("days")).alias("fields"),
        F.array(F.lit("leak")).alias("tags"),
    )
    live = customers.where(key % 7 != 6).select(
        urn,
        F.when(key % 3 == 0, F.array(F.lit("id"), F.lit("extra")))
        .otherwise(F.array(F.lit("days"), F.lit("id"))).alias("fields"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("leak"))).alias("tags"),
    )
    return missing_fields(expected, live).select(
        "urn", F.array_join("missing_fields", ",").alias("missing_fields"),
        F.array_join("missing_tags", ",").alias("missing_tags"),
    )


@register("input_fingerprint", None)
def inputs(spark, folder):
    """Hash and size of every given table file."""
    return fingerprint(spark, folder, "parquet").withColumn(
        "path", F.substring_index("path", "/", -1)
    )


# -- release gate -------------------------------------------------------------------------


def change_events(spark, folder) -> DataFrame:
    """One change event per row of ``events``, in both envelope shapes; clicks are redelivered."""
    urn = F.concat(F.lit("urn:li:mlModel:m_"), (F.col("user_id") % 20).cast("string"))
    body = (
        F.when(F.col("event_type") == "view", F.format_string('{"urn": "urn:li:dashboard:%s"}', "event_id"))
        .when(
            F.col("event_type") == "signup",
            F.format_string('{"event": {"entityUrn": "%s", "entityType": "mlModel", "n": %s}}', urn, "event_id"),
        )
        .when(F.col("event_type") == "error", F.format_string("not json %s", "event_id"))
        .otherwise(F.format_string('{"entityUrn": "%s", "k": %s}', urn, F.get_json_object("props", "$.k")))
    )
    return table(spark, folder, "events").select(body.alias("value"))


def model_cases(spark, folder) -> DataFrame:
    """One case per model; a few models have no case, or a query nobody scanned."""
    m = F.col("m")
    return (
        table(spark, folder, "events")
        .select((F.col("user_id") % 20).alias("m"))
        .distinct()
        .where(m != 7)
        .select(
            F.concat(F.lit("case_"), m.cast("string")).alias("case_id"),
            F.concat(F.lit("urn:li:mlModel:m_"), m.cast("string")).alias("model_urn"),
            F.array(F.lit("a.b"), F.lit("c.d")).alias("lineage_path"),
            F.when(m % 3 == 0, "post_outcome").otherwise("pre_outcome").alias("source_kind"),
            F.lit("2026-02-10 09:00:00").cast("timestamp").alias("source_available_at"),
            F.lit("2026-01-10 09:00:00").cast("timestamp").alias("prediction_time"),
            F.lit(True).alias("metadata_complete"),
            (m % 5 == 1).alias("suspicious_common_ancestry"),
            F.lit(False).alias("deterministic_cutoff_proof"),
            F.lit(False).alias("point_in_time_advantage_collapsed"),
            F.lit("leaked").alias("subject"),
            F.when(m != 9, F.when(m % 2 == 0, "violation").otherwise("safe")).alias("guard_status"),
        )
    )


_GATE = """
watched AS (
  SELECT DISTINCT user_id % 20 AS m, CASE event_type WHEN 'signup' THEN 's' || event_id
    ELSE 'k' || json_extract_string(props, '$.k') END AS body
  FROM events WHERE event_type IN ('signup', 'click', 'purchase')),
audited AS (
  SELECT 'urn:li:mlModel:m_' || m AS urn,
    CASE WHEN m % 3 = 0 AND m % 2 = 0 THEN 'confirmed' WHEN m % 3 = 0 THEN 'high_confidence'
      WHEN m % 5 = 1 THEN 'needs_review' ELSE 'clear_for_release' END AS verdict
  FROM watched WHERE m NOT IN (7, 9))
"""


def _run_gate(spark, folder) -> GateConfig:
    """The whole stream, delivered twice and drained by two runs of the gate."""
    root = fresh_path(spark, "gate")
    config = GateConfig(store=f"{root}/store")
    cases = model_cases(spark, folder).persist()
    for _ in range(2):
        change_events(spark, folder).write.mode("append").text(f"{root}/events")
        stream = file_events(spark, f"{root}/events")
        start_gate(stream, cases, config, f"{root}/checkpoint", availableNow=True).awaitTermination()
    cases.unpersist()
    return config


@register(
    "release_gate",
    f"""WITH {_GATE}
SELECT urn, verdict, CASE WHEN verdict IN ('confirmed', 'high_confidence') THEN 'block'
    WHEN verdict = 'clear_for_release' THEN 'allow' ELSE 'review' END AS release_decision,
  CASE verdict WHEN 'confirmed' THEN 'deterministic_sql_time_proof' ELSE 'none' END AS confirmation_route,
  count(*) AS audits FROM audited GROUP BY ALL""",
)
def gate(spark, folder):
    proof = read_proof(spark, _run_gate(spark, folder))
    return proof.groupBy("urn", "verdict", "release_decision", "confirmation_route").agg(
        F.count(F.lit(1)).alias("audits")
    )


@register(
    "gate_summary",
    f"""WITH {_GATE}
SELECT count(*) AS audited, count(*) FILTER (WHERE verdict IN ('confirmed', 'high_confidence')) AS blocked
FROM audited""",
)
def gate_totals(spark, folder):
    return gate_summary(read_proof(spark, _run_gate(spark, folder)))

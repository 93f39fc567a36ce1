"""Replay recorded evidence against its ground truth, and compare it with a live catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.verdict import CaseColumns, release_decision, verdict
from cutline.operators.corpus import verify_queries
from cutline.operators.evidence import CANDIDATE_TAG
from cutline.operators.integrity import (
    all_checks,
    integrity_errors,
    missing_fields,
    sidecar_differences,
)
from cutline.session import settle
from cutline.sources.corpus import read_sql_corpus
from cutline.sources.manifests import read_file_hashes, read_manifest, read_sidecar

REPORTED_ERRORS = 100
_QUERIES = ("transformation.sql", "remediation.sql")
_CASE = (
    "case_id string, model_urn string, feature_urn string, lineage_path array<string>, "
    "source_kind string, source_available_at string, prediction_time string, expected_verdict string"
)
_SIDE = "struct<observed_advantage: double, collapsed: boolean>"


def replay(spark: SparkSession, root: str, post_outcome_table: str, errors_to: str | None = None) -> dict:
    """Nine checks of a fixture folder; any damaged file fails it before anything is judged.

    The report names the first errors and counts all; ``errors_to`` receives every one as a table of JSON lines.
    """
    root = root.rstrip("/")
    manifest = read_manifest(spark, root)
    damage = settle(integrity_errors(manifest, read_file_hashes(spark, root)))
    if errors_to is not None:
        damage.write.mode("overwrite").json(errors_to)
    errors = [row["error"] for row in damage.orderBy("error").limit(REPORTED_ERRORS).collect()]
    error_count = damage.count()
    if not sidecar_differences(manifest, read_sidecar(spark, root)).isEmpty():
        errors.append("hashes.txt does not match manifest.json")
        error_count += 1
    header = spark.read.schema(
        "fixture_id string, expected struct<leakage_verdict: string, safe_control_verdict: string, "
        "release_decision: string, transformation_status: string, remediation_status: string>"
    ).json(f"{root}/manifest.json", multiLine=True).first()
    if errors:
        return {
            "fixture_id": header["fixture_id"],
            "status": "integrity_failed",
            "errors": errors,
            "error_count": error_count,
            "exit_code": 2,
        }
    cases = {row["side"]: row for row in recorded_cases(spark, root).collect()}
    leak, safe = cases["leakage_case"], cases["safe_control"]
    both = read_sql_corpus(spark, root).where(F.col("path").isin(*_QUERIES))
    queries = {r["path"]: r["status"] for r in verify_queries(both, post_outcome_table).collect()}
    entity = read_entity(spark, root)
    lineage = read_lineage(spark, root).first()
    tagged = entity.where(
        (F.col("field") == lineage["target_column"])
        & F.exists("tags", lambda tag: tag.endswith(CANDIDATE_TAG))
    )
    expected = header["expected"]
    checks = {
        "manifest_hashes_verified": True,
        "hashes_txt_matches_manifest": True,
        "recorded_field_tag_present": not tagged.isEmpty(),
        "lineage_direction_is_upstream": lineage["direction"] == "upstream",
        "leakage_verdict_matches_ground_truth": leak["verdict"]
        == leak["expected_verdict"]
        == expected["leakage_verdict"],
        "safe_control_matches_ground_truth": safe["verdict"]
        == safe["expected_verdict"]
        == expected["safe_control_verdict"],
        "release_decision_matches_ground_truth": leak["release_decision"]
        == leak["expected_release_decision"]
        == expected["release_decision"],
        "transformation_violation_reproduced": queries.get(_QUERIES[0])
        == expected["transformation_status"],
        "remediation_safe_reproduced": queries.get(_QUERIES[1])
        == expected["remediation_status"],
    }
    held = all(checks.values())
    return {
        "fixture_id": header["fixture_id"],
        "status": "passed" if held else "failed",
        "checks": checks,
        "verdicts": {side: row["verdict"] for side, row in cases.items()},
        "release_decision": leak["release_decision"],
        "exit_code": 0 if held else 2,
    }


def recorded_cases(spark: SparkSession, root: str) -> DataFrame:
    """The suspect and the control of a fixture, judged from its recorded numbers."""
    nested = _CASE.replace(" string", ": string").replace(" array", ": array")
    truth = spark.read.schema(
        f"{_CASE}, expected_release_decision string, safe_control struct<{nested}>"
    ).json(f"{root}/ground_truth.json", multiLine=True)
    numbers = spark.read.schema(f"leakage_case {_SIDE}, safe_control {_SIDE}").json(
        f"{root}/responses/validation.json", multiLine=True
    )
    path = read_lineage(spark, root).select(F.col("path").alias("recorded_path"))
    names = [f.split()[0] for f in _CASE.split(", ")]
    # Each file holds one document, so these joins have one row on either side.
    one = F.lit(1).alias("_one")
    row = (
        truth.select("*", one)
        .join(numbers.select(F.struct("*").alias("numbers"), one), "_one")
        .join(path.select("*", one), "_one")
    )
    leak = row.select(
        F.lit("leakage_case").alias("side"),
        *[F.col(n) if n != "lineage_path" else F.col("recorded_path").alias(n) for n in names],
        "expected_release_decision",
        F.col("numbers.leakage_case.collapsed").alias("collapsed"),
    )
    safe = row.select(
        F.lit("safe_control").alias("side"),
        *[F.col(f"safe_control.{n}").alias(n) for n in names],
        F.lit(None).cast("string").alias("expected_release_decision"),
        F.col("numbers.safe_control.collapsed").alias("collapsed"),
    )
    case = CaseColumns(
        metadata_complete=F.lit(True),
        lineage_path=F.col("lineage_path"),
        source_kind=F.col("source_kind"),
        source_available_at=F.col("source_available_at").try_cast("timestamp"),
        prediction_time=F.col("prediction_time").try_cast("timestamp"),
        suspicious_common_ancestry=F.lit(False),
        deterministic_cutoff_proof=F.lit(False),
        point_in_time_advantage_collapsed=F.col("collapsed"),
    )
    judged = leak.unionByName(safe).withColumn("verdict", verdict(case))
    return judged.withColumn("release_decision", release_decision(F.col("verdict")))


def read_entity(spark: SparkSession, root: str) -> DataFrame:
    """``field, tags`` of the recorded asset."""
    schema = "schema array<struct<field_path: string, native_type: string, tags: array<string>>>"
    entity = spark.read.schema(schema).json(f"{root}/responses/entity.json", multiLine=True)
    return entity.select(F.inline("schema")).select(F.col("field_path").alias("field"), "tags")


def read_lineage(spark: SparkSession, root: str) -> DataFrame:
    node = "struct<dataset: string, column: string>"
    schema = f"direction string, hops int, source {node}, target {node}, path array<string>"
    lineage = spark.read.schema(schema).json(f"{root}/responses/lineage.json", multiLine=True)
    return lineage.select(
        "direction", "hops", "path",
        F.col("source.column").alias("source_column"),
        F.col("target.column").alias("target_column"),
    )


def drift(
    spark: SparkSession,
    root: str,
    post_outcome_table: str,
    live_assets: DataFrame,
    live_lineage: DataFrame,
    target_urn: str,
) -> dict:
    """Five checks of a fixture against exported catalog tables.

    ``live_assets`` holds ``urn, fields, tags`` (tags of the audited column), ``live_lineage``
    holds ``urn, columns`` (every column named upstream of it).
    """
    offline = replay(spark, root, post_outcome_table)
    if offline["status"] != "passed":
        return {"status": "fixture_integrity_failed", "offline": offline}
    lineage = read_lineage(spark, root).first()
    entity = read_entity(spark, root)
    expected = entity.agg(F.collect_set("field").alias("fields")).select(
        F.lit(target_urn).alias("urn"),
        "fields",
        F.array(F.lit(CANDIDATE_TAG)).alias("tags"),
    )
    # Tags are compared by their last part, whatever namespace the catalog uses.
    live = live_assets.where(F.col("urn") == target_urn).withColumn(
        "tags", F.transform("tags", lambda tag: F.element_at(F.split(tag, ":"), -1))
    )
    gaps = missing_fields(expected, live)
    columns = live_lineage.where(F.col("urn") == target_urn).select("urn", "columns")
    joined = gaps.join(columns, "urn", "left")

    def known(name: str):
        return F.coalesce(F.array_contains("columns", name), F.lit(False))

    flags = joined.select(
        F.lit(True).alias("offline_fixture_replay_passed"),
        (F.size("missing_fields") == 0).alias("expected_schema_fields_present"),
        (F.size("missing_tags") == 0).alias("candidate_field_tag_present"),
        known(lineage["target_column"]).alias("target_column_lineage_present"),
        known(lineage["source_column"]).alias("upstream_column_lineage_present"),
    )
    row = all_checks(flags, flags.columns).first().asDict()
    status = row.pop("status")
    return {
        "status": status,
        "target_urn": target_urn,
        "fixture_id": offline["fixture_id"],
        "checks": row,
    }

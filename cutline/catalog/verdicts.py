"""The verdict lattice, routes, policy and bundle rules over case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import register, table
from cutline.functions.verdict import (
    CLEAR,
    REASON_ANCESTRY,
    REASON_CLEAR,
    REASON_COLLAPSE,
    REASON_DIRECTION,
    REASON_SQL_PROOF,
    audit_cases,
    bundle_errors,
    verdict_exit_code,
)
from cutline.plans.audit import decide, trace_rows


def cases(spark, folder):
    """One case per line item: every combination of flags and kinds occurs."""
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    kind = (
        F.when(n % 6 == 0, "label").when(n % 6 == 1, "post_outcome").when(n % 6 == 2, "pre_outcome")
        .when(n % 6 == 3, "outcome").when(n % 6 == 4, "unknown")
    )
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"),
        F.when(n % 17 != 0, F.array(F.lit("shipments.shipped_at"), F.lit("features.shipped")))
        .alias("lineage_path"),
        kind.alias("source_kind"),
        F.when(n % 19 != 0, F.col("l_shipdate")).alias("source_available_at"),
        F.when(n % 23 != 0, F.col("o_orderdate")).alias("prediction_time"),
        F.when(n % 29 != 0, n % 31 != 0).alias("metadata_complete"),
        (n % 3 == 0).alias("suspicious_common_ancestry"),
        F.when(n % 5 != 0, n % 5 == 1).alias("deterministic_cutoff_proof"),
        (n % 4 == 0).alias("point_in_time_advantage_collapsed"),
        F.col("l_discount").alias("ablation_delta"),
    )


_CASES = """
cases AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line, l_extendedprice AS price, l_shipdate, o_orderdate,
    l_orderkey * 7 + l_linenumber AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
facts AS (
  SELECT *, n % 17 = 0 AS no_path, n % 6 = 5 AS no_kind, n % 19 = 0 AS no_available,
    n % 23 = 0 AS no_cutoff, n % 29 <> 0 AND n % 31 = 0 AS incomplete,
    n % 6 IN (0, 1) AS is_outcome, l_shipdate > o_orderdate AS late,
    n % 5 = 1 AS proof, n % 4 = 0 AS collapsed, n % 3 = 0 AS ancestry FROM cases),
judged AS (
  SELECT *, concat_ws(', ', CASE WHEN incomplete THEN 'metadata_complete' END,
      CASE WHEN no_path THEN 'lineage_path' END, CASE WHEN no_kind THEN 'source_kind' END,
      CASE WHEN no_available THEN 'source_available_at' END,
      CASE WHEN no_cutoff THEN 'prediction_time' END) AS missing,
    CASE WHEN incomplete OR no_path OR no_kind OR no_available OR no_cutoff THEN 'insufficient_metadata'
      WHEN is_outcome AND late AND (proof OR collapsed) THEN 'confirmed'
      WHEN is_outcome AND late THEN 'high_confidence'
      WHEN ancestry THEN 'needs_review' ELSE 'clear_for_release' END AS verdict FROM facts)
"""
_DECISION = """CASE WHEN verdict IN ('confirmed', 'high_confidence') THEN 'block'
    WHEN verdict = 'clear_for_release' THEN 'allow' ELSE 'review' END"""
_EXIT = """CASE WHEN verdict = 'clear_for_release' THEN 0
    WHEN verdict IN ('confirmed', 'high_confidence') THEN 3 ELSE 2 END"""


@register(
    "verdict_lattice",
    f"""WITH {_CASES}
SELECT order_key, line, price, verdict, {_EXIT} AS exit_code, {_DECISION} AS release_decision,
  CASE WHEN verdict = 'insufficient_metadata' THEN 'Required evidence is missing: ' || missing
    WHEN is_outcome AND late AND proof THEN '{REASON_SQL_PROOF}'
    WHEN is_outcome AND late AND collapsed THEN '{REASON_COLLAPSE}'
    WHEN is_outcome AND late THEN '{REASON_DIRECTION}'
    WHEN verdict = 'needs_review' THEN '{REASON_ANCESTRY}' ELSE '{REASON_CLEAR}' END AS reason
FROM judged""",
)
def lattice(spark, folder):
    return audit_cases(cases(spark, folder)).select(
        "order_key", "line", "price", "verdict", "exit_code", "release_decision",
        F.element_at("reasons", 1).alias("reason"),
    )


@register(
    "missing_evidence", f"WITH {_CASES} SELECT order_key, line, price, missing FROM judged"
)
def missing(spark, folder):
    return audit_cases(cases(spark, folder)).select(
        "order_key", "line", "price", F.array_join("missing", ", ").alias("missing")
    )


@register(
    "verdict_lattice_strict",
    f"""WITH {_CASES}
SELECT order_key, line, price,
  CASE WHEN verdict = 'insufficient_metadata' THEN verdict
    WHEN (is_outcome OR n % 6 = 3) AND late AND (proof OR collapsed) THEN 'confirmed'
    WHEN (is_outcome OR n % 6 = 3) AND late THEN 'high_confidence'
    WHEN ancestry OR (n % 6 = 4 AND late) THEN 'needs_review' ELSE 'clear_for_release' END AS verdict
FROM judged""",
)
def strict(spark, folder):
    judged = audit_cases(cases(spark, folder), strict=True)
    return judged.select("order_key", "line", "price", "verdict")


@register(
    "verdict_counts",
    f"WITH {_CASES} SELECT verdict, {_EXIT} AS exit_code, count(*) AS cases FROM judged GROUP BY ALL",
)
def verdict_counts(spark, folder):
    judged = audit_cases(cases(spark, folder))
    return judged.groupBy("verdict", verdict_exit_code(F.col("verdict")).alias("exit_code")).agg(
        F.count(F.lit(1)).alias("cases")
    )


@register(
    "resolve_verdict",
    f"""WITH {_CASES}, scanned AS (
  SELECT order_key, line, price, verdict AS point,
    CASE n % 3 WHEN 0 THEN 'violation' WHEN 1 THEN 'safe' ELSE 'indeterminate' END AS guard_status,
    CASE WHEN n % 7 = 0 THEN 'safe_control' ELSE 'leaked' END AS subject FROM judged),
resolved AS (
  SELECT *, guard_status = 'violation' AND subject <> 'safe_control' AS proof,
    CASE WHEN point = 'high_confidence' AND guard_status = 'violation' AND subject <> 'safe_control'
      THEN 'confirmed' ELSE point END AS verdict FROM scanned)
SELECT order_key, line, price, guard_status, subject, verdict, {_DECISION} AS release_decision,
  CASE {_DECISION} WHEN 'block' THEN 3 WHEN 'allow' THEN 0 ELSE 2 END AS exit_code,
  CASE WHEN point = 'confirmed' THEN 'point_in_time_collapse'
    WHEN point = 'high_confidence' AND proof THEN 'deterministic_sql_time_proof' ELSE 'none' END
    AS confirmation_route FROM resolved""",
)
def resolve(spark, folder):
    n = F.col("order_key") * 7 + F.col("line")
    judged = audit_cases(cases(spark, folder)).select(
        "order_key", "line", "price",
        F.col("verdict").alias("point_in_time_verdict"),
        F.when(n % 3 == 0, "violation").when(n % 3 == 1, "safe").otherwise("indeterminate")
        .alias("guard_status"),
        F.when(n % 7 == 0, "safe_control").otherwise("leaked").alias("subject"),
    )
    return decide(judged).drop("point_in_time_verdict")


@register(
    "trace_rows",
    f"""WITH {_CASES}, steps AS (
  SELECT order_key, line, price, verdict, n, unnest([1, 2, 3, 4, 5]) AS position FROM judged)
SELECT order_key || '-' || line AS case_id, position,
  CASE position WHEN 1 THEN 'transformation_verification' WHEN 2 THEN 'point_in_time_reconstruction'
    WHEN 3 THEN 'deterministic_verdict' WHEN 4 THEN 'safe_control' ELSE 'writeback' END AS step,
  CASE position WHEN 1 THEN CASE WHEN n % 2 = 0 THEN 'violation' ELSE 'safe' END WHEN 2 THEN 'passed'
    WHEN 3 THEN verdict WHEN 4 THEN 'clear_for_release' ELSE 'awaiting_human_approval' END AS status,
  CASE position WHEN 1 THEN 'scan' WHEN 2 THEN CAST(n AS VARCHAR) WHEN 3 THEN 'lattice'
    WHEN 4 THEN '0.5' END AS detail
FROM steps""",
)
def trace(spark, folder):
    n = F.col("order_key") * 7 + F.col("line")
    judged = audit_cases(cases(spark, folder))
    return trace_rows(
        judged.select(
            "case_id",
            F.when(n % 2 == 0, "violation").otherwise("safe").alias("guard_status"),
            F.lit("scan").alias("guard_reason"),
            F.lit("passed").alias("self_check"),
            n.alias("excluded_records"),
            "verdict",
            F.lit("lattice").alias("reason"),
            F.lit(CLEAR).alias("safe_verdict"),
            F.lit(0.5).alias("safe_delta"),
        )
    )


@register(
    "bundle_errors",
    """WITH bundles AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, l_orderkey * 7 + l_linenumber AS n FROM lineitem),
facts AS (
  SELECT *, CASE n % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'high_confidence' WHEN 2 THEN 'clear_for_release'
      WHEN 3 THEN 'needs_review' WHEN 4 THEN 'insufficient_metadata' ELSE 'guilty' END AS verdict,
    n % 13 = 0 AS no_model, n % 11 = 0 AS no_time, n % 4 < 3 AS directional, n % 5 < 3 AS violation,
    n % 7 = 0 AS deterministic, n % 3 < 2 AS performed, (n % 9) / 8.0 AS retained,
    CASE WHEN n % 17 = 0 THEN 1.5 ELSE 0.5 END AS threshold, n % 8 < 5 AS control FROM bundles),
derived AS (
  SELECT *, directional AND violation AS flow, threshold <= 1 AS measured,
    performed AND threshold <= 1 AND retained <= threshold AS collapsed FROM facts)
SELECT l_orderkey, l_linenumber, l_extendedprice, concat_ws('; ',
  CASE WHEN verdict = 'guilty' THEN 'unknown_verdict: guilty' END,
  CASE WHEN no_model THEN 'unnamed: model' END,
  CASE WHEN no_time AND verdict IN ('high_confidence', 'confirmed', 'clear_for_release') THEN 'undated: decision' END,
  CASE WHEN NOT flow AND verdict IN ('high_confidence', 'confirmed') THEN 'ungrounded: verdict' END,
  CASE WHEN NOT flow AND deterministic THEN 'ungrounded: proof' END,
  CASE WHEN NOT flow AND collapsed THEN 'ungrounded: collapse' END,
  CASE WHEN performed AND NOT measured THEN 'unmeasured: rebuild' END,
  CASE WHEN verdict = 'confirmed' AND NOT deterministic AND NOT collapsed THEN 'unconfirmed: proof_or_collapse'
    WHEN verdict = 'confirmed' AND NOT deterministic AND NOT control THEN 'unconfirmed: control' END,
  CASE WHEN verdict = 'clear_for_release' AND violation THEN 'not_clear: late_records' END,
  CASE WHEN verdict = 'clear_for_release' AND NOT control THEN 'not_clear: control' END) AS errors
FROM derived""",
)
def rules(spark, folder):
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    name = (
        F.when(n % 6 == 0, "confirmed").when(n % 6 == 1, "high_confidence")
        .when(n % 6 == 2, "clear_for_release").when(n % 6 == 3, "needs_review")
        .when(n % 6 == 4, "insufficient_metadata").otherwise("guilty")
    )
    bundles = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        name.alias("verdict"),
        F.when(n % 13 != 0, "urn:li:mlModel:m").otherwise(" ").alias("model_urn"),
        F.when(n % 11 != 0, "2026-01-10T09:00:00Z").alias("prediction_time"),
        (n % 4 < 3).alias("directional_outcome_lineage"),
        (n % 5 < 3).alias("availability_violation"),
        (n % 7 == 0).alias("deterministic_cutoff_proof"),
        (n % 3 < 2).alias("pit_performed"),
        ((n % 9) / 8).alias("advantage_retained"),
        F.when(n % 17 == 0, 1.5).otherwise(0.5).alias("collapse_threshold"),
        F.lit(True).alias("control_performed"),
        (n % 8 < 5).alias("control_remained_safe"),
    )
    return bundles.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.array_join(bundle_errors(), "; ").alias("errors"),
    )

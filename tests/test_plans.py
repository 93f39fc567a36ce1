"""Physical plans: what is read, how often it is shuffled, and what must never appear."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cutline.catalog import corpora
from cutline.catalog.inputs import order_decisions, user_decisions, user_records
from cutline.operators.asof import guarded_build, leaky_build, reconstruct, reconstruct_wide
from cutline.operators.corpus import scan_corpus, verify_queries
from cutline.operators.scoring import exact_auc
from cutline.operators.spread import SpreadPolicy

QUERIES = contract.queries()
LAZY = (
    "reconstruct", "reconstruct_orders", "reconstruct_features", "stacked_history", "asof_latest",
    "cutoff_filter", "decisions_without_records", "decisions_without_pit_record", "conflicting_records",
    "leaky_event_count", "guarded_event_count", "canonical_decisions", "contract_profile", "wide_to_long",
    "guard_status", "scan_corpus", "auc_exact", "compare_advantage", "sweep_rank", "contaminate",
    "detector_metrics", "reach_bands", "run_groups", "recent_runs", "latest_run", "verdict_lattice",
    "resolve_verdict", "trace_rows", "bundle_errors", "manifest_integrity", "expected_vs_actual",
    "missing_fields", "target_binding", "path_nodes", "path_normalisation", "rebuild_wide", "urn_parts",
)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_no_python_rows(spark, sf_dir, no_broadcast, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert operator not in text


def exchanges(text: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange ", text))


def test_the_scan_never_shuffles(spark, sf_dir):
    texts = corpora.query_texts(spark, sf_dir)
    assert exchanges(plan(scan_corpus(texts, ["payments_after"]))) == 0
    assert exchanges(plan(verify_queries(texts, "payments_after"))) == 0


def test_a_reconstruction_shuffles_each_side_once(spark, sf_dir, no_broadcast, tmp_path):
    decisions, records = str(tmp_path / "d"), str(tmp_path / "r")
    user_decisions(spark, sf_dir).write.parquet(decisions)
    user_records(spark, sf_dir).withColumn("unused", F.lit("x")).write.parquet(records)
    text = plan(reconstruct(spark.read.parquet(decisions), spark.read.parquet(records)))
    assert exchanges(text) == 2
    assert "unused" not in text and "feature#" not in text


def test_a_wide_rebuild_shuffles_the_history_once(spark, sf_dir, no_broadcast, tmp_path):
    decisions, records = str(tmp_path / "d"), str(tmp_path / "r")
    user_decisions(spark, sf_dir).write.parquet(decisions)
    user_records(spark, sf_dir).select(
        "entity_id", "available_at", F.col("feature_value").alias("a"), F.col("feature_value").alias("b"),
        F.lit(1.0).alias("unused"),
    ).write.parquet(records)
    frame = reconstruct_wide(
        spark.read.parquet(decisions), spark.read.parquet(records), ["a", "b"], SpreadPolicy(enabled=False)
    )
    # History once, decisions once, and the reduced entities.
    assert exchanges(plan(frame)) == 3


def test_small_decisions_are_broadcast_by_size(spark, sf_dir, tmp_path):
    decisions, records = str(tmp_path / "d"), str(tmp_path / "r")
    user_decisions(spark, sf_dir).write.parquet(decisions)
    user_records(spark, sf_dir).write.parquet(records)
    text = plan(reconstruct(spark.read.parquet(decisions), spark.read.parquet(records)))
    assert "BroadcastHashJoin" in text and "partial_max_by" in text
    assert exchanges(text) == 1


def test_builds_reduce_events_before_they_meet_decisions(spark, sf_dir, no_broadcast):
    decisions = order_decisions(spark, sf_dir)
    events = user_records(spark, sf_dir)
    for frame in (
        leaky_build(decisions, events, "entity_id", "prediction_time", "available_at"),
        guarded_build(decisions, events, "entity_id", "prediction_time", "available_at", small=True),
    ):
        text = plan(frame)
        assert "partial_count" in text and "Inner" not in text


def test_auc_meets_in_one_task_with_one_row_per_part_only(spark, sf_dir):
    scored = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (F.col("o_orderkey") % 2).alias("label"), F.col("o_totalprice").alias("score")
    )
    text = plan(exact_auc(scored, by=[], small=False))
    assert "rangepartitioning" in text
    # The only single-partition step comes after the per-part totals.
    single = text.index("SinglePartition")
    assert text.index("partial_sum", single) > single

"""Publication, run history, recorded fixtures and drift."""

from __future__ import annotations

import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cutline.operators.evidence import BUNDLES, latest_versions, publish, stored
from cutline.operators.runs import latest_runs, order_groups, run_groups
from cutline.plans.audit import write_report
from cutline.plans.replay import drift, replay
from cutline.sources.history import RUNS, list_runs, read_run_files, record_runs

TARGET = "urn:li:dataset:features"


def bundle(case="case 1", target=TARGET, bound=TARGET, known=True, verdict="confirmed", decision="block"):
    return (case, target, bound, "days", known, verdict, decision, "ab12", 0.9, 0.7, 12, 0.2, 1.0)


def test_nothing_is_written_without_approval(spark, tmp_path):
    store = str(tmp_path / "store")
    plan = publish(spark.createDataFrame([bundle()], BUNDLES), store).first()
    assert (plan["status"], plan["mutation_performed"]) == ("awaiting_human_approval", False)
    assert len(plan["planned_types"]) == 4
    assert not (tmp_path / "store").exists()


def test_approved_evidence_is_written_and_read_again(spark, tmp_path):
    store = str(tmp_path / "store")
    bundles = spark.createDataFrame([bundle(), bundle("case 2"), bundle("case 2")], BUNDLES)
    for _ in range(2):
        published = publish(bundles, store, approved=True).collect()
        assert {r["status"] for r in published} == {"published"}
    for name, count in (("tags", 1), ("properties", 1), ("documents", 2), ("incidents", 2)):
        assert spark.read.parquet(f"{store}/{name}").count() == count, name
    assert published[0]["document_id"].startswith("audit-case-")


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (bundle(verdict="high_confidence"), "confirmed"),
        (bundle(decision="review"), "confirmed"),
        (bundle(decision=None), "confirmed"),
        (bundle(target="urn:li:chart:c", bound="urn:li:chart:c"), "dataset"),
        (bundle(bound=None), "not bound"),
        (bundle(bound="urn:li:dataset:other"), "another target"),
        (bundle(known=False), "schema metadata"),
    ],
)
def test_refusals_keep_their_reason_and_write_nothing(spark, tmp_path, row, reason):
    store = str(tmp_path / "store")
    result = publish(spark.createDataFrame([row], BUNDLES), store, approved=True).first()
    assert result["status"] == "refused" and reason in result["refusal"]
    assert not result["mutation_performed"]
    like = spark.createDataFrame([("a", "b", "c")], "target_urn string, field string, tag string")
    assert stored(spark, store, "tags", like).isEmpty()


def run(run_id, scenario="s", decision="block", runtime=1.0, audit="nightly"):
    return (
        run_id, run_id[:8], audit, scenario, "c", "confirmed", decision, 3, runtime, 10, TARGET, False, "ab"
    )


def test_groups_of_runs(spark):
    runs = spark.createDataFrame(
        [
            run("20260101-a", runtime=1.0), run("20260102-a", runtime=2.0), run("20260103-a", runtime=3.0),
            run("20260104-a", decision="allow", runtime=4.0), run("20260105-a", "t", None, None),
            run("20260106-a", "t", None, 0.0), run("20260101-b", None, "allow"), run("20260101-c", None, "allow", audit=None),
        ],
        RUNS,
    )
    groups = {r["scenario"]: r for r in run_groups(runs).collect()}
    assert (groups["s"]["count"], groups["s"]["blocked"], groups["s"]["allowed"]) == (4, 3, 1)
    assert not groups["s"]["consistent"] and groups["s"]["median_runtime"] == 3.0
    # No decision at all is one value, so the group agrees with itself.
    assert groups["t"]["consistent"] and groups["t"]["median_runtime"] is None
    assert groups["s"]["latest_run_id"] == "20260104-a"
    assert set(groups) == {"s", "t", "nightly", "unknown"}
    assert order_groups(run_groups(runs)).first()["scenario"] == "t"
    assert rows(latest_runs(runs)) == [("s", "20260104-a"), ("t", "20260106-a")]


def test_run_files_that_are_no_runs_are_skipped(spark, tmp_path):
    good = {"run_id": "20260101T000000-abc123", "scenario": "s", "runtime_seconds": 0.5}
    for name, text in {
        "a": json.dumps(good), "b": "null", "c": "[1, 2]", "d": "7", "e": "{broken", "f": "{}"
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = read_run_files(spark, str(tmp_path))
    assert [r["run_id"] for r in found.collect()] == [good["run_id"]]


def test_runs_are_appended_and_listed_newest_first(spark, tmp_path):
    path = str(tmp_path / "runs")
    record_runs(spark.createDataFrame([run("20260101T1-a"), run("20260103T1-a")], RUNS), path)
    record_runs(spark.createDataFrame([run("20260102T1-a")], RUNS), path)
    history = spark.read.parquet(path)
    assert [r["run_id"] for r in list_runs(history, limit=2).collect()] == ["20260103T1-a", "20260102T1-a"]
    assert list_runs(history, limit=None).count() == 3


def test_reports_are_written(spark, tmp_path):
    write_report(spark, {"b": 1, "a": {"c": None}}, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0]) == {"a": {"c": None}, "b": 1}


JOINED = "select a.id from apps as a left join payments_late as p on p.k = a.k"


def fixture(folder, **changes):
    """A recorded audit with a manifest and a sidecar list of its hashes."""
    lineage = {
        "direction": "upstream", "hops": 1,
        "source": {"dataset": "payments_late", "column": "paid_at"},
        "target": {"dataset": "features", "column": "days"},
        "path": ["payments_late.paid_at", "features.days"],
    }
    case = {
        "case_id": "leak", "model_urn": "m1", "feature_urn": "f1", "source_kind": "post_outcome",
        "source_available_at": "2026-02-10T09:00:00Z", "prediction_time": "2026-01-10T09:00:00Z",
        "expected_verdict": "confirmed", "expected_release_decision": "block",
    }
    case["safe_control"] = {
        "case_id": "safe", "model_urn": "m2", "feature_urn": "f2", "lineage_path": ["h.x", "features.x"],
        "source_kind": "pre_outcome", "source_available_at": "2026-01-09T09:00:00Z",
        "prediction_time": "2026-01-10T09:00:00Z", "expected_verdict": "clear_for_release",
    }
    documents = {
        "ground_truth.json": case,
        "responses/lineage.json": lineage,
        "responses/entity.json": {
            "schema": [
                {"field_path": "id", "native_type": "string", "tags": []},
                {"field_path": "days", "native_type": "int", "tags": ["urn:li:tag:audit:leakage-candidate"]},
            ]
        },
        "responses/validation.json": {
            "leakage_case": {"observed_advantage": 0.3, "collapsed": True},
            "safe_control": {"observed_advantage": 0.2, "collapsed": False},
        },
    }
    texts = {name: json.dumps(body, indent=2) for name, body in documents.items()}
    texts["transformation.sql"] = JOINED
    texts["remediation.sql"] = JOINED + " and p.available_at <= a.prediction_time"
    texts.update(changes)
    (folder / "responses").mkdir(parents=True)
    for name, text in texts.items():
        (folder / name).write_text(text)
    hashes = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}
    manifest = {
        "fixture_id": "recorded-1",
        "files": [{"path": n, "sha256": h} for n, h in sorted(hashes.items())],
        "expected": {
            "leakage_verdict": "confirmed", "safe_control_verdict": "clear_for_release",
            "release_decision": "block", "transformation_status": "violation", "remediation_status": "safe",
        },
    }
    (folder / "manifest.json").write_text(json.dumps(manifest, indent=2))
    (folder / "hashes.txt").write_text("".join(f"{h}  {n}\n" for n, h in sorted(hashes.items())))
    return str(folder)


def test_a_recorded_audit_is_replayed(spark, tmp_path):
    result = replay(spark, fixture(tmp_path / "f"), "payments_late")
    assert result["status"] == "passed" and len(result["checks"]) == 9, result
    assert result["exit_code"] == 0 and result["release_decision"] == "block"


def test_another_result_fails_the_replay(spark, tmp_path):
    root = fixture(tmp_path / "f", **{"transformation.sql": "select 1 from apps"})
    result = replay(spark, root, "payments_late")
    assert result["status"] == "failed" and result["exit_code"] == 2
    assert not result["checks"]["transformation_violation_reproduced"]


def test_tampering_fails_closed(spark, tmp_path):
    root = fixture(tmp_path / "f")
    (tmp_path / "f" / "remediation.sql").write_text("select 1")
    result = replay(spark, root, "payments_late")
    assert result["status"] == "integrity_failed" and result["exit_code"] == 2
    assert result["errors"] == ["sha256 mismatch: remediation.sql"]


def test_a_sidecar_that_disagrees_fails_closed(spark, tmp_path):
    root = fixture(tmp_path / "f")
    (tmp_path / "f" / "hashes.txt").write_text("00  remediation.sql\n")
    assert replay(spark, root, "payments_late")["status"] == "integrity_failed"


def test_missing_and_escaping_files_fail_closed(spark, tmp_path):
    root = fixture(tmp_path / "f")
    manifest = json.loads((tmp_path / "f" / "manifest.json").read_text())
    manifest["files"] += [{"path": "gone.txt", "sha256": "0"}, {"path": "../out.txt", "sha256": "0"}]
    (tmp_path / "f" / "manifest.json").write_text(json.dumps(manifest))
    errors = replay(spark, root, "payments_late")["errors"]
    assert "missing file: gone.txt" in errors and "path escapes the root: ../out.txt" in errors


def test_drift_against_a_live_catalog(spark, tmp_path):
    root = fixture(tmp_path / "f")
    lineage = spark.createDataFrame([(TARGET, ["days", "paid_at"])], "urn string, columns array<string>")
    schema = "urn string, fields array<string>, tags array<string>"
    live = spark.createDataFrame([(TARGET, ["id", "days", "new"], ["urn:li:tag:x:leakage-candidate"])], schema)
    assert drift(spark, root, "payments_late", live, lineage, TARGET)["status"] == "passed"
    poorer = spark.createDataFrame([(TARGET, ["days"], ["other"])], schema)
    result = drift(spark, root, "payments_late", poorer, lineage.where(F.lit(False)), TARGET)
    assert result["status"] == "failed"
    assert [name for name, held in result["checks"].items() if held] == ["offline_fixture_replay_passed"]
    (tmp_path / "f" / "remediation.sql").write_text("x")
    tampered = drift(spark, root, "payments_late", live, lineage, TARGET)
    assert tampered["status"] == "fixture_integrity_failed"


def test_new_numbers_are_a_new_version(spark, tmp_path):
    store = str(tmp_path / "store")
    def numbered(row, auc):
        return (*row[:8], auc, *row[9:])

    rows_ = [bundle(), bundle("other case")]
    publish(spark.createDataFrame(rows_, BUNDLES), store, approved=True)
    rows_[0] = numbered(rows_[0], 0.5)
    again = {r["case_id"]: r for r in publish(spark.createDataFrame(rows_, BUNDLES), store, approved=True).collect()}
    assert all(r["status"] == "published" and r["audit_document_reread"] for r in again.values())
    held = spark.read.parquet(f"{store}/documents")
    assert held.count() == 3
    latest = {r["title"]: (r["observed_auc"], r["version"]) for r in latest_versions(held).collect()}
    assert latest["Audit: case 1"] == (0.5, 2) and latest["Audit: other case"][1] == 1
    # Two bundles that disagree on one document: one of them holds, and only that one reads as published.
    both = [rows_[0], numbered(rows_[0], 0.25)]
    statuses = sorted(r["status"] for r in publish(spark.createDataFrame(both, BUNDLES), store, approved=True).collect())
    assert statuses == ["published", "verification_failed"]

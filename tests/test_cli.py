"""Commands, their exit codes and audit files."""

from __future__ import annotations

import json

import pytest
from test_contract import loans, write
from test_evidence import fixture

from cutline.cli import main
from cutline.operators.contract import ContractError
from cutline.plans.audit import AuditConfig
from cutline.sources.cases import EDGES

LEAKY = "select l.id from loans l left join payments p on p.loan = l.id"
GUARDED = LEAKY + " and p.available_at <= l.prediction_time"


def run(spark, capsys, *argv):
    code = main([str(a) for a in argv], spark)
    return code, json.loads(capsys.readouterr().out)


def audit_file(folder, query=LEAKY, subject="leaked", target="urn:li:dataset:features"):
    write(folder, *loans())
    (folder / "leaky.sql").write_text(query)
    (folder / "fixed.sql").write_text(GUARDED)
    (folder / "audits").mkdir(exist_ok=True)
    path = folder / "audits" / "loans.json"
    payload = {
        "scenario": "scenario.json", "transformation_sql": "leaky.sql", "remediation_sql": "fixed.sql",
        "post_outcome_table": "payments", "subject": subject, "target_urn": target,
    }
    path.write_text(json.dumps(payload))
    return path


def test_validate_and_invalid_input(spark, capsys, tmp_path):
    path = write(tmp_path, *loans())
    code, report = run(spark, capsys, "--output", tmp_path / "out.json", "validate", "--scenario", path)
    assert code == 3 and report["verdict"] == "confirmed"
    assert json.loads((tmp_path / "out.json").read_text())["config_sha256"] == report["config_sha256"]
    assert report["reconstruction"]["input"]["applications"]["files"] == 1
    code, report = run(spark, capsys, "validate", "--scenario", tmp_path / "gone.json")
    assert code == 2 and report["status"] == "invalid_input"


def test_a_bad_sweep_is_no_pass(spark, capsys, tmp_path):
    code, report = run(spark, capsys, "sweep", "--scenario", write(tmp_path, *loans()))
    assert code == 2 and report["status"] == "invalid_input"


def test_scan_and_verify(spark, capsys, tmp_path):
    for name, text in {"bad.sql": LEAKY, "ok/ok.sql": "select 1", "odd/odd.sql": "not sql"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    table = "--post-outcome-table", "payments"
    code, report = run(spark, capsys, "scan", tmp_path, *table)
    assert code == 3 and report["scanned"] == 3
    assert [f["path"] for f in report["first_findings"]] == ["bad.sql", "odd/odd.sql"]
    assert run(spark, capsys, "scan", tmp_path / "ok", *table)[0] == 0
    assert run(spark, capsys, "scan", tmp_path / "odd", *table)[0] == 2
    assert run(spark, capsys, "verify", tmp_path / "bad.sql", *table)[0] == 3
    assert run(spark, capsys, "verify", tmp_path / "ok" / "ok.sql", *table)[0] == 0


def test_an_audit_file_end_to_end(spark, capsys, tmp_path):
    path = audit_file(tmp_path)
    runs = tmp_path / "runs"
    code, bundle = run(spark, capsys, "audit", "--audit", path, "--runs", runs)
    assert code == 3 and bundle["release_decision"] == "block"
    assert bundle["confirmation_route"] == "point_in_time_collapse"
    assert [step["step"] for step in bundle["trace"]][0] == "transformation_verification"
    assert bundle["remediation"]["verification"]["status"] == "safe"
    assert all(bundle["checks"].values())
    recorded = spark.read.parquet(str(runs)).first()
    assert recorded["audit"] == "loans" and len(recorded["evidence_sha256"]) == 64

    assets = tmp_path / "assets"
    spark.createDataFrame(
        [("urn:li:dataset:features", ["id", "days"])], "urn string, fields array<string>"
    ).write.parquet(str(assets))
    shared = ("--audit", path, "--store", tmp_path / "store", "--assets", assets, "--target-urn")
    code, plan = run(spark, capsys, "publish", *shared, "urn:li:dataset:features")
    assert (code, plan["status"]) == (2, "awaiting_human_approval")
    code, refused = run(spark, capsys, "publish", *shared, "urn:li:dataset:other", "--approve")
    assert (code, refused["status"]) == (2, "refused")
    code, done = run(spark, capsys, "publish", *shared, "urn:li:dataset:features", "--approve")
    assert (code, done["status"]) == (0, "published")


def test_a_repaired_pipeline_clears(spark, capsys, tmp_path):
    code, bundle = run(spark, capsys, "audit", "--audit", audit_file(tmp_path, GUARDED, "safe_control"))
    assert (code, bundle["release_decision"], bundle["confirmation_route"]) == (0, "allow", "none")


def test_audit_files_are_checked(tmp_path):
    path = audit_file(tmp_path)
    assert AuditConfig.load(str(path)).describes("urn:li:dataset:features")
    with pytest.raises(ContractError, match="not found"):
        AuditConfig.load(str(tmp_path / "gone.json"))
    (tmp_path / "leaky.sql").rename(tmp_path / "moved.sql")
    with pytest.raises(ContractError, match="transformation_sql"):
        AuditConfig.load(str(path))
    with pytest.raises(ContractError, match="urn:li:"):
        AuditConfig.load(str(audit_file(tmp_path, target="features")))
    path.write_text(json.dumps({"scenario": "scenario.json"}))
    with pytest.raises(ContractError, match="missing"):
        AuditConfig.load(str(path))


def test_trace_replay_and_cases(spark, capsys, tmp_path):
    edges = tmp_path / "edges"
    spark.createDataFrame([("a.x", "b.x", None)], EDGES).write.parquet(str(edges))
    assert run(spark, capsys, "trace", "--edges", edges, "--source", "a.x", "--target", "b.x")[0] == 3
    assert run(spark, capsys, "trace", "--edges", edges, "--source", "b.x", "--target", "a.x")[0] == 0
    empty = tmp_path / "empty"
    spark.createDataFrame([], EDGES).write.parquet(str(empty))
    assert run(spark, capsys, "trace", "--edges", empty, "--source", "a.x", "--target", "b.x")[0] == 2
    root = fixture(tmp_path / "f")
    assert run(spark, capsys, "replay", "--fixture", root, "--post-outcome-table", "payments_late")[0] == 0
    (tmp_path / "cases").mkdir()
    case = {"case_id": "c", "model_urn": "m", "feature_urn": "f"}
    (tmp_path / "cases" / "c.json").write_text(json.dumps(case))
    code, report = run(spark, capsys, "cases", tmp_path / "cases")
    assert code == 2 and report["verdicts"][0]["verdict"] == "insufficient_metadata"

"""The streaming gate: envelopes, filters, redelivery, failure and restart."""

from __future__ import annotations

import json

import pytest
from conftest import rows

from cutline.sources.events import file_events
from cutline.streaming import gate as gate_module
from cutline.streaming.gate import GateConfig, gate_summary, parse_events, read_proof, run_batch, start_gate

MODEL = "urn:li:mlModel:(p,m,PROD)"
CASES = (
    "case_id string, model_urn string, lineage_path array<string>, source_kind string, "
    "source_available_at timestamp, prediction_time timestamp, metadata_complete boolean, "
    "suspicious_common_ancestry boolean, deterministic_cutoff_proof boolean, "
    "point_in_time_advantage_collapsed boolean, subject string, guard_status string"
)


def cases(spark, *models):
    from datetime import datetime

    data = [
        (
            f"case-{m}", m, ["a.b", "c.d"], "post_outcome", datetime(2026, 2, 10), datetime(2026, 1, 10),
            True, False, False, False, "leaked", "violation",
        )
        for m in models
    ]
    return spark.createDataFrame(data, CASES)


def event(urn=MODEL, kind="mlModel", **more):
    return json.dumps({"entityUrn": urn, "entityType": kind, **more})


@pytest.mark.parametrize(
    ("body", "urn", "kind"),
    [
        (event(), MODEL, "mlModel"),
        ('{"urn": "urn:li:dataset:(p,d,PROD)"}', "urn:li:dataset:(p,d,PROD)", "dataset"),
        (json.dumps({"event": {"entityUrn": MODEL}, "meta": {"o": 1}}), MODEL, "mlModel"),
        (json.dumps(event()), MODEL, "mlModel"),
        ("{}", None, None),
        ('{"entityUrn": null}', None, None),
        ('{"entityUrn": "plain"}', "plain", None),
        ("no json", None, None),
        ("", None, None),
    ],
)
def test_envelopes(spark, body, urn, kind):
    parsed = parse_events(spark.createDataFrame([(body,)], "body string")).first()
    assert (parsed["urn"], parsed["entity_type"]) == (urn, kind)


def deliver(folder, name, *bodies):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(bodies) + "\n")


def drain(spark, tmp_path, known, **config):
    settings = GateConfig(store=str(tmp_path / "store"), **config)
    stream = file_events(spark, str(tmp_path / "in"))
    start_gate(stream, known, settings, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    return read_proof(spark, settings)


def test_redelivery_is_skipped_and_a_changed_body_is_audited_again(spark, tmp_path):
    known = cases(spark, MODEL)
    deliver(tmp_path / "in", "1", event(), event(), event("urn:li:dashboard:d", "dashboard"), "junk")
    proof = drain(spark, tmp_path, known)
    assert [(r["urn"], r["verdict"], r["release_decision"]) for r in proof.collect()] == [
        (MODEL, "confirmed", "block")
    ]
    # The gate is started again from its checkpoint: the same delivery, then a later change.
    deliver(tmp_path / "in", "2", event())
    assert drain(spark, tmp_path, known).count() == 1
    deliver(tmp_path / "in", "3", event(aspectName="properties"))
    proof = drain(spark, tmp_path, known)
    assert rows(gate_summary(proof)) == [(2, 2)]
    incidents = spark.read.parquet(str(tmp_path / "store" / "incidents"))
    assert incidents.count() == 1, "a blocked model raises one incident, however often it is audited"


def test_a_failed_audit_is_kept_and_retried_on_redelivery(spark, tmp_path):
    other = "urn:li:mlModel:other"
    deliver(tmp_path / "in", "1", event(), event(other))
    proof = drain(spark, tmp_path, cases(spark, other))
    assert [r["urn"] for r in proof.collect()] == [other], "one bad event must not stop the rest"
    rejects = spark.read.parquet(str(tmp_path / "store" / "rejects"))
    assert [(r["urn"], r["error"]) for r in rejects.collect()] == [
        (MODEL, "no evidence describes this asset")
    ]
    deliver(tmp_path / "in", "2", event(), event(other))
    proof = drain(spark, tmp_path, cases(spark, MODEL, other))
    assert sorted(r["urn"] for r in proof.collect()) == sorted([MODEL, other])


def test_a_bound_gate_ignores_other_assets_and_incidents_can_be_off(spark, tmp_path):
    other = "urn:li:mlModel:other"
    deliver(tmp_path / "in", "1", event(), event(other))
    proof = drain(spark, tmp_path, cases(spark, MODEL, other), target_urn=other, raise_incident=False)
    assert [r["urn"] for r in proof.collect()] == [other]
    assert not (tmp_path / "store" / "incidents").exists()
    assert not (tmp_path / "store" / "documents").exists(), "the gate never publishes"


def test_a_crash_before_the_proof_is_repaired_by_the_next_run(spark, tmp_path, monkeypatch):
    deliver(tmp_path / "in", "1", event())
    known = cases(spark, MODEL)
    real = gate_module.raise_incidents

    def crash(blocked, store):
        real(blocked, store)
        raise RuntimeError("lost")

    monkeypatch.setattr(gate_module, "raise_incidents", crash)
    with pytest.raises(Exception, match="lost"):
        drain(spark, tmp_path, known)
    assert read_proof(spark, GateConfig(str(tmp_path / "store"))).isEmpty()
    monkeypatch.setattr(gate_module, "raise_incidents", real)
    assert drain(spark, tmp_path, known).count() == 1
    assert spark.read.parquet(str(tmp_path / "store" / "incidents")).count() == 1


def test_running_a_batch_twice_changes_nothing(spark, tmp_path):
    config = GateConfig(store=str(tmp_path / "store"))
    batch = spark.createDataFrame([(event(),), (event("urn:li:mlModel:x"),)], "body string")
    for _ in range(2):
        run_batch(batch, 5, cases(spark, MODEL), config)
    assert read_proof(spark, config).count() == 1
    assert spark.read.parquet(str(tmp_path / "store" / "rejects")).count() == 1

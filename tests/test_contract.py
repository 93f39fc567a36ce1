"""Binding, casting and the refusals of the input contract."""

from __future__ import annotations

import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cutline.functions import casting
from cutline.operators.contract import Binding, ContractError, rejected_rows
from cutline.plans.scenario import Identity, load_scenario
from cutline.plans.sweep import sweep
from cutline.plans.validate import check_decisions, rebuild, validate
from cutline.sources import relations
from cutline.sources.relations import Relation, fingerprint, read_relation

MAPPING = {
    "entity_id": "loan key",
    "prediction_time": "decision timestamp",
    "label": "did default",
    "split": "split",
    "base_features": ["ratio", "tenure"],
    "safe_feature": "prior misses",
    "record_entity_id": "record loan",
    "available_time": "recorded timestamp",
    "feature_value": "days value",
}
IDENTITY = {
    "decision_node": "loans.decided",
    "leakage_case_id": "loans-late",
    "safe_case_id": "loans-safe",
    "leakage_model_urn": "urn:li:mlModel:m1",
    "safe_model_urn": "urn:li:mlModel:m2",
    "leakage_feature_urn": "urn:li:schemaField:(t,days)",
    "safe_feature_urn": "urn:li:schemaField:(t,misses)",
    "leakage_lineage_path": ["payments.recorded", "features.days"],
    "safe_lineage_path": ["loans.misses", "features.misses"],
    "leakage_available_offset_days": 31,
    "safe_available_offset_days": -1,
}
TRAIN, TEST = 160, 40


def loans():
    """200 decisions whose late record gives the label away, and a predictive safe column."""
    decisions, records = [], []
    for i in range(TRAIN + TEST):
        key = f"{i:04d}"
        misses = (i * 37) % 11
        label = int(misses + (i * 53) % 7 > 7)
        split = " TRAIN " if i < TRAIN else "test"
        ratio, tenure = (i * 29) % 100 / 100, (i * 17) % 40
        decisions.append([key, "2026-01-10T09:00:00Z", str(label), split, str(ratio), str(tenure), str(misses)])
        honest = (i * 71) % 30
        records.append([key, "2026-01-09 09:00:00", str(honest)])
        records.append([key, "2026-02-10 09:00:00", str(150 + i % 3 if label else 4 + i % 3)])
    return decisions, records


def write(folder, decisions, records, **changes):
    names = ["loan key", "decision timestamp", "did default", "split", "ratio", "tenure", "prior misses"]
    history = ["record loan", "recorded timestamp", "days value"]
    for file, head, body in (("loans.csv", names, decisions), ("records.csv", history, records)):
        (folder / file).write_text("\n".join(",".join(r) for r in [head, *body]) + "\n")
    adapter = {
        "kind": "files",
        "applications": {"path": "loans.csv"},
        "feature_records": {"path": "records.csv", "format": "csv"},
        "columns": dict(MAPPING),
    }
    config = {
        "scenario": "loans",
        "train_rows": TRAIN,
        "test_rows": TEST,
        "prediction_time": "2026-01-10T09:00:00Z",
        "collapse_rule": {"minimum_observed_advantage": 0.05, "maximum_advantage_retained": 0.5},
        "safe_control_rule": {"minimum_ablation_delta": 0.02},
        "audit_evidence": dict(IDENTITY),
        "point_in_time_adapter": adapter,
    }
    for path, value in changes.items():
        target = config
        *parents, last = path.split("__")
        for parent in parents:
            target = target[parent]
        if value is None:
            del target[last]
        else:
            target[last] = value
    (folder / "scenario.json").write_text(json.dumps(config))
    return str(folder / "scenario.json")


def test_a_whole_audit_from_files(spark, tmp_path):
    report = validate(load_scenario(spark, write(tmp_path, *loans())))
    leak, safe = report["leakage_case"], report["safe_control"]
    assert report["reconstruction"]["excluded_post_cutoff_records"] == TRAIN + TEST
    assert leak["observed_auc"] == 1.0 and leak["collapsed"]
    assert not safe["collapsed"] and safe["observed_auc"] == safe["point_in_time_auc"]
    assert report["self_check"]["status"] == "passed"
    assert report["verdict"] == "confirmed" and report["exit_code"] == 3
    assert report["verdicts"]["safe_control"]["verdict"] == "clear_for_release"
    again = validate(load_scenario(spark, str(tmp_path / "scenario.json")))
    assert again["leakage_case"] == leak


def refused(spark, folder, decisions, records, **changes):
    scenario = load_scenario(spark, write(folder, decisions, records, **changes))
    with pytest.raises(ContractError) as caught:
        check_decisions(scenario)
        rebuilt = rebuild(scenario, scenario.features)
        for reason in rebuilt.faults.values():
            raise ContractError(reason)
    return str(caught.value)


def test_duplicate_keys_are_refused(spark, tmp_path):
    decisions, records = loans()
    decisions[1][0] = decisions[0][0]
    assert "must be unique" in refused(spark, tmp_path, decisions, records)


def test_blank_base_features_are_refused(spark, tmp_path):
    decisions, records = loans()
    decisions[3][4] = ""
    assert "null or unparseable" in refused(spark, tmp_path, decisions, records)


def test_unknown_splits_are_refused(spark, tmp_path):
    decisions, records = loans()
    decisions[3][3] = "holdout"
    assert "split counts" in refused(spark, tmp_path, decisions, records)


def test_a_third_class_is_refused(spark, tmp_path):
    decisions, records = loans()
    decisions[3][2] = "2"
    assert "exactly two classes" in refused(spark, tmp_path, decisions, records)


def test_undeclared_row_counts_are_refused(spark, tmp_path):
    decisions, records = loans()
    assert "declared number" in refused(spark, tmp_path, decisions, records, test_rows=41)


def test_conflicting_records_are_refused(spark, tmp_path):
    decisions, records = loans()
    records.append([records[0][0], records[0][1], "999"])
    assert "conflicting values" in refused(spark, tmp_path, decisions, records)


def test_exact_copies_of_a_record_are_no_conflict(spark, tmp_path):
    decisions, records = loans()
    records.append(list(records[0]))
    scenario = load_scenario(spark, write(tmp_path, decisions, records))
    assert not rebuild(scenario, scenario.features).faults


def test_unreadable_records_are_refused(spark, tmp_path):
    decisions, records = loans()
    records[5][1] = "soon"
    assert "null or unparseable" in refused(spark, tmp_path, decisions, records)


def test_decisions_without_history_are_refused(spark, tmp_path):
    decisions, records = loans()
    gone = [r for r in records if r[0] != decisions[0][0]]
    assert "at least one record" in refused(spark, tmp_path, decisions, gone)
    late = [r for r in records if r[0] != decisions[0][0] or r[1] > "2026-02"]
    assert "by its prediction time" in refused(spark, tmp_path, decisions, late)


def test_incomplete_configurations_are_refused(spark, tmp_path):
    files = loans()
    adapter = "point_in_time_adapter"
    for change in (
        {f"{adapter}__columns__label": None},
        {f"{adapter}__columns__base_features": "ratio"},
        {f"{adapter}__kind": "warehouse"},
        {f"{adapter}__applications": {"path": "loans.xlsx"}},
        {f"{adapter}__applications": {}},
        {"audit_evidence__safe_model_urn": None},
        {"audit_evidence__leakage_lineage_path": ["one.node"]},
    ):
        with pytest.raises(ContractError):
            load_scenario(spark, write(tmp_path, *files, **change))


def test_missing_files_are_refused(spark, tmp_path):
    path = write(tmp_path, *loans(), point_in_time_adapter__applications={"path": "gone.csv"})
    with pytest.raises(ContractError, match="not found"):
        load_scenario(spark, path)


def test_a_sweep_needs_wide_snapshots(spark, tmp_path):
    with pytest.raises(ContractError, match="wide"):
        sweep(load_scenario(spark, write(tmp_path, *loans())))


def test_csv_keys_keep_leading_zeros_and_fingerprints_are_exact(spark, tmp_path):
    write(tmp_path, *loans())
    path = str(tmp_path / "loans.csv")
    frame = read_relation(spark, Relation(path, "csv"))
    assert frame.first()["loan key"] == "0000"
    row = fingerprint(spark, path, "csv").first()
    content = (tmp_path / "loans.csv").read_bytes()
    assert (row["sha256"], row["bytes"]) == (hashlib.sha256(content).hexdigest(), len(content))


def test_tables_and_parquet_are_read_too(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(4).createOrReplaceTempView("decisions_view")
    relation = Relation.from_config({"path": "t.parquet"}, "applications", str(tmp_path))
    assert read_relation(spark, relation).count() == 3
    named = Relation.from_config({"path": "decisions_view", "format": "table"}, "applications", "/")
    assert read_relation(spark, named).count() == 4


def test_casts_turn_what_they_cannot_read_into_null(spark):
    values = ["1", "1.0", " 0 ", "1.5", "yes", "", None, "1e2", "3d", "4f", "2.5D"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = frame.select(
        "i", casting.number(F.col("v")).alias("n"), casting.class_label(F.col("v")).alias("c")
    ).orderBy("i")
    numbers = [r["n"] for r in got.collect()]
    assert numbers == [1.0, 1.0, 0.0, 1.5, None, None, None, 100.0, None, None, None]
    assert [r["c"] for r in got.collect()] == [1, 1, 0, None, None, None, None, 100, None, None, None]


def test_instants_are_normalised_to_utc(spark):
    values = ["2026-01-10T09:00:00Z", "2026-01-10T00:00:00+02:00", "2026-01-10 09:00:00", "soon"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [str(r[0]) for r in frame.select(casting.instant(F.col("v"))).collect()]
    assert got == ["2026-01-10 09:00:00", "2026-01-09 22:00:00", "2026-01-10 09:00:00", "None"]


def test_odd_column_names_are_quoted(spark):
    frame = spark.createDataFrame([(1,)], "`a.b ``c` int")
    assert frame.select(casting.column("a.b `c")).first()[0] == 1
    with pytest.raises(ValueError):
        casting.column(" ")


def test_rejects_name_their_faults(spark):
    frame = spark.createDataFrame([("a", None), (None, None), ("b", 1)], "k string, v int")
    assert rows(rejected_rows(frame, ["k", "v"]).select(F.array_join("faults", ","))) == [("k,v",), ("v",)]


def test_bindings_and_identities_are_explicit():
    with pytest.raises(ContractError, match="missing: label"):
        Binding.from_mapping({**MAPPING, "label": ""}, wide=False)
    with pytest.raises(ContractError, match="snapshot_entity_id"):
        Binding.from_mapping(MAPPING, wide=True)
    identity = Identity.from_config(IDENTITY)
    assert (identity.leakage_feature_name, identity.safe_feature_name) == ("days", "misses")


def test_a_hash_means_the_same_at_every_size(spark, tmp_path, monkeypatch):
    for name, size in (("a.bin", 10), ("b.bin", 5000)):
        (tmp_path / name).write_bytes(b"x" * size)
    def found(**how):
        return {r["path"].rsplit("/", 1)[-1]: (r["sha256"], r["hashed"], r["bytes"]) for r in fingerprint(spark, str(tmp_path), "table", **how).collect()}

    whole = {n: (hashlib.sha256(b"x" * k).hexdigest(), "content", k) for n, k in (("a.bin", 10), ("b.bin", 5000))}
    assert found() == whole
    listed = found(by="listing")
    assert {v[1] for v in listed.values()} == {"listing"} and not {v[0] for v in listed.values()} & {v[0] for v in whole.values()}
    monkeypatch.setattr(relations, "LONGEST_VALUE", 1000)
    assert found() == {"a.bin": whole["a.bin"], "b.bin": (None, "beyond one value", 5000)}
    with pytest.raises(ContractError, match="hashed by"):
        fingerprint(spark, str(tmp_path), "table", by="size")

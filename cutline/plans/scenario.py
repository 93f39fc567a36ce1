"""A scenario: the rules of one audit, its input tables and the identities it reports."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cutline.operators.contract import (
    Binding,
    ContractError,
    canonical_decisions,
    canonical_snapshots,
)
from cutline.sources.relations import Relation, read_relation

# Fixed names of the evidence identities an external scenario must declare.
IDENTITIES = (
    "decision_node",
    "leakage_case_id",
    "safe_case_id",
    "leakage_model_urn",
    "safe_model_urn",
    "leakage_feature_urn",
    "safe_feature_urn",
    "leakage_lineage_path",
    "safe_lineage_path",
)
HISTORY = "feature_value"


@dataclass(frozen=True)
class Rules:
    """Row counts and thresholds declared by a scenario."""

    train_rows: int
    test_rows: int
    min_advantage: float = 0.05
    max_retained: float = 0.5
    min_control_delta: float = 0.05


@dataclass(frozen=True)
class Identity:
    """Who and what an audit's evidence is about."""

    decision_node: str
    leakage_case_id: str
    safe_case_id: str
    leakage_model_urn: str
    safe_model_urn: str
    leakage_feature_urn: str
    safe_feature_urn: str
    leakage_lineage_path: tuple[str, ...]
    safe_lineage_path: tuple[str, ...]
    leakage_available_offset_days: float | None = None
    safe_available_offset_days: float | None = None

    @classmethod
    def from_config(cls, supplied: Any) -> Identity:
        """Identities are never defaulted: evidence about the wrong artifact is worse than none."""
        if not isinstance(supplied, dict):
            raise ContractError("audit_evidence must be a JSON object")
        missing = [name for name in IDENTITIES if name not in supplied]
        if missing:
            raise ContractError("audit_evidence is missing: " + ", ".join(missing))
        for name in ("leakage_lineage_path", "safe_lineage_path"):
            path = supplied[name]
            whole = isinstance(path, list) and all(isinstance(n, str) and n for n in path)
            if not whole or len(path) < 2:
                raise ContractError(f"audit_evidence.{name} must contain at least two nodes")
        values = {name: supplied[name] for name in IDENTITIES}
        values["leakage_lineage_path"] = tuple(supplied["leakage_lineage_path"])
        values["safe_lineage_path"] = tuple(supplied["safe_lineage_path"])
        return cls(
            **values,
            leakage_available_offset_days=supplied.get("leakage_available_offset_days"),
            safe_available_offset_days=supplied.get("safe_available_offset_days"),
        )

    @property
    def leakage_feature_name(self) -> str:
        return self.leakage_lineage_path[-1].rsplit(".", 1)[-1]

    @property
    def safe_feature_name(self) -> str:
        return self.safe_lineage_path[-1].rsplit(".", 1)[-1]


@dataclass(frozen=True)
class Scenario:
    """Everything one audit needs. ``decisions`` are canonical; ``snapshots`` hold
    ``entity_id, available_at`` and one double column per feature."""

    name: str
    rules: Rules
    identity: Identity
    decisions: DataFrame
    snapshots: DataFrame
    base_width: int
    features: tuple[str, ...]
    prediction_time: str | None = None
    control: str | None = None
    missing_features: tuple[str, ...] = field(default=())
    kind: str = "files"
    config_sha256: str | None = None
    inputs: dict[str, Relation] = field(default_factory=dict)


def load_scenario(spark: SparkSession, path: str) -> Scenario:
    """Read a scenario file and bind its tables; no data is read yet."""
    with open(path, "rb") as handle:
        raw = handle.read()
    config = json.loads(raw)
    adapter = config.get("point_in_time_adapter")
    if not isinstance(adapter, dict):
        raise ContractError("point_in_time_adapter must be a JSON object")
    kind = adapter.get("kind")
    if kind not in ("files", "wide_snapshots"):
        raise ContractError("point_in_time_adapter.kind must be 'files' or 'wide_snapshots'")
    wide = kind == "wide_snapshots"
    folder = os.path.dirname(os.path.abspath(path))
    history_key = "feature_snapshots" if wide else "feature_records"
    decisions = Relation.from_config(adapter.get("applications"), "applications", folder)
    history = Relation.from_config(adapter.get(history_key), history_key, folder)
    declared = adapter.get("sweep_features")
    named = isinstance(declared, list) and all(isinstance(n, str) and n.strip() for n in declared)
    if declared is not None and not named:
        raise ContractError("sweep_features must be a list of column names")
    binding = Binding.from_mapping(adapter.get("columns"), wide, declared or ())
    collapse, control = config.get("collapse_rule", {}), config.get("safe_control_rule", {})
    rules = Rules(
        int(config["train_rows"]),
        int(config["test_rows"]),
        float(collapse.get("minimum_observed_advantage", Rules.min_advantage)),
        float(collapse.get("maximum_advantage_retained", Rules.max_retained)),
        float(control.get("minimum_ablation_delta", Rules.min_control_delta)),
    )
    scenario = bind_scenario(
        name=str(config.get("scenario")),
        rules=rules,
        identity=Identity.from_config(config.get("audit_evidence", {})),
        raw_decisions=read_relation(spark, decisions),
        raw_history=read_relation(spark, history),
        binding=binding,
        prediction_time=config.get("prediction_time"),
        kind=kind,
    )
    return replace(
        scenario,
        config_sha256=hashlib.sha256(raw).hexdigest(),
        inputs={"applications": decisions, history_key: history},
    )


def bind_scenario(
    name: str,
    rules: Rules,
    identity: Identity,
    raw_decisions: DataFrame,
    raw_history: DataFrame,
    binding: Binding,
    prediction_time: str | None = None,
    kind: str = "files",
) -> Scenario:
    """Bind user tables to the canonical contract."""
    wanted = [binding.history_value]
    wanted += [n for n in binding.sweep_features if n not in wanted]
    present = [n for n in wanted if n in raw_history.columns]
    control = binding.safe_feature if binding.wide and binding.safe_feature in raw_history.columns else None
    read = present + [control] * (control is not None and control not in present)
    return Scenario(
        name=name,
        rules=rules,
        identity=identity,
        decisions=canonical_decisions(raw_decisions, binding),
        snapshots=canonical_snapshots(
            raw_history, binding.history_entity_id, binding.history_time, read
        ),
        base_width=len(binding.base_features),
        features=tuple(present),
        prediction_time=prediction_time,
        control=control,
        missing_features=tuple(n for n in wanted if n not in present),
        kind=kind,
    )

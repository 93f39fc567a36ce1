"""Audit every candidate column of a wide history and rank them. Triage, never a verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.metrics import advantage_lost
from cutline.operators.contract import ContractError
from cutline.operators.scoring import fit_models, model_aucs
from cutline.operators.spread import SpreadPolicy
from cutline.plans.scenario import Scenario
from cutline.plans.validate import BASELINE, base_columns, check_decisions, compare_aucs, rebuild

EVALUATED = "evaluated"
FAILED = "could_not_evaluate"
FINDINGS = (
    "position int, feature string, status string, reason string, baseline double, "
    "observed double, point_in_time double, excluded_post_cutoff_records bigint"
)


def sweep(
    scenario: Scenario,
    candidates: Sequence[str] | None = None,
    spread: SpreadPolicy = SpreadPolicy(),
) -> DataFrame:
    """One row per candidate, ranked by the advantage lost to the cutoff.

    The history is scanned and shuffled once for all candidates, and the baseline is fitted
    once. A column that cannot be evaluated never stops the others.
    """
    if scenario.kind != "wide_snapshots":
        raise ContractError("a sweep needs a wide snapshot history")
    names = [*scenario.features, *scenario.missing_features] if candidates is None else candidates
    names = [n for n in names if n != scenario.control]
    if not names:
        raise ContractError("declare the columns to sweep")
    check_decisions(scenario)
    present = [n for n in names if n in scenario.features]
    rebuilt = rebuild(scenario, present, spread)
    good = [n for n in present if n not in rebuilt.faults]
    base = base_columns(scenario)
    models = {BASELINE: base}
    for n in good:
        models[rebuilt.observed(n)] = [*base, rebuilt.observed(n)]
        models[rebuilt.point_in_time(n)] = [*base, rebuilt.point_in_time(n)]
    aucs = model_aucs(rebuilt.frame, fit_models(rebuilt.frame, models))
    rows = []
    for position, n in enumerate(names):
        if n in good:
            pair = (aucs[rebuilt.observed(n)], aucs[rebuilt.point_in_time(n)])
            rows.append((position, n, EVALUATED, None, aucs[BASELINE], *pair, rebuilt.excluded))
        else:
            reason = rebuilt.faults.get(n, "the column is not in the history")
            rows.append((position, n, FAILED, reason, None, None, None, None))
    findings = scenario.decisions.sparkSession.createDataFrame(rows, FINDINGS)
    return rank_findings(findings, scenario.rules)


def rank_findings(findings: DataFrame, rules) -> DataFrame:
    """Largest loss first, ties in declared order, failures last."""
    evaluated = findings.where(F.col("status") == EVALUATED)
    compared = compare_aucs(
        findings.sparkSession, evaluated.withColumnRenamed("feature", "name"), rules
    ).withColumnRenamed("name", "feature")
    lost = advantage_lost(F.col("observed_advantage"), F.col("advantage_retained"))
    ranked = compared.withColumn("advantage_lost", lost)
    return (
        findings.drop("baseline", "observed", "point_in_time")
        .join(ranked, "feature", "left")
        .orderBy(F.col("status") != EVALUATED, F.desc("advantage_lost"), "position")
    )


def flagged(ranked: DataFrame) -> DataFrame:
    """Candidates whose advantage collapsed."""
    return ranked.where("collapsed").select("feature")

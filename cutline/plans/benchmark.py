"""Measure the audit on planted leaks of falling reach."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.metrics import comparison
from cutline.functions.verdict import (
    CaseColumns,
    confirmation_route,
    release_decision,
    resolved_verdict,
    verdict,
)
from cutline.operators.detector import contaminated
from cutline.operators.scoring import fit_models, model_aucs
from cutline.plans.scenario import Rules
from cutline.session import settle

# Fixed grid of the benchmark.
COVERAGES = (1.0, 0.7, 0.4, 0.25, 0.15, 0.08, 0.02)
SEEDS = (20260727, 20260801, 20260815)


def benchmark(
    frame: DataFrame,
    base: Sequence[str],
    clean: str,
    leaked: str,
    latest_at: str,
    latest_known_at: str,
    rules: Rules,
    queries: DataFrame,
    coverages: Sequence[float] = COVERAGES,
    seeds: Sequence[int] = SEEDS,
    draw: Callable[[int], Column] | None = None,
) -> DataFrame:
    """Judge every seed and coverage, through the unguarded and through the guarded query.

    ``frame`` holds one row per decision: ``entity_id, prediction_time, label, split_name``,
    the base columns, the value at the cutoff (``clean``), the value over all history
    (``leaked``) and the newest record time of either. ``queries`` gives one scanned
    ``guard_status`` per ``guarded`` flag. A clean case audits the *same* feature, built
    through the guarded query, so false positives are measured and not ruled out by design.
    ``draw`` gives the number in 0..1 that decides whether a seed hits a row.
    """
    grid = list(product(seeds, coverages))
    column = {cell: f"_reach_{i}" for i, cell in enumerate(grid)}
    # Settled once: the fits below read it many times.
    wide = settle(
        frame.withColumns(
            {
                name: contaminated(
                    F.col(clean), F.col(leaked), coverage, F.col("entity_id"), seed,
                    None if draw is None else draw(seed),
                )
                for (seed, coverage), name in column.items()
            }
        )
    )
    models = {"baseline": list(base), "clean": [*base, clean]}
    models.update({name: [*base, name] for name in column.values()})
    aucs = model_aucs(wide, fit_models(wide, models))
    clock = wide.agg(
        F.max("prediction_time").alias("cutoff"),
        F.max(latest_at).alias("late"),
        F.max(latest_known_at).alias("known"),
    ).first()
    rows = [
        (
            f"seed{seed}-cov{coverage}-{'clean' if guarded else 'leaked'}",
            seed, coverage, guarded,
            aucs["baseline"], aucs["clean"] if guarded else aucs[name], aucs["clean"],
            clock["known"] if guarded else clock["late"], clock["cutoff"],
        )
        for (seed, coverage), name in column.items()
        for guarded in (False, True)
    ]
    schema = (
        "case_id string, seed bigint, coverage double, guarded boolean, baseline double, "
        "observed double, point_in_time double, source_available_at timestamp_ntz, "
        "prediction_time timestamp_ntz"
    )
    cases = frame.sparkSession.createDataFrame(rows, schema)
    return judge_cases(cases.join(queries.select("guarded", "guard_status"), "guarded"), rules)


def judge_cases(cases: DataFrame, rules: Rules) -> DataFrame:
    """Verdict, decision and route of every benchmark case."""
    metrics = comparison(
        F.col("baseline"), F.col("observed"), F.col("point_in_time"),
        rules.min_advantage, rules.max_retained,
    )
    case = CaseColumns(
        metadata_complete=F.lit(True),
        lineage_path=F.array(F.lit("source"), F.lit("feature")),
        source_kind=F.lit("post_outcome"),
        source_available_at=F.col("source_available_at"),
        prediction_time=F.col("prediction_time"),
        suspicious_common_ancestry=F.lit(False),
        deterministic_cutoff_proof=F.lit(False),
        point_in_time_advantage_collapsed=F.col("collapsed"),
    )
    proof = F.col("guard_status") == "violation"
    judged = cases.withColumns(
        {name: value for name, value in metrics.items() if name not in cases.columns}
    )
    point = verdict(case)
    return (
        judged.withColumn("verdict", resolved_verdict(point, proof))
        .withColumn("decision", release_decision(F.col("verdict")))
        .withColumn("confirmation_route", confirmation_route(point, proof))
        .withColumn("is_leaked", ~F.col("guarded"))
        .withColumn("flagged", F.col("decision") == "block")
        .withColumn("correct", F.col("flagged") == F.col("is_leaked"))
    )

"""Scores, comparisons, detector metrics and run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.inputs import CASES_SQL, RUNS_SQL, judged_cases, runs
from cutline.catalog.registry import register, table
from cutline.functions.metrics import ablation_contrast, comparison, lost_percent
from cutline.operators.detector import (
    blind_from,
    confusion_counts,
    contaminated,
    detector_metrics,
    reach_bands,
    route_breakdown,
)
from cutline.operators.ordered import upper_median
from cutline.operators.runs import latest_runs, order_groups, recent_runs, run_groups, with_group
from cutline.operators.scoring import exact_auc
from cutline.plans.scenario import Rules
from cutline.plans.sweep import EVALUATED, rank_findings
from cutline.sources.history import list_runs

# -- exact AUC ----------------------------------------------------------------------------


def _priority_scores(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("model"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        # Coarse scores: ties within and across classes.
        F.floor(F.col("o_totalprice") / 1000 + F.when(F.col("o_orderstatus") == "F", 40).otherwise(0))
        .cast("double").alias("score"),
    )


def _auc_sql(source: str, by: str) -> str:
    return f"""
counted AS (
  SELECT {by}, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM {source} GROUP BY {by}, score),
running AS (
  SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) - neg AS lower FROM counted),
aucs AS (
  SELECT {by}, sum(pos * (lower + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE AS auc,
    sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives
  FROM running GROUP BY {by})"""


_PRIORITY = """scored AS (
  SELECT o_orderpriority AS model, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
    floor(o_totalprice / 1000 + CASE WHEN o_orderstatus = 'F' THEN 40 ELSE 0 END) AS score FROM orders)"""


@register(
    "auc_exact",
    f"WITH {_PRIORITY}, {_auc_sql('scored', 'model')} SELECT model, round(auc, 6) AS auc, positives, negatives FROM aucs",
)
def auc(spark, folder):
    return exact_auc(_priority_scores(spark, folder)).withColumn("auc", F.round("auc", 6))


def _nation_scores(spark, folder):
    """Three fixed scores per customer, as baseline, observed and point-in-time models."""
    noise = F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) / 1000
    positive = F.col("c_acctbal") > 4500
    weak = noise * 1000
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"),
        positive.cast("int").alias("label"),
        F.inline(
            F.array(
                F.struct(F.lit("baseline").alias("side"), F.floor(weak).cast("double").alias("score")),
                F.struct(
                    F.lit("observed").alias("side"),
                    F.floor(weak + F.when(positive, 600).otherwise(0)).cast("double").alias("score"),
                ),
                F.struct(
                    F.lit("point_in_time").alias("side"),
                    F.floor(
                        weak + F.when(positive, F.pmod("c_nationkey", F.lit(5)) * 120).otherwise(0)
                    ).cast("double").alias("score"),
                ),
            )
        ),
    )


_NATION = f"""
people AS (
  SELECT c_nationkey AS nation, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS label,
    CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS weak FROM customer),
scored AS (
  SELECT nation, label, 'baseline' AS side, weak AS score FROM people
  UNION ALL SELECT nation, label, 'observed', weak + 600 * label FROM people
  UNION ALL SELECT nation, label, 'point_in_time', weak + (nation % 5) * 120 * label FROM people),
{_auc_sql('scored', 'nation, side')},
sides AS (
  SELECT nation, max(round(auc, 6)) FILTER (WHERE side = 'baseline') AS baseline_auc,
    max(round(auc, 6)) FILTER (WHERE side = 'observed') AS observed_auc,
    max(round(auc, 6)) FILTER (WHERE side = 'point_in_time') AS point_in_time_auc
  FROM aucs GROUP BY nation),
compared AS (
  SELECT *, round(observed_auc - baseline_auc, 6) AS observed_advantage,
    round(point_in_time_auc - baseline_auc, 6) AS point_in_time_advantage FROM sides),
shared AS (
  SELECT *, CASE WHEN observed_advantage > 0 THEN point_in_time_advantage / observed_advantage
    ELSE 1.0 END AS share FROM compared)
"""


def _nation_sides(spark, folder):
    aucs = exact_auc(_nation_scores(spark, folder), by=["nation", "side"])
    value = F.round("auc", 6)
    return aucs.groupBy("nation").agg(
        *[
            F.max(F.when(F.col("side") == side, value)).alias(side)
            for side in ("baseline", "observed", "point_in_time")
        ]
    )


@register(
    "compare_advantage",
    f"""WITH {_NATION}
SELECT nation, baseline_auc, observed_auc, point_in_time_auc, observed_advantage,
  point_in_time_advantage, round(share, 6) AS advantage_retained,
  observed_advantage >= 0.05 AND share <= 0.5 AS collapsed,
  CAST(round_even((1 - round(share, 6)) * 100, 0) AS BIGINT) AS lost_percent FROM shared""",
)
def compare(spark, folder):
    metrics = comparison(
        F.col("baseline"), F.col("observed"), F.col("point_in_time"), 0.05, 0.5
    )
    compared = _nation_sides(spark, folder).select(
        "nation", *[value.alias(name) for name, value in metrics.items()]
    )
    return compared.withColumn("lost_percent", lost_percent(F.col("advantage_retained")))


@register(
    "sweep_rank",
    f"""WITH {_NATION}, lost AS (
  SELECT nation, observed_advantage, round(share, 6) AS advantage_retained,
    round(observed_advantage * (1 - round(share, 6)), 6) AS advantage_lost,
    observed_advantage >= 0.05 AND share <= 0.5 AS collapsed, nation % 7 <> 3 AS evaluated FROM shared)
SELECT CAST(nation AS VARCHAR) AS feature,
  CASE WHEN evaluated THEN 'evaluated' ELSE 'could_not_evaluate' END AS status,
  CASE WHEN evaluated THEN advantage_lost END AS advantage_lost,
  CASE WHEN evaluated THEN collapsed END AS collapsed FROM lost""",
)
def ranking(spark, folder):
    good = F.col("nation") % 7 != 3
    findings = _nation_sides(spark, folder).select(
        F.col("nation").alias("position"),
        F.col("nation").cast("string").alias("feature"),
        F.when(good, EVALUATED).otherwise("could_not_evaluate").alias("status"),
        F.lit(None).cast("string").alias("reason"),
        "baseline", "observed", "point_in_time",
    )
    ranked = rank_findings(findings, Rules(0, 0))
    return ranked.select("feature", "status", "advantage_lost", "collapsed")


@register(
    "ablation_contrast",
    """SELECT c_custkey, round(CAST(c_nationkey AS DOUBLE) / 64 - CAST(c_custkey % 32 AS DOUBLE) / 128, 6)
  AS safe_exceeds_leaked_by FROM customer""",
)
def contrast(spark, folder):
    safe = F.col("c_nationkey").cast("double") / 64
    leaked = (F.col("c_custkey") % 32).cast("double") / 128
    return table(spark, folder, "customer").select(
        "c_custkey", ablation_contrast(safe, leaked).alias("safe_exceeds_leaked_by")
    )


@register(
    "contaminate",
    " UNION ALL ".join(
        f"""SELECT {reach} AS reach_pct, o_orderkey,
  CASE WHEN (o_orderkey * 7919 + 20260727) % 1000 < {reach * 10} THEN 150.0 ELSE o_totalprice END AS value
FROM orders"""
        for reach in (100, 40, 15, 2)
    ),
)
def contaminate(spark, folder):
    key = F.col("o_orderkey")
    draw = F.pmod(key * 7919 + 20260727, F.lit(1000)) / 1000
    cells = F.array(
        *[
            F.struct(
                F.lit(reach).alias("reach_pct"),
                contaminated(
                    F.col("o_totalprice"), F.lit(150.0), reach / 100, key, 20260727, draw
                ).alias("value"),
            )
            for reach in (100, 40, 15, 2)
        ]
    )
    return table(spark, folder, "orders").select("o_orderkey", F.inline(cells))


# -- detector metrics ---------------------------------------------------------------------

_COUNTS = """counts AS (
  SELECT count(*) FILTER (WHERE is_leaked AND flagged) AS true_positive,
    count(*) FILTER (WHERE is_leaked AND NOT flagged) AS false_negative,
    count(*) FILTER (WHERE NOT is_leaked AND flagged) AS false_positive,
    count(*) FILTER (WHERE NOT is_leaked AND NOT flagged) AS true_negative FROM cases)"""


@register("confusion_counts", f"WITH {CASES_SQL}, {_COUNTS} SELECT * FROM counts")
def confusion(spark, folder):
    return confusion_counts(judged_cases(spark, folder))


@register(
    "detector_metrics",
    f"""WITH {CASES_SQL}, {_COUNTS}, rates AS (
  SELECT *, true_positive / (true_positive + false_positive) AS p,
    true_positive / (true_positive + false_negative) AS r FROM counts)
SELECT true_positive, false_negative, false_positive, true_negative, round(p, 4) AS precision,
  round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1,
  round((true_positive + true_negative)
    / (true_positive + true_negative + false_positive + false_negative), 4) AS accuracy FROM rates""",
)
def metrics(spark, folder):
    return detector_metrics(judged_cases(spark, folder))


_BREAKDOWN = """breakdown AS (
  SELECT coverage, count(*) AS cases, count(*) FILTER (WHERE flagged) AS caught,
    round(count(*) FILTER (WHERE flagged) / count(*), 4) AS recall,
    count(*) FILTER (WHERE collapsed) AS statistical_route_fired,
    round(count(*) FILTER (WHERE collapsed) / count(*), 4) AS statistical_recall,
    round(avg(observed_auc - point_in_time_auc), 4) AS mean_auc_delta
  FROM cases WHERE is_leaked GROUP BY coverage)"""
_BANDS = """bands AS (
  SELECT CAST(round_even(coverage * 100, 0) AS BIGINT) AS reach_pct, cases,
    statistical_route_fired AS statistical,
    greatest(0, caught - statistical_route_fired) AS deterministic_only,
    greatest(0, cases - caught) AS missed,
    CAST(round_even(statistical_route_fired / cases * 100, 0) AS BIGINT) AS statistical_pct,
    CAST(round_even(greatest(0, caught - statistical_route_fired) / cases * 100, 0) AS BIGINT)
      AS deterministic_only_pct,
    round(mean_auc_delta, 4) AS auc_delta, statistical_route_fired > 0 AS statistical_fired
  FROM breakdown)"""


@register("route_breakdown", f"WITH {CASES_SQL}, {_BREAKDOWN} SELECT * FROM breakdown")
def routes(spark, folder):
    return route_breakdown(judged_cases(spark, folder))


@register("reach_bands", f"WITH {CASES_SQL}, {_BREAKDOWN}, {_BANDS} SELECT * FROM bands")
def bands(spark, folder):
    return reach_bands(routes(spark, folder))


@register(
    "blind_from",
    f"""WITH {CASES_SQL}, {_BREAKDOWN}, {_BANDS}
SELECT max(reach_pct) FILTER (WHERE NOT statistical_fired) AS blind_from_pct FROM bands""",
)
def blind(spark, folder):
    return blind_from(bands(spark, folder))


# -- run history --------------------------------------------------------------------------

_GROUPS = """medians AS (
  SELECT scenario, runtime_seconds AS median_runtime FROM (
    SELECT scenario, runtime_seconds,
      row_number() OVER (PARTITION BY scenario ORDER BY runtime_seconds) AS place,
      count(*) OVER (PARTITION BY scenario) AS n
    FROM grouped WHERE runtime_seconds IS NOT NULL AND runtime_seconds <> 0)
  WHERE place = n // 2 + 1),
groups AS (
  SELECT scenario, count(*) AS count, count(*) FILTER (WHERE release_decision = 'block') AS blocked,
    count(*) FILTER (WHERE release_decision = 'allow') AS allowed,
    count(DISTINCT coalesce(release_decision, '?')) = 1 AS consistent,
    max(run_id) AS latest_run_id, arg_max(started_at, run_id) AS latest_started_at
  FROM grouped GROUP BY scenario)"""


@register(
    "run_groups",
    f"WITH {RUNS_SQL}, {_GROUPS} SELECT * FROM groups LEFT JOIN medians USING (scenario)",
)
def grouped_runs(spark, folder):
    return order_groups(run_groups(runs(spark, folder)))


@register("median_runtime", f"WITH {RUNS_SQL}, {_GROUPS} SELECT * FROM medians")
def medians(spark, folder):
    return upper_median(
        with_group(runs(spark, folder)), ["scenario"], "runtime_seconds", "median_runtime"
    )


@register(
    "total_runtime",
    f"WITH {RUNS_SQL} SELECT round(sum(runtime_seconds), 3) AS total_runtime_seconds FROM runs",
)
def total_runtime(spark, folder):
    seconds = F.sum("runtime_seconds")
    return runs(spark, folder).agg(F.round(seconds, 3).alias("total_runtime_seconds"))


@register(
    "latest_run",
    f"""WITH {RUNS_SQL}
SELECT scenario, max(run_id) AS run_id FROM runs WHERE scenario IS NOT NULL GROUP BY scenario""",
)
def newest_runs(spark, folder):
    return latest_runs(runs(spark, folder))


@register(
    "recent_runs",
    f"""WITH {RUNS_SQL}
SELECT scenario, run_id, place FROM (
  SELECT scenario, run_id, row_number() OVER (PARTITION BY scenario ORDER BY run_id DESC) AS place
  FROM grouped) WHERE place <= 12""",
)
def recent(spark, folder):
    found = recent_runs(runs(spark, folder))
    return found.select("scenario", "run_id", F.col("_rank").cast("bigint").alias("place"))


@register(
    "list_runs",
    f"WITH {RUNS_SQL} SELECT run_id, verdict FROM runs ORDER BY run_id DESC LIMIT 50",
)
def listed(spark, folder):
    return list_runs(runs(spark, folder)).select("run_id", "verdict")

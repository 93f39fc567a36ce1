"""Refit audits over customers: label, base columns and a planted leak in the order history."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.catalog.inputs import customer_decisions, customer_snapshots
from cutline.catalog.newton_sql import newton_sql
from cutline.catalog.registry import register, table
from cutline.operators.asof import reconstruct_wide
from cutline.operators.contract import BROKEN_RECORDS
from cutline.operators.corpus import verify_queries
from cutline.operators.detector import detector_metrics, reach_bands, route_breakdown
from cutline.operators.scoring import exact_auc, fit_models, scores, train_scales
from cutline.plans.audit import audit
from cutline.plans.benchmark import COVERAGES, SEEDS, benchmark
from cutline.plans.scenario import Identity, Rules, Scenario
from cutline.plans.sweep import sweep
from cutline.plans.validate import rebuild, validate
from cutline.session import settle

CANDIDATES = ("days_since_last", "partly_leaked", "honest_history", "strong_honest", "gappy")
LEAKY_SQL = (
    "select c.customer_id, max(o.recorded_at) as days from customers as c"
    " left join orders_after as o on o.customer_id = c.customer_id group by c.customer_id"
)
GUARDED_SQL = (
    "select c.customer_id, max(o.recorded_at) as days from customers as c"
    " left join orders_after as o on o.customer_id = c.customer_id"
    " and o.available_at <= c.prediction_time group by c.customer_id"
)


def customer_scenario(spark, folder, features=CANDIDATES, kind="wide_snapshots") -> Scenario:
    # The fits read the decisions many times, so their derivation is cut off once.
    decisions = settle(customer_decisions(spark, folder))
    counts = decisions.agg(
        F.count_if(F.col("split_name") == "train").alias("train"),
        F.count_if(F.col("split_name") == "test").alias("test"),
    ).first()
    identity = Identity(
        decision_node="customers.prediction_time",
        leakage_case_id="customers-late-orders",
        safe_case_id="customers-prior-score",
        leakage_model_urn="urn:li:mlModel:(urn:li:dataPlatform:mlflow,shop.risk_v1,PROD)",
        safe_model_urn="urn:li:mlModel:(urn:li:dataPlatform:mlflow,shop.risk_v2,PROD)",
        leakage_feature_urn="urn:li:schemaField:(shop.features,days_since_last)",
        safe_feature_urn="urn:li:schemaField:(shop.features,prior_score)",
        leakage_lineage_path=("orders_after.recorded_at", "features.days_since_last"),
        safe_lineage_path=("customers.prior_score", "features.prior_score"),
        leakage_available_offset_days=31,
        safe_available_offset_days=-1,
    )
    return Scenario(
        name="customers",
        rules=Rules(counts["train"], counts["test"]),
        identity=identity,
        decisions=decisions,
        snapshots=customer_snapshots(spark, folder).select("entity_id", "available_at", *features),
        base_width=2,
        features=tuple(features),
        prediction_time="2026-01-10T09:00:00Z",
        kind=kind,
    )


@register(
    "rebuild_wide",
    """WITH spans AS (
  SELECT o_custkey, make_timestamp((epoch_us(min(o_orderdate)) + epoch_us(max(o_orderdate))) // 2) AS cutoff
  FROM orders GROUP BY o_custkey),
joined AS (
  SELECT o_custkey, o_orderdate AS t, cutoff, o_totalprice AS price, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS status
  FROM orders JOIN spans USING (o_custkey)),
prices AS (SELECT o_custkey, t, max(price) AS price FROM joined GROUP BY o_custkey, t),
priced AS (
  SELECT o_custkey, arg_max(price, t) AS observed_price,
    arg_max(price, t) FILTER (WHERE t <= cutoff) AS pit_price
  FROM prices JOIN spans USING (o_custkey) GROUP BY o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, count(*) AS history_records,
  count(*) FILTER (WHERE t > cutoff) AS excluded_records,
  count(*) FILTER (WHERE status IS NULL) AS status_nulls,
  max(observed_price) AS observed_price, max(pit_price) AS pit_price
FROM joined JOIN priced USING (o_custkey) GROUP BY o_custkey""",
)
def rebuilt_wide(spark, folder):
    orders = table(spark, folder, "orders")
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    spans = orders.groupBy(F.col("o_custkey").cast("string").alias("entity_id")).agg(
        F.min(day).alias("lo"), F.max(day).alias("hi")
    )
    decisions = spans.select(
        "entity_id",
        F.expr("cast(timestamp_micros((lo + hi) div 2) as timestamp_ntz)").alias("prediction_time"),
    )
    snapshots = orders.select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("available_at"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("double")).alias("status"),
    )
    rebuilt = reconstruct_wide(decisions, snapshots, ["price", "status"])
    return rebuilt.select(
        "entity_id", "history_records", "excluded_records", F.col("nulls_1").alias("status_nulls"),
        F.col("observed_0").alias("observed_price"), F.col("pit_0").alias("pit_price"),
    )


@register(
    "train_scales",
    """SELECT 'acctbal' AS feature, count(*) AS n, round(avg(c_acctbal), 4) AS mean,
  round(stddev_pop(c_acctbal), 4) AS deviation FROM customer WHERE c_custkey % 10 < 7
UNION ALL
SELECT 'constant', count(*), 3.0, 1.0 FROM customer WHERE c_custkey % 10 < 7""",
)
def scales(spark, folder):
    frame = table(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 10 < 7, "train").otherwise("test").alias("split_name"),
        F.col("c_acctbal").alias("acctbal"),
        F.lit(3.0).alias("constant"),
    )
    n, found = train_scales(frame, ["acctbal", "constant"])
    rows = [(name, n, round(s.mean, 4), round(s.deviation, 4)) for name, s in found.items()]
    return spark.createDataFrame(rows, "feature string, n bigint, mean double, deviation double")


_CUSTOMERS = """
spans AS (
  SELECT o_custkey, (epoch_us(min(o_orderdate)) + epoch_us(max(o_orderdate))) // 2 AS mid FROM orders GROUP BY 1),
facts AS (
  SELECT c_custkey AS k, mid, CAST((c_custkey * 104729) % 997 AS DOUBLE) / 997 AS prior,
    c_acctbal / 10000 AS debt, CAST((c_custkey * 7919 + 13) % 1009 AS DOUBLE) / 1009 AS noise
  FROM customer JOIN spans ON c_custkey = o_custkey),
customers AS (
  SELECT *, CASE WHEN prior * 1.6::DOUBLE + debt * 0.6::DOUBLE + noise >= 1.75 THEN 1 ELSE 0 END AS label FROM facts),
tested AS (
  SELECT label, 'prior' AS model, prior * 10 AS score FROM customers WHERE (k * 31) % 10 >= 7
  UNION ALL SELECT label, 'debt', debt FROM customers WHERE (k * 31) % 10 >= 7),
counted AS (
  SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM tested GROUP BY model, score),
running AS (
  SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score) - neg AS lower FROM counted)
"""


@register(
    "fit_single_features",
    f"""WITH {_CUSTOMERS}
SELECT model, round(sum(pos * (lower + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS auc,
  sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM running GROUP BY model""",
)
def fitted_singles(spark, folder):
    """A fit on one feature ranks rows as the feature does, so its AUC has an exact SQL twin."""
    frame = settle(customer_decisions(spark, folder))
    fits = fit_models(frame, {"prior": ["safe_feature"], "debt": ["base_0"]})
    return exact_auc(scores(frame, fits)).withColumn("auc", F.round("auc", 6))


# With a constant base column every fit ranks rows by its one feature, in the direction of the
# feature's covariance with the label, so the whole sweep has an exact SQL twin.
_EXACT = f"""WITH {_CUSTOMERS},
history AS (
  SELECT DISTINCT k, label, prior * 10 AS safe, o_orderdate AS t, epoch_us(o_orderdate) > mid AS late,
    CAST((k * 5077 + date_diff('day', TIMESTAMP '1992-01-01', o_orderdate)) % 101 AS DOUBLE) / 101 AS wobble
  FROM customers JOIN orders ON o_custkey = k),
valued AS (
  SELECT k, label, t, late, 18 + safe + 20 * wobble AS honest_history, safe + wobble AS strong_honest,
    CASE WHEN label = 1 THEN 150 + 12 * wobble ELSE 4 + 2 * wobble END AS planted FROM history),
wide AS (
  SELECT k, label, t, late, honest_history, strong_honest,
    CASE WHEN late THEN planted ELSE honest_history END AS days_since_last,
    CASE WHEN late AND (k * 613) % 100 < 25 THEN planted ELSE honest_history END AS partly_leaked
  FROM valued),
long AS (
  UNPIVOT wide ON honest_history, strong_honest, days_since_last, partly_leaked INTO NAME feature VALUE v),
rebuilt AS (
  SELECT feature, k, label, arg_max(v, t) AS observed, arg_max(v, t) FILTER (WHERE NOT late) AS point_in_time
  FROM long GROUP BY feature, k, label),
sides AS (
  UNPIVOT rebuilt ON observed, point_in_time INTO NAME side VALUE x),
signs AS (
  SELECT feature, side, CASE WHEN covar_pop(label, x) < 0 THEN -1 ELSE 1 END AS direction
  FROM sides WHERE (k * 31) % 10 < 7 GROUP BY feature, side),
ranked AS (
  SELECT feature, side, x * direction AS score, label FROM sides JOIN signs USING (feature, side)
  WHERE (k * 31) % 10 >= 7),
tally AS (
  SELECT feature, side, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM ranked GROUP BY ALL),
below AS (
  SELECT *, sum(neg) OVER (PARTITION BY feature, side ORDER BY score) - neg AS lower FROM tally),
aucs AS (
  SELECT feature, side, round(sum(pos * (lower + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS auc
  FROM below GROUP BY ALL),
pairs AS (
  SELECT feature, 0.5::DOUBLE AS baseline_auc, max(auc) FILTER (WHERE side = 'observed') AS observed_auc,
    max(auc) FILTER (WHERE side = 'point_in_time') AS point_in_time_auc FROM aucs GROUP BY feature),
compared AS (
  SELECT *, round(observed_auc - baseline_auc, 6) AS observed_advantage,
    round(point_in_time_auc - baseline_auc, 6) AS point_in_time_advantage FROM pairs),
shared AS (
  SELECT *, CASE WHEN observed_advantage > 0 THEN point_in_time_advantage / observed_advantage ELSE 1.0 END AS share
  FROM compared),
late_rows AS (
  SELECT count(*) AS excluded FROM customers JOIN orders ON o_custkey = k WHERE epoch_us(o_orderdate) > mid),
findings AS (
  SELECT feature, 'evaluated' AS status, baseline_auc, observed_auc, point_in_time_auc, observed_advantage,
    round(share, 6) AS advantage_retained, observed_advantage >= 0.05 AND share <= 0.5 AS collapsed,
    round(observed_advantage * (1 - round(share, 6)), 6) AS advantage_lost,
    excluded AS excluded_post_cutoff_records FROM shared, late_rows)
"""


# The base model, the control and both sides of every candidate, each on standardised columns.
_REFIT = _EXACT.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + "," + newton_sql(
    """
  SELECT 'base' AS model, label, (k * 31) % 10 < 7 AS trained, debt AS x1, (k % 7)::DOUBLE AS x2, 0.0::DOUBLE AS x3 FROM customers
  UNION ALL SELECT 'control', label, (k * 31) % 10 < 7, debt, (k % 7)::DOUBLE, prior * 10 FROM customers
  UNION ALL SELECT s.feature || ':' || s.side, s.label, (k * 31) % 10 < 7, debt, (k % 7)::DOUBLE, s.x
  FROM sides AS s JOIN customers USING (k)""",
    3,
) + """,
metrics AS (
  SELECT name, b.auc AS baseline_auc, o.auc AS observed_auc, p.auc AS point_in_time_auc,
    round(o.auc - b.auc, 6) AS observed_advantage, round(p.auc - b.auc, 6) AS point_in_time_advantage
  FROM (SELECT DISTINCT feature AS name, feature || ':observed' AS seen, feature || ':point_in_time' AS kept FROM sides
    UNION ALL SELECT 'safe_control', 'control', 'control') AS a
  JOIN auc_of AS o ON o.model = a.seen JOIN auc_of AS p ON p.model = a.kept JOIN auc_of AS b ON b.model = 'base'),
refit AS (
  SELECT *, CASE WHEN observed_advantage > 0 THEN point_in_time_advantage / observed_advantage ELSE 1.0 END AS share FROM metrics),
refit_findings AS (
  SELECT name, baseline_auc, observed_auc, point_in_time_auc, observed_advantage, point_in_time_advantage,
    round(share, 6) AS advantage_retained, observed_advantage >= 0.05 AND share <= 0.5 AS collapsed FROM refit)
"""


@register(
    "fit_and_score",
    f"""{_REFIT}
SELECT CASE model WHEN 'base' THEN 'base' ELSE 'leaked' END AS model, auc, positives, negatives
FROM auc_of WHERE model IN ('base', 'days_since_last:observed')""",
)
def fitted(spark, folder):
    """AUC of a base model and of one with the leaked column, fitted on train rows."""
    scenario = customer_scenario(spark, folder, CANDIDATES[:1])
    rebuilt = rebuild(scenario, CANDIDATES[:1])
    base = ["base_0", "base_1"]
    fits = fit_models(rebuilt.frame, {"base": base, "leaked": [*base, "observed_0"]})
    return exact_auc(scores(rebuilt.frame, fits)).withColumn("auc", F.round("auc", 6))


@register(
    "validate_feature",
    f"""{_REFIT}
SELECT CASE name WHEN 'safe_control' THEN name ELSE 'leakage_case' END AS side, * EXCLUDE (name)
FROM refit_findings WHERE name IN ('safe_control', 'days_since_last')""",
)
def validated(spark, folder) -> DataFrame:
    report = validate(customer_scenario(spark, folder, CANDIDATES[:1]))
    rows = [(side, *report[side].values()) for side in ("leakage_case", "safe_control")]
    names = report["leakage_case"].keys()
    schema = ", ".join(
        ["side string", *[f"{n} {'boolean' if n == 'collapsed' else 'double'}" for n in names]]
    )
    return spark.createDataFrame(rows, schema)


@register(
    "sweep_features",
    f"""{_REFIT}
SELECT (CASE name WHEN 'days_since_last' THEN 0 WHEN 'partly_leaked' THEN 1 WHEN 'honest_history' THEN 2 ELSE 3 END)::INTEGER AS position,
  name AS feature, 'evaluated' AS status, NULL AS reason, * EXCLUDE (name, excluded),
  round(observed_advantage * (1 - advantage_retained), 6) + 0 AS advantage_lost, excluded AS excluded_post_cutoff_records
FROM refit_findings, late_rows WHERE name <> 'safe_control'
UNION ALL
SELECT 4, 'gappy', 'could_not_evaluate', '{BROKEN_RECORDS}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
)
def swept(spark, folder) -> DataFrame:
    return sweep(customer_scenario(spark, folder))


def exact_scenario(spark, folder, features=CANDIDATES) -> Scenario:
    scenario = customer_scenario(spark, folder, features)
    flat = scenario.decisions.withColumn("base_0", F.lit(1.0)).drop("base_1")
    return replace(scenario, decisions=flat, base_width=1)


@register(
    "sweep_features_exact",
    f"""{_EXACT}
SELECT * FROM findings UNION ALL
SELECT 'gappy', 'could_not_evaluate', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
)
def swept_exactly(spark, folder) -> DataFrame:
    return sweep(exact_scenario(spark, folder)).drop("position", "reason", "point_in_time_advantage")


@register(
    "validate_feature_exact",
    f"""{_EXACT}
SELECT baseline_auc, observed_auc, point_in_time_auc, observed_advantage, advantage_retained, collapsed,
  excluded_post_cutoff_records, CASE WHEN collapsed THEN 'confirmed' ELSE 'high_confidence' END AS verdict
FROM findings WHERE feature = 'days_since_last'""",
)
def validated_exactly(spark, folder) -> DataFrame:
    report = validate(exact_scenario(spark, folder, CANDIDATES[:1]))
    leak = report["leakage_case"]
    names = ("baseline_auc", "observed_auc", "point_in_time_auc", "observed_advantage", "advantage_retained", "collapsed")
    row = [leak[n] for n in names]
    row += [report["reconstruction"]["excluded_post_cutoff_records"], report["verdict"]]
    schema = ", ".join(f"{n} {'boolean' if n == 'collapsed' else 'double'}" for n in names)
    return spark.createDataFrame(
        [row], schema + ", excluded_post_cutoff_records bigint, verdict string"
    )


@register(
    "audit_bundle",
    f"""{_EXACT}
SELECT 'customers-late-orders' AS case_id, 'confirmed' AS verdict, 'block' AS release_decision,
  CASE WHEN collapsed THEN 'point_in_time_collapse' ELSE 'deterministic_sql_time_proof' END
    AS confirmation_route, 3 AS exit_code FROM findings WHERE feature = 'partly_leaked'""",
)
def audited(spark, folder) -> DataFrame:
    scenario = exact_scenario(spark, folder, ("partly_leaked",))
    bundle = audit(spark, scenario, LEAKY_SQL, GUARDED_SQL, "orders_after")
    row = [bundle[n] for n in ("case_id", "verdict", "release_decision", "confirmation_route", "exit_code")]
    schema = (
        "case_id string, verdict string, release_decision string, confirmation_route string, exit_code int"
    )
    return spark.createDataFrame([row], schema)


def _judged(scenario: Scenario, base: list[str], **options) -> DataFrame:
    spark = scenario.decisions.sparkSession
    rebuilt = rebuild(scenario, CANDIDATES[:1])
    clocks = reconstruct_wide(scenario.decisions, scenario.snapshots, CANDIDATES[:1]).select(
        "entity_id", "latest_at", "latest_known_at"
    )
    queries = verify_queries(
        spark.createDataFrame([(False, LEAKY_SQL), (True, GUARDED_SQL)], "guarded boolean, sql string"),
        "orders_after",
    ).withColumnRenamed("status", "guard_status")
    return benchmark(
        rebuilt.frame.join(clocks, "entity_id"),
        base,
        clean="pit_0",
        leaked="observed_0",
        latest_at="latest_at",
        latest_known_at="latest_known_at",
        rules=scenario.rules,
        queries=queries,
        **options,
    )


def benchmark_cases(spark, folder, seeds=SEEDS) -> DataFrame:
    """Judged benchmark cases over customers."""
    scenario = customer_scenario(spark, folder, CANDIDATES[:1])
    return _judged(scenario, ["base_0", "base_1"], seeds=seeds)


_GRID = " UNION ALL ".join(
    f"SELECT {seed} AS seed, {coverage}::DOUBLE AS coverage" for seed in SEEDS for coverage in COVERAGES
)


@register(
    "detector_benchmark_exact",
    f"""{_EXACT}, grid AS ({_GRID}),
hit AS (
  SELECT seed, coverage, k, label, CASE WHEN ((k * 7919 + seed) % 1000)::DOUBLE / 1000 < coverage
    THEN observed ELSE point_in_time END AS x FROM rebuilt, grid WHERE feature = 'days_since_last'),
turns AS (
  SELECT seed, coverage, CASE WHEN covar_pop(label, x) < 0 THEN -1 ELSE 1 END AS direction
  FROM hit WHERE (k * 31) % 10 < 7 GROUP BY ALL),
placed AS (
  SELECT seed, coverage, x * direction AS score, count(*) FILTER (WHERE label = 1) AS pos,
    count(*) FILTER (WHERE label = 0) AS neg
  FROM hit JOIN turns USING (seed, coverage) WHERE (k * 31) % 10 >= 7 GROUP BY ALL),
under AS (
  SELECT *, sum(neg) OVER (PARTITION BY seed, coverage ORDER BY score) - neg AS lower FROM placed),
reached AS (
  SELECT seed, coverage, round(sum(pos * (lower + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS leaked_auc
  FROM under GROUP BY ALL),
judged AS (
  SELECT seed, coverage, guarded, CASE WHEN guarded THEN f.point_in_time_auc ELSE leaked_auc END AS observed_auc,
    f.point_in_time_auc, round(leaked_auc - 0.5, 6) AS seen, round(f.point_in_time_auc - 0.5, 6) AS kept
  FROM reached, (SELECT unnest([true, false]) AS guarded), findings f WHERE f.feature = 'days_since_last')
SELECT seed::BIGINT AS seed, coverage, guarded, observed_auc, point_in_time_auc,
  CASE WHEN guarded THEN 'clear_for_release' ELSE 'confirmed' END AS verdict,
  CASE WHEN guarded THEN 'none' WHEN seen >= 0.05 AND kept / seen <= 0.5 THEN 'point_in_time_collapse'
    ELSE 'deterministic_sql_time_proof' END AS confirmation_route, true AS correct
FROM judged""",
)
def benchmarked_exactly(spark, folder) -> DataFrame:
    """The whole grid with a constant base column and an arithmetic draw, as SQL can repeat it."""
    key = F.col("entity_id").cast("bigint")
    cases = _judged(
        exact_scenario(spark, folder, CANDIDATES[:1]),
        ["base_0"],
        draw=lambda seed: F.pmod(key * 7919 + seed, F.lit(1000)) / 1000,
    )
    return cases.select(
        "seed", "coverage", "guarded", "observed_auc", "point_in_time_auc", "verdict",
        "confirmation_route", "correct",
    )


@register("detector_benchmark", None)
def benchmarked(spark, folder) -> DataFrame:
    return reach_bands(route_breakdown(benchmark_cases(spark, folder))).orderBy(F.desc("reach_pct"))


@register("detector_benchmark_metrics", None)
def benchmark_metrics(spark, folder) -> DataFrame:
    return detector_metrics(benchmark_cases(spark, folder))

"""Decisions, histories and cases derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.catalog.registry import table

# -- users: one decision per user, halfway through the user's activity --------------------


def user_decisions(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, folder, "events").groupBy("user_id").agg(
        F.min(ts).alias("lo"), F.max(ts).alias("hi")
    )
    return spans.select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.expr("cast(timestamp_micros((lo + hi) div 2) as timestamp_ntz)").alias("prediction_time"),
    )


def user_records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("event_type").alias("feature"),
        F.col("ts").alias("available_at"),
        F.col("value").alias("feature_value"),
    )


USERS_SQL = """
decisions AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_id,
         make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS prediction_time
  FROM events GROUP BY user_id),
records AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature, ts AS available_at,
         value AS feature_value FROM events)
"""

# -- orders: one decision per order; shipped quantities are its history -------------------


def order_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("entity_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("prediction_time"),
    )


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_shipdate")
        .agg(F.sum("l_quantity").alias("feature_value"))
        .select(
            F.col("l_orderkey").cast("string").alias("entity_id"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("available_at"),
            "feature_value",
        )
    )


ORDERS_SQL = """
decisions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, o_orderdate AS prediction_time FROM orders),
records AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, l_shipdate AS available_at,
         sum(l_quantity) AS feature_value
  FROM lineitem GROUP BY l_orderkey, l_shipdate)
"""

# -- customers: a scored decision per customer, order history carrying a planted leak -----


def customer_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Label, split and base columns per customer with orders; cutoff halfway through them."""
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    spans = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    )
    key = F.col("c_custkey")
    prior = F.pmod(key * 104729, F.lit(997)) / 997
    debt = F.col("c_acctbal") / 10_000
    noise = F.pmod(key * 7919 + 13, F.lit(1009)) / 1009
    decided = F.expr("cast(timestamp_micros((lo + hi) div 2) as timestamp_ntz)")
    return (
        table(spark, folder, "customer")
        .join(spans, "c_custkey")
        .select(
            key.cast("string").alias("entity_id"),
            decided.alias("prediction_time"),
            (prior * 1.6 + debt * 0.6 + noise >= 1.75).cast("int").alias("label"),
            F.when(F.pmod(key * 31, F.lit(10)) < 7, "train").otherwise("test").alias("split_name"),
            debt.alias("base_0"),
            F.pmod(key, F.lit(7)).cast("double").alias("base_1"),
            (prior * 10).alias("safe_feature"),
        )
    )


def customer_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Wide history per order: two leaks that appear after the cutoff, and honest columns."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("available_at"),
        "o_orderkey",
        "o_totalprice",
    )
    decided = customer_decisions(spark, folder).select(
        "entity_id", "prediction_time", "label", "safe_feature"
    )
    joined = orders.join(decided, "entity_id")
    late = F.col("available_at") > F.col("prediction_time")
    key = F.col("entity_id").cast("bigint")
    # One value per (entity, time): nothing here may depend on the order itself.
    wobble = F.pmod(key * 5077 + F.datediff("available_at", F.lit("1992-01-01")), F.lit(101)) / 101
    honest = 18 + F.col("safe_feature") + 20 * wobble
    planted = F.when(F.col("label") == 1, 150 + 12 * wobble).otherwise(4 + 2 * wobble)
    half = F.pmod(key * 613, F.lit(100)) < 25
    return joined.select(
        "entity_id",
        "available_at",
        F.when(late, planted).otherwise(honest).alias("days_since_last"),
        F.when(late & half, planted).otherwise(honest).alias("partly_leaked"),
        honest.alias("honest_history"),
        (F.col("safe_feature") + wobble).alias("strong_honest"),
        F.when(F.pmod(key, F.lit(50)) != 0, wobble).alias("gappy"),
    )


# -- runs, cases and findings: one per order ----------------------------------------------


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run history as large as the orders table."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.concat(
            F.date_format("o_orderdate", "yyyyMMdd"),
            F.lit("-"),
            F.lpad(key.cast("string"), 12, "0"),
        ).alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"),
        F.lit("nightly").alias("audit"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("scenario"),
        F.col("o_orderkey").cast("string").alias("case_id"),
        F.when(F.col("o_orderstatus") == "F", "confirmed")
        .when(F.col("o_orderstatus") == "O", "clear_for_release")
        .alias("verdict"),
        F.when(F.col("o_orderstatus") == "F", "block")
        .when(F.col("o_orderstatus") == "O", "allow")
        .alias("release_decision"),
        F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 0).otherwise(2)
        .alias("exit_code"),
        F.when(key % 13 != 0, F.floor(F.col("o_totalprice")) / 1000).alias("runtime_seconds"),
        F.col("o_custkey").alias("rows"),
        F.concat(F.lit("urn:li:dataset:"), (F.col("o_custkey") % 100).cast("string")).alias("target_urn"),
        (key % 3 == 0).alias("published"),
        F.sha2(key.cast("string"), 256).alias("evidence_sha256"),
    )


RUNS_SQL = """
runs AS (
  SELECT strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id,
         strftime(o_orderdate, '%Y-%m-%d') AS started_at,
         'nightly' AS audit,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS scenario,
         CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'clear_for_release' END AS verdict,
         CASE o_orderstatus WHEN 'F' THEN 'block' WHEN 'O' THEN 'allow' END AS release_decision,
         CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice) / 1000 END AS runtime_seconds
  FROM orders),
grouped AS (SELECT * REPLACE (coalesce(scenario, audit) AS scenario) FROM runs)
"""


def judged_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Detector cases: seven coverages, half of them leaked, judged by order status."""
    key = F.col("o_orderkey")
    reach = F.element_at(
        F.array(*[F.lit(c) for c in (1.0, 0.7, 0.4, 0.25, 0.15, 0.08, 0.02)]),
        (F.pmod(key, F.lit(7)) + 1).cast("int"),
    )
    return table(spark, folder, "orders").select(
        reach.alias("coverage"),
        (F.pmod(key, F.lit(2)) == 0).alias("is_leaked"),
        (F.col("o_orderstatus") != "O").alias("flagged"),
        ((F.col("o_orderstatus") == "F") & (F.pmod(key, F.lit(7)) < 4)).alias("collapsed"),
        (0.5 + F.pmod("o_custkey", F.lit(500)) / 1000).alias("observed_auc"),
        F.lit(0.5).alias("point_in_time_auc"),
    )


CASES_SQL = """
cases AS (
  SELECT CAST(CASE o_orderkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.25
           WHEN 4 THEN 0.15 WHEN 5 THEN 0.08 ELSE 0.02 END AS DOUBLE) AS coverage,
         o_orderkey % 2 = 0 AS is_leaked, o_orderstatus <> 'O' AS flagged,
         o_orderstatus = 'F' AND o_orderkey % 7 < 4 AS collapsed,
         0.5 + CAST(o_custkey % 500 AS DOUBLE) / 1000 AS observed_auc,
         CAST(0.5 AS DOUBLE) AS point_in_time_auc
  FROM orders)
"""

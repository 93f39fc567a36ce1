"""Canonicalisation and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import register, table
from cutline.operators.contract import (
    RECORD_COLUMNS,
    Binding,
    canonical_decisions,
    canonical_records,
    decision_columns,
    decision_profile,
    decision_violations,
    rejected_rows,
    wide_to_long,
)
from cutline.session import fresh_path
from cutline.sources.relations import Relation, read_relation

_BINDING = Binding(
    entity_id="order key",
    prediction_time="decided at",
    label="did default",
    split="eval split",
    base_features=("total amount", "customer"),
    safe_feature="prior misses",
    history_entity_id="record",
    history_time="recorded",
    history_value="value",
)


def raw_decisions(spark, folder):
    """Orders as a user would hand them over: text, with blanks, odd labels and bad numbers."""
    key = F.col("o_orderkey")
    label = (
        F.when(key % 6 == 0, "1").when(key % 6 == 1, "0").when(key % 6 == 2, "1.0")
        .when(key % 6 == 3, "0.0").when(key % 6 == 4, "unknown").otherwise("0.5")
    )
    return table(spark, folder, "orders").select(
        key.cast("string").alias("order key"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("decided at"),
        label.alias("did default"),
        F.when(key % 10 < 7, "  TRAIN ").when(key % 10 < 9, "Test").otherwise("holdout")
        .alias("eval split"),
        F.when(key % 97 != 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
        .alias("total amount"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.concat((key % 4).cast("string"), F.lit(".5")).alias("prior misses"),
    )


CANONICAL_SQL = """
canonical AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, o_orderdate AS prediction_time,
    CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS label,
    CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'test' ELSE 'holdout' END
      AS split_name,
    CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS base_0,
    CAST(o_custkey AS DOUBLE) AS base_1, o_orderkey % 4 + CAST(0.5 AS DOUBLE) AS safe_feature
  FROM orders)
"""


@register("canonical_decisions", f"WITH {CANONICAL_SQL} SELECT * FROM canonical")
def decisions(spark, folder):
    return canonical_decisions(raw_decisions(spark, folder), _BINDING)


@register("canonical_decisions_from_csv", f"WITH {CANONICAL_SQL} SELECT * FROM canonical")
def decisions_from_csv(spark, folder):
    path = fresh_path(spark, "decisions-csv")
    raw_decisions(spark, folder).write.option("header", True).csv(path)
    return canonical_decisions(read_relation(spark, Relation(path, "csv")), _BINDING)


def raw_records(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record"),
        F.when(F.col("l_orderkey") % 89 != 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("soon").alias("recorded"),
        F.when(F.col("l_orderkey") % 101 != 0, F.col("l_quantity").cast("string"))
        .otherwise("many").alias("value"),
    )


_RECORDS_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS entity_id,
  CASE WHEN l_orderkey % 89 <> 0 THEN l_shipdate END AS available_at,
  CASE WHEN l_orderkey % 101 <> 0 THEN l_quantity END AS feature_value
FROM lineitem"""


@register("canonical_records", _RECORDS_SQL)
def records(spark, folder):
    return canonical_records(raw_records(spark, folder), "record", "recorded", "value")


@register(
    "rejected_records",
    f"""WITH records AS ({_RECORDS_SQL})
SELECT entity_id, available_at, feature_value,
  concat_ws(',', CASE WHEN available_at IS NULL THEN 'available_at' END,
            CASE WHEN feature_value IS NULL THEN 'feature_value' END) AS faults
FROM records WHERE available_at IS NULL OR feature_value IS NULL""",
)
def rejects(spark, folder):
    found = rejected_rows(records(spark, folder), RECORD_COLUMNS)
    return found.withColumn("faults", F.array_join("faults", ","))


@register(
    "wide_to_long",
    "\nUNION ALL\n".join(
        f"""SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, l_shipdate AS available_at,
  '{c}' AS feature, {c} AS feature_value FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def unpivoted(spark, folder):
    wide = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("available_at"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return wide_to_long(wide, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


_PROFILE = """
SELECT count(*) AS rows, count(DISTINCT entity_id) AS unique_ids,
  count(*) FILTER (WHERE entity_id IS NULL OR prediction_time IS NULL OR label IS NULL
    OR safe_feature IS NULL OR base_0 IS NULL OR base_1 IS NULL) AS invalid_rows,
  count(DISTINCT label) AS labels,
  count(*) FILTER (WHERE split_name = 'train') AS train_rows,
  count(*) FILTER (WHERE split_name = 'test') AS test_rows
FROM canonical"""


@register("contract_profile", f"WITH {CANONICAL_SQL} {_PROFILE}")
def profile(spark, folder):
    return decision_profile(decisions(spark, folder), 2)


@register(
    "contract_violations",
    f"""WITH {CANONICAL_SQL}, profile AS ({_PROFILE})
SELECT concat_ws('; ',
  CASE WHEN rows <> train_rows + test_rows THEN 'decisions do not have the declared number of rows' END,
  CASE WHEN unique_ids <> rows THEN 'decision keys must be unique' END,
  CASE WHEN invalid_rows > 0 THEN 'decisions contain null or unparseable required values' END,
  CASE WHEN labels <> 2 THEN 'the label must contain exactly two classes' END) AS violations
FROM profile""",
)
def violations(spark, folder):
    found = decision_violations(F.col("train_rows"), F.col("test_rows"))
    return profile(spark, folder).select(F.array_join(found, "; ").alias("violations"))


@register(
    "rejected_decisions",
    f"""WITH {CANONICAL_SQL}
SELECT entity_id, concat_ws(',', CASE WHEN label IS NULL THEN 'label' END,
  CASE WHEN base_0 IS NULL THEN 'base_0' END) AS faults
FROM canonical WHERE label IS NULL OR base_0 IS NULL""",
)
def rejected_decisions(spark, folder):
    found = rejected_rows(decisions(spark, folder), decision_columns(2))
    return found.select("entity_id", F.array_join("faults", ",").alias("faults"))

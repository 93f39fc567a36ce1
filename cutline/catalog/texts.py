"""Names, URNs and content hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import register, table
from cutline.functions import names
from cutline.functions.digest import canonical_hash, content_hash, event_key


@register(
    "urn_parts",
    """SELECT c_custkey,
  'model_' || c_custkey AS model_name,
  'field_' || c_nationkey AS field_name,
  'table_' || (c_custkey % 50) AS field_table,
  'mlModel' AS entity_type,
  CASE WHEN c_custkey % 2 = 0
    THEN 'urn:li:mlModel:(urn:li:dataPlatform:mlflow,shop.model_' || c_custkey || ',PROD)'
    ELSE 'urn:li:mlModel:(urn:li:dataPlatform:mlflow,store.model_' || c_custkey || ',PROD)' END AS canonical,
  'plain_' || c_custkey AS plain_name
FROM customer""",
)
def urn_parts(spark, folder):
    key = F.col("c_custkey").cast("string")
    short = F.concat(F.lit("urn:li:mlModel:shop.model_"), key)
    full = F.concat(
        F.lit("urn:li:mlModel:(urn:li:dataPlatform:mlflow,store.model_"), key, F.lit(",PROD)")
    )
    urn = F.when(F.col("c_custkey") % 2 == 0, short).otherwise(full)
    field = F.concat(
        F.lit("urn:li:schemaField:(shop.table_"), (F.col("c_custkey") % 50).cast("string"),
        F.lit(",field_"), F.col("c_nationkey").cast("string"), F.lit(")"),
    )
    canonical = names.canonical_model_urn(urn, "shop")
    return table(spark, folder, "customer").select(
        "c_custkey",
        names.display_name(canonical).alias("model_name"),
        names.display_name(field).alias("field_name"),
        names.field_table(field).alias("field_table"),
        names.entity_type(urn).alias("entity_type"),
        canonical.alias("canonical"),
        names.display_name(F.concat(F.lit("urn:li:tag:a.plain_"), key)).alias("plain_name"),
    )


@register(
    "node_parts",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN l_linenumber % 3 = 0 THEN 'orders' ELSE 'shop.orders_' || l_suppkey END AS node_table,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'col_' || l_linenumber END AS node_column,
  CASE WHEN l_linenumber % 3 = 0 THEN 'orders' ELSE 'col_' || l_linenumber END AS last_component
FROM lineitem""",
)
def node_parts(spark, folder):
    node = F.when(F.col("l_linenumber") % 3 == 0, F.lit("orders")).otherwise(
        F.concat_ws(
            "", F.lit("shop.orders_"), F.col("l_suppkey"), F.lit(".col_"), F.col("l_linenumber")
        )
    )
    quoted = F.concat(F.lit('"'), F.upper(node), F.lit('"'))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        names.node_table(node).alias("node_table"),
        names.node_column(node).alias("node_column"),
        names.last_component(quoted).alias("last_component"),
    )


@register(
    "content_hash",
    "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents",
)
def hashes(spark, folder):
    body = F.col("text").cast("binary")
    return table(spark, folder, "documents").select(
        "doc_id", content_hash(body).alias("sha256"), F.octet_length(body).cast("bigint").alias("bytes")
    )


@register(
    "event_key",
    """SELECT event_id, sha256('urn:li:mlModel:' || user_id || chr(1) || props || chr(1)) AS event_key
FROM events""",
)
def keys(spark, folder):
    urn = F.concat(F.lit("urn:li:mlModel:"), F.col("user_id").cast("string"))
    return table(spark, folder, "events").select(
        "event_id", event_key(urn, F.col("props")).alias("event_key")
    )


@register(
    "canonical_hash",
    """SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey
  || ',"status":"' || o_orderstatus || '","void":null}') AS evidence_sha256 FROM orders""",
)
def bundle_hash(spark, folder):
    fields = {
        "status": F.col("o_orderstatus"),
        "order": F.col("o_orderkey"),
        "customer": F.col("o_custkey"),
        "void": F.lit(None).cast("string"),
    }
    return table(spark, folder, "orders").select(
        "o_orderkey", canonical_hash(fields).alias("evidence_sha256")
    )

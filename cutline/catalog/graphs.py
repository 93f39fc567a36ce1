"""Directed paths over a lineage graph as large as the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.catalog.registry import register, table
from cutline.operators.lineage import column_path, path_nodes, suspicious_ancestry, upstream
from cutline.sources.cases import path_from_response


def _node(prefix: str, key: str):
    return F.concat(F.lit(prefix + "."), F.col(key).cast("string"))


def edges(spark, folder) -> DataFrame:
    """orders → customer → nation → region, with a second route over the market segment."""

    def step(name: str, source, target) -> DataFrame:
        return table(spark, folder, name).select(
            source.alias("src_node"), target.alias("dst_node"), F.lit(None).cast("string").alias("via")
        )

    return (
        step("orders", _node("orders", "o_orderkey"), _node("customer", "o_custkey"))
        .unionByName(step("customer", _node("customer", "c_custkey"), _node("nation", "c_nationkey")))
        .unionByName(step("customer", _node("customer", "c_custkey"), _node("market", "c_mktsegment")))
        .unionByName(
            # A second way to the region, one node later in text order, and a cycle back.
            step("customer", _node("market", "c_mktsegment"), F.lit("planning.all"))
        )
        .unionByName(step("nation", F.lit("planning.all"), F.lit("region.0")))
        .unionByName(step("nation", _node("nation", "n_nationkey"), _node("region", "n_regionkey")))
        .unionByName(step("nation", _node("region", "n_regionkey"), _node("nation", "n_nationkey")))
    )


@register(
    "lineage_path",
    """WITH pairs AS (
  SELECT 'orders.' || o_orderkey AS source, 'region.' || (o_orderkey % 5) AS target,
    'customer.' || o_custkey AS c, 'nation.' || c_nationkey AS n, n_regionkey AS r, c_mktsegment AS m
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
direct AS (
  SELECT source, target, 3 AS hops, source || ' > ' || c || ' > ' || n || ' > ' || target AS path
  FROM pairs WHERE target = 'region.' || r),
planned AS (
  SELECT source, target, 4 AS hops,
    source || ' > ' || c || ' > market.' || m || ' > planning.all > ' || target AS path
  FROM pairs WHERE target = 'region.0' AND r <> 0)
SELECT p.source, p.target, true AS available, d.path IS NOT NULL AS found, coalesce(d.hops, 0) AS hops,
  coalesce(d.path, '') AS path
FROM pairs p LEFT JOIN (SELECT * FROM direct UNION ALL SELECT * FROM planned) d USING (source, target)""",
)
def paths(spark, folder):
    pairs = table(spark, folder, "orders").select(
        _node("orders", "o_orderkey").alias("source"),
        F.concat(F.lit("region."), (F.col("o_orderkey") % 5).cast("string")).alias("target"),
    )
    found = column_path(edges(spark, folder), pairs)
    return found.withColumn("path", F.array_join("path", " > "))


@register(
    "upstream_neighbours",
    """SELECT 'market.' || c_mktsegment AS node, 'customer.' || c_custkey AS ancestor, 1 AS hops FROM customer
UNION ALL
SELECT 'market.' || c_mktsegment, 'orders.' || o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def ancestors(spark, folder):
    markets = table(spark, folder, "customer").select(_node("market", "c_mktsegment").alias("node"))
    return upstream(edges(spark, folder), markets, max_hops=2)


@register(
    "suspicious_ancestry",
    """WITH touched AS (
  SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
outcome_orders AS (SELECT 'label.' || o_orderkey AS node, o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'feature.' || c_custkey AS node,
  c_custkey IN (SELECT o_custkey FROM touched) AND c_custkey % 4 <> 0 AS suspicious_common_ancestry
FROM customer""",
)
def ancestry(spark, folder):
    """Features and labels derived from the same customers; a quarter of the features reads a label."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    done = orders.where(F.col("o_orderstatus") == "F")
    label = _node("label", "o_orderkey")
    graph = (
        customers.select(
            _node("customer", "c_custkey").alias("src_node"), _node("feature", "c_custkey").alias("dst_node")
        )
        .unionByName(done.select(_node("customer", "o_custkey").alias("src_node"), label.alias("dst_node")))
        .unionByName(
            done.where(F.col("o_custkey") % 4 == 0).select(
                label.alias("src_node"), _node("feature", "o_custkey").alias("dst_node")
            )
        )
    )
    return suspicious_ancestry(
        graph,
        customers.select(_node("feature", "c_custkey").alias("node")),
        done.select(label.alias("node")),
    )


@register(
    "path_nodes",
    """WITH steps AS (
  SELECT o_orderkey, o_orderstatus, o_custkey, unnest([0, 1, 2]) AS position FROM orders)
SELECT o_orderkey, position, CASE position WHEN 0 THEN 'payments' WHEN 1 THEN 'features' ELSE 'm_' || o_custkey END
    AS "table",
  CASE position WHEN 0 THEN 'recorded.at' WHEN 1 THEN 'days' ELSE '' END AS "column",
  CASE position WHEN 0 THEN 'source' WHEN 1 THEN 'feature' ELSE 'model' END AS kind,
  position = 0 AND o_orderstatus = 'F' AS violates FROM steps""",
)
def nodes(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.array(F.lit("payments.recorded.at"), F.lit("features.days")).alias("path"),
        (F.col("o_orderstatus") == "F").alias("late"),
        F.concat(F.lit("m_"), F.col("o_custkey").cast("string")).alias("model"),
    )
    return path_nodes(rows, "late", "model")


@register(
    "path_normalisation",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE 'a.' || o_custkey || ' > b.' || o_orderkey END
  AS path FROM orders""",
)
def normalised(spark, folder):
    a = F.concat(F.lit("a."), F.col("o_custkey").cast("string"))
    b = F.concat(F.lit("b."), F.col("o_orderkey").cast("string"))

    def text(pattern: str):
        return F.format_string(pattern, a, b)

    kind = F.col("o_orderkey") % 4
    response = (
        F.when(kind == 0, text('{"paths": [["%s", "%s"]]}'))
        .when(kind == 1, text('{"lineage_paths": [{"hops": [{"fieldPath": "%s"}, {"urn": "%s"}]}]}'))
        .when(kind == 2, text('{"results": [{"entities": ["%s", "%s"]}]}'))
        .otherwise(text('{"other": ["%s", "%s"]}'))
    )
    path = path_from_response(response)
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(path, " > ").alias("path"))

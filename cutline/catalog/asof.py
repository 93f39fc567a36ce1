"""As-of joins, reconstruction and feature builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.inputs import (
    ORDERS_SQL,
    USERS_SQL,
    customer_decisions,
    order_decisions,
    order_records,
    user_decisions,
    user_records,
)
from cutline.catalog.registry import register, table
from cutline.functions.timing import after_cutoff, gap_days, gap_label, is_late, known_by, plus_days
from cutline.operators.asof import guarded_build, leaky_build, reconstruct, stacked_history
from cutline.operators.contract import (
    conflicting_records,
    decisions_without_known_record,
    decisions_without_records,
)
from cutline.session import fresh_path
from cutline.streaming.asof_stream import PROVIDER, asof_stream

_LATEST = "arg_max(feature_value, available_at)"
_KNOWN = "FILTER (WHERE available_at <= prediction_time)"
_LATE = "count(*) FILTER (WHERE available_at > prediction_time)"
_JOINED = "FROM decisions JOIN records USING (entity_id)"


@register(
    "reconstruct",
    f"""WITH {USERS_SQL}
SELECT entity_id, {_LATEST} AS observed_value, {_LATEST} {_KNOWN} AS point_in_time_value,
       {_LATE} AS excluded_records {_JOINED} GROUP BY entity_id""",
)
def reconstruct_users(spark, folder):
    return reconstruct(user_decisions(spark, folder), user_records(spark, folder))


@register(
    "reconstruct_orders",
    f"""WITH {ORDERS_SQL}
SELECT entity_id, {_LATEST} AS observed_value, {_LATEST} {_KNOWN} AS point_in_time_value,
       {_LATE} AS excluded_records {_JOINED} GROUP BY entity_id""",
)
def reconstruct_orders(spark, folder):
    return reconstruct(order_decisions(spark, folder), order_records(spark, folder))


@register(
    "reconstruct_features",
    f"""WITH {USERS_SQL}
SELECT entity_id, feature, {_LATEST} AS observed_value, {_LATEST} {_KNOWN} AS point_in_time_value,
       {_LATE} AS excluded_records {_JOINED} GROUP BY entity_id, feature""",
)
def reconstruct_features(spark, folder):
    return reconstruct(user_decisions(spark, folder), user_records(spark, folder), by=["feature"])


@register(
    "stacked_history",
    f"""WITH {ORDERS_SQL}
SELECT entity_id, {_LATEST} AS observed_value, {_LATEST} {_KNOWN} AS point_in_time_value,
       {_LATE} AS excluded_records {_JOINED} GROUP BY entity_id""",
)
def stacked(spark, folder):
    """Records before and after the decision, kept apart and stacked again."""
    decisions, history = order_decisions(spark, folder), order_records(spark, folder)
    dated = history.join(decisions, "entity_id")
    before = dated.where("available_at <= prediction_time").drop("prediction_time")
    after = dated.where("available_at > prediction_time").drop("prediction_time")
    return reconstruct(decisions, stacked_history(before, after))


@register(
    "observed_latest",
    f"WITH {USERS_SQL} SELECT entity_id, {_LATEST} AS observed_value {_JOINED} GROUP BY entity_id",
)
def observed_latest(spark, folder):
    return reconstruct_users(spark, folder).select("entity_id", "observed_value")


@register(
    "pit_latest",
    f"WITH {USERS_SQL} SELECT entity_id, {_LATEST} {_KNOWN} AS point_in_time_value {_JOINED} GROUP BY entity_id",
)
def pit_latest(spark, folder):
    return reconstruct_users(spark, folder).select("entity_id", "point_in_time_value")


@register(
    "asof_latest",
    f"""WITH {ORDERS_SQL}
SELECT entity_id, {_LATEST} AS point_in_time_value
FROM decisions LEFT JOIN records r USING (entity_id)
WHERE r.available_at IS NULL OR r.available_at <= prediction_time
GROUP BY entity_id
UNION ALL
SELECT entity_id, NULL FROM decisions d WHERE EXISTS (
  SELECT 1 FROM records r WHERE r.entity_id = d.entity_id) AND NOT EXISTS (
  SELECT 1 FROM records r WHERE r.entity_id = d.entity_id AND r.available_at <= d.prediction_time)""",
)
def asof_latest(spark, folder):
    rebuilt = reconstruct(
        order_decisions(spark, folder), order_records(spark, folder), keep_unmatched=True
    )
    return rebuilt.select("entity_id", "point_in_time_value")


@register(
    "asof_latest_with_ties",
    """WITH joined AS (
  SELECT o_orderkey AS entity_id, l_quantity AS v, l_shipdate AS t, o_orderdate AS p
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT CAST(entity_id AS VARCHAR) AS entity_id,
       arg_max(v, {'t': t, 'v': v}) AS observed_value,
       arg_max(v, {'t': t, 'v': v}) FILTER (WHERE t <= p) AS point_in_time_value,
       count(*) FILTER (WHERE t > p) AS excluded_records
FROM joined GROUP BY entity_id""",
)
def asof_latest_with_ties(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("available_at"),
        F.col("l_quantity").alias("feature_value"),
    )
    return reconstruct(order_decisions(spark, folder), raw, ties="largest")


@register(
    "excluded_records",
    f"WITH {USERS_SQL} SELECT entity_id, {_LATE} AS excluded_records {_JOINED} GROUP BY entity_id",
)
def excluded_records(spark, folder):
    return reconstruct_users(spark, folder).select("entity_id", "excluded_records")


@register(
    "excluded_total",
    f"WITH {ORDERS_SQL} SELECT {_LATE} AS excluded_total {_JOINED}",
)
def excluded_total(spark, folder):
    return reconstruct_orders(spark, folder).agg(F.sum("excluded_records").alias("excluded_total"))


@register(
    "cutoff_filter",
    """SELECT l_orderkey, l_linenumber, l_shipdate <= o_orderdate AS known,
  l_shipdate > o_orderdate AS late
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def cutoff_filter(spark, folder):
    available, cutoff = F.col("l_shipdate"), F.col("o_orderdate")
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return table(spark, folder, "lineitem").join(orders, "l_orderkey").select(
        "l_orderkey",
        "l_linenumber",
        known_by(available, cutoff).alias("known"),
        after_cutoff(available, cutoff).alias("late"),
    )


@register(
    "decisions_without_records",
    f"WITH {ORDERS_SQL} SELECT entity_id FROM decisions WHERE entity_id NOT IN (SELECT entity_id FROM records)",
)
def no_records(spark, folder):
    return decisions_without_records(
        order_decisions(spark, folder), order_records(spark, folder)
    ).select("entity_id")


@register(
    "decisions_without_pit_record",
    f"""WITH {ORDERS_SQL} SELECT entity_id FROM decisions d WHERE NOT EXISTS (
  SELECT 1 FROM records r WHERE r.entity_id = d.entity_id AND r.available_at <= d.prediction_time)""",
)
def no_known_record(spark, folder):
    return decisions_without_known_record(
        order_decisions(spark, folder), order_records(spark, folder)
    ).select("entity_id")


@register(
    "conflicting_records",
    """SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, l_shipdate AS available_at,
       min(l_quantity) AS low, max(l_quantity) AS high
FROM lineitem GROUP BY l_orderkey, l_shipdate HAVING min(l_quantity) <> max(l_quantity)""",
)
def conflicts(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("available_at"),
        F.col("l_quantity").alias("feature_value"),
    )
    return conflicting_records(raw)


# -- feature builds -----------------------------------------------------------------------


def _order_build(spark, folder):
    decisions = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        "o_orderkey",
        F.col("o_orderdate").cast("timestamp_ntz").alias("prediction_time"),
    )
    shipped = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("available_at"),
    )
    return decisions, shipped


@register(
    "leaky_days_since_last",
    """SELECT o_orderkey, date_diff('day', max(l_shipdate), o_orderdate) AS days_since_last
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""",
)
def leaky_days(spark, folder):
    decisions, shipped = _order_build(spark, folder)
    built = leaky_build(decisions, shipped, "key", "o_orderkey", "available_at")
    return built.select("o_orderkey", "days_since_last")


@register(
    "guarded_days_since_last",
    """SELECT o_orderkey, date_diff('day', max(l_shipdate), o_orderdate) AS days_since_last
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate
GROUP BY o_orderkey, o_orderdate""",
)
def guarded_days(spark, folder):
    decisions, shipped = _order_build(spark, folder)
    built = guarded_build(decisions, shipped, "key", "o_orderkey", "available_at")
    return built.select("o_orderkey", "days_since_last")


def _user_build(spark, folder):
    events = table(spark, folder, "events")
    decisions = events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", F.col("ts").alias("prediction_time")
    )
    others = events.where(F.col("event_type") != "purchase").select(
        "user_id",
        F.col("ts").alias("available_at"),
        # Errors carry no counted value: they must not be counted.
        F.when(F.col("event_type") != "error", F.col("ts")).alias("recorded_at"),
    )
    return decisions, others


_USER_BUILD = """
SELECT d.event_id, count(CASE WHEN e.event_type <> 'error' THEN e.ts END) AS event_count
FROM events d LEFT JOIN events e
  ON e.user_id = d.user_id AND e.event_type <> 'purchase' {guard}
WHERE d.event_type = 'purchase' GROUP BY d.event_id"""


@register("leaky_event_count", _USER_BUILD.format(guard=""))
def leaky_count(spark, folder):
    decisions, others = _user_build(spark, folder)
    built = leaky_build(decisions, others, "user_id", "event_id", "recorded_at")
    return built.select("event_id", "event_count")


@register("guarded_event_count", _USER_BUILD.format(guard="AND e.ts <= d.ts"))
def guarded_count(spark, folder):
    decisions, others = _user_build(spark, folder)
    built = guarded_build(decisions, others, "user_id", "event_id", "recorded_at")
    return built.select("event_id", "event_count")


# -- clock functions ----------------------------------------------------------------------


@register(
    "derived_availability",
    """SELECT o_orderkey, make_timestamp(epoch_us(o_orderdate)
  + CAST((CAST(o_orderkey % 7 AS DOUBLE) - 3) / 4 * 86400000000 AS BIGINT)) AS source_available_at
FROM orders""",
)
def derived_availability(spark, folder):
    days = ((F.col("o_orderkey") % 7).cast("double") - 3) / 4
    return table(spark, folder, "orders").select(
        "o_orderkey", plus_days(F.col("o_orderdate"), days).alias("source_available_at")
    )


@register(
    "cutoff_gap",
    """WITH gaps AS (
  SELECT l_orderkey, l_linenumber, l_shipdate,
    CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate) - 3600000000) / 86400000000.0) AS BIGINT) AS gap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_shipdate, gap AS gap_days, gap > 0 AS late,
  abs(gap) || CASE WHEN abs(gap) = 1 THEN ' day ' ELSE ' days ' END
  || CASE WHEN gap > 0 THEN 'too late' ELSE 'earlier' END AS gap_label
FROM gaps""",
)
def cutoff_gap(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    available = F.col("l_shipdate").cast("timestamp_ntz") - F.expr("interval 1 hour")
    cutoff = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, folder, "lineitem").join(orders, "l_orderkey").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"),
        gap_days(available, cutoff).alias("gap_days"),
        is_late(available, cutoff).alias("late"),
        gap_label(available, cutoff).alias("gap_label"),
    )


@register(
    "asof_stream",
    """WITH spans AS (
  SELECT o_custkey AS k, (epoch_us(min(o_orderdate)) + epoch_us(max(o_orderdate))) // 2 AS mid FROM orders GROUP BY 1),
passed AS (SELECT epoch_us(max(o_orderdate)) - 3600000000 AS mark FROM orders)
SELECT k::VARCHAR AS entity_id, mid AS cutoff, max(o_totalprice) FILTER (WHERE o_orderdate = newest) AS point_in_time_value,
  epoch_us(any_value(newest)) AS known_at
FROM (SELECT k, mid, o_orderdate, o_totalprice, max(o_orderdate) OVER (PARTITION BY k) AS newest
  FROM spans JOIN orders ON o_custkey = k, passed WHERE epoch_us(o_orderdate) <= mid AND mid + 1000 < mark)
GROUP BY k, mid""",
)
def streamed(spark, folder):
    """Customers' decisions and orders as two streams; decisions that the watermark passes are answered."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "asof-stream")
    decided = customer_decisions(spark, folder).select("entity_id", F.col("entity_id").alias("decision_id"), "prediction_time")
    decided.write.parquet(f"{path}/decisions")
    orders = table(spark, folder, "orders")
    # A pattern, since a stream of one plain path must be a folder.
    told = session.readStream.schema(orders.schema).parquet(f"{folder}/orders.[p]arquet").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("available_at"), F.col("o_totalprice").alias("feature_value")
    )
    asked = session.readStream.schema(decided.schema).parquet(f"{path}/decisions")
    answers = asof_stream(asked, told, delay="1 hour", keep_days=36500)
    query = (
        answers.writeStream.format("parquet").option("path", f"{path}/answers").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{path}/answers").select(
        "entity_id", F.unix_micros("prediction_time").alias("cutoff"), "point_in_time_value", F.unix_micros("known_at").alias("known_at")
    )

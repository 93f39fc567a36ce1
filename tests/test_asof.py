"""Null, tie and boundary semantics of the reconstruction, and its behaviour under skew."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cutline.operators.asof import guarded_build, leaky_build, reconstruct, reconstruct_wide
from cutline.operators.ordered import newest, running_totals, upper_median
from cutline.operators.spread import SpreadPolicy, hot_keys

T0 = datetime(2026, 1, 10, 9)
DECISIONS = "entity_id string, prediction_time timestamp_ntz"
RECORDS = "entity_id string, available_at timestamp_ntz, feature_value double"
ALWAYS = SpreadPolicy(sample_fraction=1.0, hot_rows=20, rows_per_slice=7, enabled=True)


def at(days: float) -> datetime:
    return T0 + timedelta(days=days)


def test_cutoff_is_inclusive_and_null_values_are_skipped(spark):
    decisions = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0)], DECISIONS)
    records = spark.createDataFrame(
        [
            ("a", T0, 1.0),
            ("a", at(1), None),
            ("b", at(-1), 5.0),
            ("b", at(0.5), 6.0),
            ("b", at(2), 7.0),
            ("x", at(1), 9.0),
        ],
        RECORDS,
    )
    assert rows(reconstruct(decisions, records)) == [("a", 1.0, 1.0, 1), ("b", 7.0, 5.0, 2)]
    kept = reconstruct(decisions, records, keep_unmatched=True)
    assert ("c", None, None, 0) in rows(kept)


def test_equal_times_take_the_largest_value_on_request(spark):
    decisions = spark.createDataFrame([("a", T0)], DECISIONS)
    records = spark.createDataFrame([("a", at(-1), v) for v in (2.0, 9.0, 4.0)], RECORDS)
    assert rows(reconstruct(decisions, records, ties="largest")) == [("a", 9.0, 9.0, 0)]


def skewed(spark, seed=5):
    """A third of all records belongs to one entity."""
    rng = random.Random(seed)
    entities = [f"e{i}" for i in range(40)]
    data = []
    for i in range(900):
        entity = "hot" if i % 3 == 0 else rng.choice(entities)
        data.append((entity, at(i / 7 - 60), float(i)))
    data += [(None, at(1), 1.0), ("hot", None, 3.0)]
    decisions = [(e, at(rng.uniform(-40, 40))) for e in [*entities, "hot", "empty"]]
    return (
        spark.createDataFrame(decisions, DECISIONS),
        spark.createDataFrame(data, RECORDS).repartition(6),
    )


def test_slicing_hot_entities_changes_nothing(spark):
    decisions, records = skewed(spark)
    plain = reconstruct(decisions, records, spread=SpreadPolicy(enabled=False))
    sliced = reconstruct(decisions, records, spread=ALWAYS)
    assert rows(plain) == rows(sliced)
    kept = reconstruct(decisions, records, keep_unmatched=True, spread=ALWAYS)
    assert kept.where("entity_id = 'empty'").count() == 1


def test_the_list_of_hot_keys_stays_small(spark):
    decisions, records = skewed(spark)
    policy = SpreadPolicy(sample_fraction=1.0, hot_rows=5, rows_per_slice=3, most_bytes=4, enabled=True)
    keys = hot_keys(records, ["entity_id"], policy)
    assert [r["entity_id"] for r in keys.collect()] == ["hot"]
    assert rows(reconstruct(decisions, records, spread=policy)) == rows(reconstruct(decisions, records))


def test_partitioning_and_order_change_nothing(spark):
    decisions, records = skewed(spark)
    expected = rows(reconstruct(decisions, records))
    for parts in (1, 3, 11):
        shuffled = records.repartition(parts).orderBy(F.rand(parts))
        assert rows(reconstruct(decisions.repartition(parts), shuffled)) == expected


def test_wide_equals_long(spark):
    decisions, records = skewed(spark)
    wide = records.withColumn("twice", F.col("feature_value") * 2).withColumnRenamed(
        "feature_value", "once"
    )
    expected = rows(reconstruct(decisions, records))
    for policy in (SpreadPolicy(enabled=False), ALWAYS):
        rebuilt = reconstruct_wide(decisions, wide, ["once", "twice"], policy).where(
            F.col("is_decision") & (F.col("history_records") > 0)
        )
        assert rows(rebuilt.select("entity_id", "observed_0", "pit_0", "excluded_records")) == expected
        assert rebuilt.where(F.col("observed_1") != F.col("observed_0") * 2).isEmpty()


def test_wide_counts_what_the_contract_needs(spark):
    decisions = spark.createDataFrame([("a", T0), ("b", T0)], DECISIONS)
    schema = "entity_id string, available_at timestamp_ntz, f double, g double"
    snapshots = spark.createDataFrame(
        [
            ("a", at(-1), 1.0, 5.0),
            ("a", at(-1), 1.0, 6.0),
            ("a", at(3), None, 7.0),
            ("z", at(1), 1.0, None),
            (None, at(1), 1.0, 1.0),
            ("a", None, 1.0, 1.0),
        ],
        schema,
    )
    for policy in (SpreadPolicy(enabled=False), SpreadPolicy(1.0, 1, 1, enabled=True)):
        rebuilt = reconstruct_wide(decisions, snapshots, ["f", "g"], policy)
        total = rebuilt.agg(
            *[F.sum(c) for c in ("nulls_0", "nulls_1", "conflicts_0", "conflicts_1", "history_records")]
        ).first()
        assert tuple(total) == (1, 1, 0, 1, 6)
        assert rebuilt.agg(F.sum("broken_keys")).first()[0] == 2
        assert rebuilt.where("entity_id = 'b'").first()["history_records"] == 0


def brute_force(decisions, events, guarded):
    answer = []
    for key, account, cutoff in decisions:
        seen = [
            recorded
            for owner, available, recorded in events
            if owner == account and account is not None
            and (not guarded or (available is not None and cutoff is not None and available <= cutoff))
        ]
        recorded = [r for r in seen if r is not None]
        days = (cutoff.date() - max(recorded).date()).days if recorded and cutoff else None
        answer.append((key, len(recorded), days))
    return sorted(answer, key=str)


@pytest.mark.parametrize("small", [True, False])
def test_builds_match_brute_force_with_many_decisions_per_hot_key(spark, small):
    rng = random.Random(11)
    accounts = ["hot"] * 12 + [f"a{i}" for i in range(20)] + [None]
    decisions = [(f"d{i}", rng.choice(accounts), at(rng.randint(-6, 6))) for i in range(150)]
    events = [
        (
            rng.choice(accounts),
            rng.choice([None, at(rng.randint(-6, 6))]) if i % 10 == 0 else at(rng.randint(-6, 6)),
            rng.choice([None, at(rng.randint(-9, 9) + 0.4)]),
        )
        for i in range(400)
    ]
    left = spark.createDataFrame(decisions, "id string, account string, prediction_time timestamp_ntz")
    right = spark.createDataFrame(
        events, "account string, available_at timestamp_ntz, recorded_at timestamp_ntz"
    ).repartition(5)
    leaky = leaky_build(left, right, "account", "id", "recorded_at")
    assert rows(leaky) == brute_force(decisions, events, guarded=False)
    guarded = guarded_build(left, right, "account", "id", "recorded_at", small=small)
    assert rows(guarded) == brute_force(decisions, events, guarded=True)


def test_guarded_observed_equals_point_in_time(spark):
    decisions, records = skewed(spark)
    known = records.join(decisions, "entity_id").where("available_at <= prediction_time")
    guarded = reconstruct(decisions, known.drop("prediction_time"))
    unguarded = reconstruct(decisions, records).where("point_in_time_value is not null")
    assert rows(guarded.select("entity_id", "observed_value")) == rows(
        unguarded.select("entity_id", "point_in_time_value")
    )


def test_running_totals_agree_on_both_paths(spark):
    rng = random.Random(3)
    data = [("hot" if i % 2 else f"g{i % 5}", i // 3, rng.randint(0, 9), rng.randint(0, 99)) for i in range(600)]
    frame = spark.createDataFrame(data, "g string, o int, n bigint, m int").repartition(7)
    args = dict(by=["g"], order=["o"], sums={"s": "n"}, maxima={"x": "m"}, totals={"t": "n"})
    assert rows(running_totals(frame, **args, small=True)) == rows(
        running_totals(frame, **args, small=False)
    )


@pytest.mark.parametrize("small", [True, False])
def test_upper_median_ignores_null_and_zero(spark, small):
    data = [("a", v) for v in (4.0, 1.0, 3.0, 2.0, 0.0, None)] + [("b", v) for v in (5.0, 5.0, 7.0)]
    data += [("c", None), ("d", 0.0)]
    frame = spark.createDataFrame(data, "g string, v double")
    assert rows(upper_median(frame, ["g"], "v", small=small)) == [("a", 3.0), ("b", 5.0)]


def test_newest_is_cut_before_the_shuffle(spark):
    frame = spark.range(1000).withColumn("g", F.when(F.col("id") < 990, "hot").otherwise("cold"))
    top = newest(frame, ["g"], [F.desc("id")], 12)
    assert sorted(r["id"] for r in top.collect()) == list(range(978, 1000))
    plan = top._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan

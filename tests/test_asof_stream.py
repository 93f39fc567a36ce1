"""The streaming as-of join on file streams: late records, any order of arrival, state dropped by timers."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from cutline.streaming.asof_stream import PROVIDER, asof_stream

START = datetime(2026, 1, 1)
DECISIONS = "entity_id string, decision_id string, prediction_time timestamp"
RECORDS = "entity_id string, available_at timestamp, feature_value double"


def at(hours):
    return (START + timedelta(hours=hours)).isoformat()


class Feed:
    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.n = spark, folder, 0
        for name in ("decisions", "records"):
            (folder / name).mkdir()
        read = spark.readStream.schema
        self.answers = asof_stream(
            read(DECISIONS).json(str(folder / "decisions")), read(RECORDS).json(str(folder / "records")), delay="2 hours", **options
        )
        self.last = None

    def send(self, decisions=(), records=()):
        """One file of each, then all that can be processed: a batch of data and one that moves the timers."""
        self.n += 1
        rows = [("decisions", dict(zip(("entity_id", "decision_id", "prediction_time"), (e, d, at(h))))) for e, d, h in decisions]
        rows += [("records", dict(zip(("entity_id", "available_at", "feature_value"), (e, at(h), v)))) for e, h, v in records]
        for name in ("decisions", "records"):
            lines = [json.dumps(r) for n, r in rows if n == name]
            if lines:
                (self.folder / name / f"{self.n}.json").write_text("\n".join(lines))
        query = (
            self.answers.writeStream.format("parquet").option("path", str(self.folder / "out"))
            .option("checkpointLocation", str(self.folder / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
        assert query.exception() is None
        self.last = query.recentProgress
        found = self.spark.read.schema(self.answers.schema).parquet(str(self.folder / "out")).collect()
        return {r["decision_id"]: r["point_in_time_value"] for r in found}

    def operator(self, name):
        return sum(op[name] for p in self.last for op in json.loads(p.json)["stateOperators"])

    def state_rows(self):
        return json.loads(self.last[-1].json)["stateOperators"][0]["numRowsTotal"]


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, PROVIDER)
    yield spark
    spark.conf.unset(key)


def test_late_records_change_nothing_before_the_cutoff(stateful, tmp_path):
    feed = Feed(stateful, tmp_path)
    # The decision comes first, a record before its time after it, one beyond its time as well.
    feed.send([("a", "d1", 10), ("b", "d2", 10)], [("a", 4, 1.0)])
    assert feed.send(records=[("a", 9, 2.0), ("a", 11, 9.0)]) == {}
    assert feed.send(records=[("clock", 20, 0.0)]) == {"d1": 2.0, "d2": None}
    # Too late for d1, and dropped; d3 sees the newest record in time.
    assert feed.send([("a", "d3", 21)], [("a", 9.5, 50.0)]) == {"d1": 2.0, "d2": None}
    assert feed.operator("numRowsDroppedByWatermark") >= 1
    assert feed.send(records=[("clock", 40, 0.0)]) == {"d1": 2.0, "d2": None, "d3": 9.0}


def test_state_is_dropped_by_timer(stateful, tmp_path):
    feed = Feed(stateful, tmp_path, keep_days=1)
    feed.send([("a", "d1", 3)], [("a", h / 10, float(h)) for h in range(1, 40)])
    assert feed.send(records=[("clock", 30, 0.0)]) == {"d1": 30.0}
    held = feed.state_rows()
    assert feed.send([("a", "d2", 60)], [("clock", 90, 0.0)])["d1"] == 30.0
    assert feed.send(records=[("clock", 120, 0.0)])["d2"] is None
    assert feed.state_rows() <= held


def test_provider_is_required(spark):
    empty = spark.createDataFrame([], DECISIONS)
    with pytest.raises(ValueError, match="RocksDB"):
        asof_stream(empty, spark.createDataFrame([], RECORDS))


def test_entities_share_buckets(stateful, tmp_path):
    """State rows and timers follow the buckets and not the entities; answers are each entity's own."""
    feed = Feed(stateful, tmp_path, buckets=4)
    names = [f"e{i}" for i in range(300)]
    asked = [(e, f"{e}-{k}", 5 + 7 * k + i % 9) for i, e in enumerate(names) for k in range(2)]
    told = [(e, h + i % 5, float(1000 * i + h)) for i, e in enumerate(names) for h in (3, 8, 8.5) if i % 7]
    feed.send(asked + asked[:20], told)
    # The watermark is at hour 18: decisions after it wait, and records after it still count.
    told += [(e, 18.5 + i % 5, -float(i)) for i, e in enumerate(names) if i % 3]
    feed.send(records=[r for r in told if r[1] > 18])
    assert feed.state_rows() <= 4 * 5
    got = feed.send(records=[("clock", 40, 0.0)])
    want = {d: max(((t, v) for r, t, v in told if r == e and t <= h), default=(None, None))[1] for e, d, h in asked}
    assert got == want
    # What is left answers decisions that come later.
    got = feed.send([(e, f"{e}-late", 50) for e in names], [("clock", 60, 0.0)])
    got = feed.send(records=[("clock", 90, 0.0)])
    assert {e: got[f"{e}-late"] for e in names} == {e: max(((t, v) for r, t, v in told if r == e), default=(0, None))[1] for e in names}


def test_the_watermark_answers_what_it_has_passed(stateful, tmp_path):
    """With the watermark at hour 18, what is asked a millisecond before is answered and what is asked then is not."""
    feed = Feed(stateful, tmp_path)
    feed.send([("a", "before", 18 - 1 / 3_600_000), ("a", "at", 18)], [("a", 17, 1.0), ("a", 18, 2.0), ("clock", 20, 0.0)])
    assert feed.send(records=[("clock", 20, 0.0)]) == {"before": 1.0}
    assert feed.send(records=[("clock", 21, 0.0)]) == {"before": 1.0, "at": 2.0}

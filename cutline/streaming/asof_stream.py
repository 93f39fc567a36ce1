"""As-of join of two streams: each decision gets what was known of its entity at its time.

Both streams share one event-time watermark. A decision waits in its entity's state until the watermark has
passed its time, so every record that is in time counts, in whatever order the two arrive; an event-time timer
then answers it. Records later than the watermark are dropped by Spark before they reach the state (counted as
``numRowsDroppedByWatermark`` in the query's progress), so an answer once given is never contradicted.

Of the records before the watermark only the latest can still matter and is kept; a second timer drops it, and
with it all state of the entity, once it is older than ``keep``. A record that old answers no decision.

State and timers belong to buckets of entities and not to single ones: a call into Python, a state row and a timer
cost about as much for one entity as for some thousand rows, which are worked on as columns. A bucket that a batch
or the watermark reaches is read and written whole, so buckets should hold thousands of rows and not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 2048
_ANSWER = "entity_id string, decision_id string, cutoff bigint, known_at bigint, point_in_time_value double"
_HELD = pa.schema([("entity_id", pa.string()), ("decision_id", pa.string()), ("micros", pa.int64()), ("feature_value", pa.float64())])
_DAY = 86_400_000_000


class _Waiting(StatefulProcessor):
    """State of one bucket: the records of its entities that still count, and their unanswered decisions.

    Both are rows of one frame; a decision is a row with a ``decision_id``."""

    def __init__(self, keep_micros: int):
        self.keep = keep_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        both = pd.concat([held, *(batch[_HELD.names] for batch in rows)] if len(held) else [batch[_HELD.names] for batch in rows])
        self._hold(held, self._still_counting(both, timerValues.getCurrentWatermarkInMs() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # All that the watermark has passed is answered with the first of a bucket's timers.
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        due = (held["decision_id"].notna() & (held["micros"] < passed)).to_numpy(bool)
        left = self._still_counting(held[~due], passed)
        if len(left) < len(held):
            self._hold(held, left)
        if due.any():
            yield self._answered(held, due)

    def _answered(self, held: pd.DataFrame, due: np.ndarray) -> pd.DataFrame:
        """Each decision that is due with the largest value of the latest time up to it; records of one time do not
        conflict under the contract."""
        rows = held[due | held["decision_id"].isna().to_numpy(bool)]
        asked, entity, at, value = _columns(rows)
        order = np.lexsort((value, asked, at, entity))
        asked, entity, at, value = asked[order], entity[order], at[order], value[order]
        last = np.maximum.accumulate(np.where(asked, -1, np.arange(len(order))))
        known = (last >= 0) & (entity[last] == entity) & (at[last] >= at - self.keep)
        frame = pd.DataFrame(
            {
                "entity_id": rows["entity_id"].to_numpy()[order], "decision_id": rows["decision_id"].to_numpy()[order], "cutoff": at,
                "known_at": pd.array(np.where(known, at[last], 0), "Int64"), "point_in_time_value": np.where(known, value[last], np.nan),
            }
        )
        frame.loc[~known, "known_at"] = pd.NA
        return frame[asked].reset_index(drop=True)

    def _still_counting(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        """The waiting decisions, each once, and the records that one of them, or one that may still come, can use:
        of each entity the latest before both, and all later."""
        asked, entity, at, value = _columns(rows)
        oldest = np.full(entity.max(initial=-1) + 1, passed, np.int64)
        np.minimum.at(oldest, entity[asked], at[asked])
        known = np.flatnonzero(~asked & (at >= oldest[entity] - self.keep))
        known = known[np.lexsort((value[known], at[known], entity[known]))]
        settled = at[known] <= np.minimum(oldest, passed - 1)[entity[known]]
        older = np.zeros(len(known), bool)
        older[:-1] = settled[1:] & (entity[known[1:]] == entity[known[:-1]])
        waiting = rows[asked].drop_duplicates(["entity_id", "decision_id", "micros"])
        return pd.concat([rows.iloc[known[~older]], waiting])

    def _held(self) -> pd.DataFrame:
        kept = self.state.get()
        return pa.ipc.open_stream(kept[0]).read_all().to_pandas() if kept else _HELD.empty_table().to_pandas()

    def _hold(self, before: pd.DataFrame, rows: pd.DataFrame) -> None:
        """Keep the rows; a timer is set already for each time that the rows before had too."""
        for timer in self._timers(rows) - self._timers(before):
            self.handle.registerTimer(timer)
        if not len(rows):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows, _HELD, preserve_index=False)
        with pa.ipc.new_stream(sink, _HELD) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))

    def _timers(self, rows: pd.DataFrame) -> set[int]:
        """When the first decision is due, and when the first entity's records become too old."""
        asked, entity, at, _ = _columns(rows)
        latest = np.full(entity.max(initial=-1) + 1, np.iinfo(np.int64).min)
        np.maximum.at(latest, entity[~asked], at[~asked])
        latest = np.unique(latest[entity[~asked]])
        return {_after(int(t)) for t in (*at[asked][np.argsort(at[asked])][:1], *(latest[:1] + self.keep))}

    def close(self) -> None:
        pass


def _columns(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a row is a decision, its entity as a number, its time and its value."""
    entity = pd.factorize(rows["entity_id"])[0]
    return rows["decision_id"].notna().to_numpy(bool), entity, rows["micros"].to_numpy(np.int64), rows["feature_value"].to_numpy(np.float64)


def _after(micros: int) -> int:
    """The first whole millisecond after a time: a timer there fires when nothing up to the time can come."""
    return micros // 1000 + 1


def asof_stream(
    decisions: DataFrame, records: DataFrame, delay: str = "1 hour", keep_days: int = 3650, buckets: int = BUCKETS
) -> DataFrame:
    """``entity_id, decision_id, prediction_time, known_at, point_in_time_value``, one row per decision.

    ``decisions`` streams ``entity_id, decision_id, prediction_time``; ``records`` streams ``entity_id,
    available_at, feature_value``. Rows with a NULL key or time, and NULL values, answer nothing and are left
    out. A decision sent twice before it is answered is answered once. A query that goes on from a checkpoint
    must have the number of ``buckets`` it began with.
    """
    spark = decisions.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"timers need spark.sql.streaming.stateStore.providerClass={PROVIDER}")
    asked = decisions.select(
        F.col("entity_id").cast("string"), F.col("prediction_time").cast("timestamp").alias("at"),
        F.col("decision_id").cast("string"), F.lit(None).cast("double").alias("feature_value"),
    ).where("decision_id is not null")
    told = records.select(
        F.col("entity_id").cast("string"), F.col("available_at").cast("timestamp").alias("at"),
        F.lit(None).cast("string").alias("decision_id"), F.col("feature_value").cast("double"),
    ).where("feature_value is not null")
    both = asked.unionByName(told).where("entity_id is not null and at is not null").withColumn("micros", F.unix_micros("at"))
    answers = (
        both.withWatermark("at", delay)
        .withColumn("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .transformWithStateInPandas(_Waiting(keep_days * _DAY), outputStructType=_ANSWER, outputMode="append", timeMode="eventTime")
    )
    return answers.select(
        "entity_id", "decision_id", F.timestamp_micros("cutoff").alias("prediction_time"),
        F.timestamp_micros("known_at").alias("known_at"), "point_in_time_value",
    )

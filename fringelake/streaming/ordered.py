"""An event log in order, from a stream that is not: keyed state with timers.

Events wait in buckets of time by key. When the watermark passes the end of a bucket,
its timer fires: the bucket is put in order of (ts, event_id), numbered on from the last one,
and marked where the gap to the event before is wide enough to publish it. So each
event leaves once, with the number and the mark that a batch over the whole log gives it.
A task holds one bucket of one key at a time, never a key's whole log.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times that a task can hold: within so many microseconds of 1970 (years 1678 to 2261).
REACH = 9_200_000_000_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; call it before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Order(StatefulProcessor):
    def __init__(self, key: str, width_ms: int, gap_us: int):
        self.key, self.width, self.gap = key, width_ms, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "us array<long>, event_id array<long>, status array<string>")
        self.last = handle.getValueState("last", "next long, us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came: dict[int, list[pd.DataFrame]] = {}
        for batch in rows:
            for bucket, some in batch.groupby(batch["us"] // (self.width * 1000)):
                came.setdefault(int(bucket), []).append(some)
        for bucket, parts in came.items():
            new = pd.concat(parts)
            us, ids = new["us"].tolist(), new["event_id"].tolist()
            status = [None if s is None else str(s) for s in new["status"]]
            if self.waiting.containsKey((bucket,)):
                old = self.waiting.getValue((bucket,))
                us, ids, status = [*old[0], *us], [*old[1], *ids], [*old[2], *status]
            self.waiting.updateValue((bucket,), (us, ids, status))
            self.handle.registerTimer((bucket + 1) * self.width)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // self.width
        for bucket in sorted(k[0] for k in self.waiting.keys() if k[0] < due):
            us, ids, status = self.waiting.getValue((bucket,))
            us, ids = np.array(us, np.int64), np.array(ids, np.int64)
            order = np.lexsort((ids, us))
            us, ids = us[order], ids[order]
            first, before = self.last.get() if self.last.exists() else (0, None)
            gap = np.diff(us, prepend=us[0] if before is None else before)
            publish = gap > self.gap
            if before is None:
                publish[0] = True
            self.last.update((first + len(us), int(us[-1])))
            self.waiting.removeKey((bucket,))
            yield pd.DataFrame({self.key: [key[0]] * len(us), "event_id": ids, "us": us, "status": [status[k] for k in order], "i": first + np.arange(len(us)), "published": publish})

    def close(self) -> None:
        pass


def ordered_log(events: DataFrame, key: str, delay: str = "10 minutes", bucket_seconds: int = 60, gap_seconds: float = 30.0) -> DataFrame:
    """(key, event_id, ts, status, i, published) of a stream of (key, event_id, ts, status).

    i counts a key's events from 0 in order of (ts, event_id); published marks those more than
    `gap_seconds` after the one before, and the first. An event leaves once the watermark, `delay`
    behind the newest event, has passed its bucket; one that comes later than that is
    dropped (Spark counts these). Events without time or id, or from before 1678 or after 2261, have no place in the
    order and are left out; a null status stays null; of equal (ts, event_id) each keeps a number of its own.
    """
    if bucket_seconds < 1:
        raise ValueError("a bucket lasts a second at least")
    at = events.select(key, F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.col("status").cast("string"))
    us = F.unix_micros("ts")
    marked = at.where(us.between(-REACH, REACH) & F.col("event_id").isNotNull()).withWatermark("ts", delay).withColumn("us", us)
    kind = at.schema[key].dataType.simpleString()
    out = marked.groupBy(key).transformWithStateInPandas(
        _Order(key, bucket_seconds * 1000, round(gap_seconds * 1e6)), f"`{key}` {kind}, event_id long, us long, status string, i long, published boolean", "Append", "EventTime"
    )
    return out.select(key, "event_id", F.timestamp_micros("us").alias("ts"), "status", "i", "published")

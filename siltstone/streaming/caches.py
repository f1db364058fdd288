"""A semantic cache as streaming state: entries by query, the last one wins, each with a timer of its time to live.

Time is event time: the watermark of the puts. So replaying the same puts gives the same cache, whenever it happens, and a restart goes on
from the checkpoint. The state store must be RocksDB (``with_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "query string, event_id long, created_at long, change string"


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Entries(StatefulProcessor):
    """One query's entry: a newer put replaces it, its timer ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "event_id long, created_at long, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.entry.get()) if self.entry.exists() else None
        best = held
        for frame in rows:
            for event, created, ttl in frame[["event_id", "created_at", "ttl_seconds"]].itertuples(index=False):
                if best is None or (created, event) > (best[1], best[0]):
                    best = (int(event), int(created), int(created + ttl))
        if best != held:
            if held is not None:
                self.handle.deleteTimer(held[2] * 1000 + 1)
            self.entry.update(best)
            self.handle.registerTimer(best[2] * 1000 + 1)  # the last second counts
            yield pd.DataFrame({"query": [key[0]], "event_id": [best[0]], "created_at": [best[1]], "change": ["put"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            event, created, expires = tuple(self.entry.get())
            if expires * 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield pd.DataFrame({"query": [key[0]], "event_id": [event], "created_at": [created], "change": ["expired"]})

    def close(self) -> None:
        pass


def changes(puts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """query, event_id, created_at, change (put or expired) of a stream of puts (query, event_id, created_at, ttl_seconds; times in seconds)."""
    timed = puts.select("query", "event_id", "created_at", "ttl_seconds", F.timestamp_seconds("created_at").alias("at")).withWatermark("at", late)
    return timed.groupBy("query").transformWithStateInPandas(statefulProcessor=Entries(), outputStructType=CHANGES, outputMode="Append", timeMode="eventTime")


def live(changed: DataFrame) -> DataFrame:
    """query, event_id of the entries that the changes so far leave alive."""
    last = Window.partitionBy("query").orderBy(F.desc("created_at"), F.desc("event_id"), "change")  # of one entry, its end comes before its put
    return changed.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1 AND change = 'put'").select("query", "event_id")

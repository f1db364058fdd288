"""Structured Streaming forms of what arrives over time: ingest, caches, breakers and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arrivals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(path)


def ingest(stream: DataFrame, known: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, checkpoint: str) -> StreamingQuery:
    """Rows whose key is not known yet go to ``write``, batch by batch; each run takes what is there and ends."""

    def batch(df: DataFrame, _: int) -> None:
        write(df.dropDuplicates([key]).join(known().select(key), key, "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(stream: DataFrame, ts: str, by: list[str], length: str = "1 day", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Counts and means by event-time window and keys; rows later than ``late`` are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "mean")


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events no further apart than ``gap``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def unique(stream: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _opened(failures: int, ok: bool, limit: int) -> tuple[int, bool]:
    failures = 0 if ok else failures + 1
    return failures, failures >= limit


def breaker(calls: DataFrame, limit: int = 3) -> DataFrame:
    """model, seq, open: whether ``limit`` failures in a row have opened a model's breaker (calls: model, seq, ok). Works on streams and tables."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for f in frames:
            out = []
            for seq, ok in f.sort_values("seq")[["seq", "ok"]].itertuples(index=False):
                failures, opened = _opened(failures, bool(ok), limit)
                out.append((key[0], seq, opened))
            yield pd.DataFrame(out, columns=["model", "seq", "open"])
        state.update((failures,))

    return calls.groupBy("model").applyInPandasWithState(step, "model string, seq long, open boolean", "failures int", "append", GroupStateTimeout.NoTimeout)


def breaker_table(calls: DataFrame, limit: int = 3) -> DataFrame:
    """The same over a table of calls, by windows alone: failures since the last success."""
    from pyspark.sql import Window

    w = Window.partitionBy("model").orderBy("seq")
    runs = calls.withColumn("good", F.sum(F.col("ok").cast("int")).over(w))
    failures = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("model", "good").orderBy("seq"))
    return runs.select("model", "seq", (failures >= limit).alias("open"))


def monitored(entries: DataFrame, categories: list[str], since: Column) -> DataFrame:
    """Entries of a feed (categories, updated) that were updated since a time, a row for each watched category; works on streams and tables."""
    watched = F.array(*map(F.lit, categories))
    return entries.filter(F.col("updated") >= since).withColumn("category", F.explode(F.array_intersect("categories", watched)))


def digest(entries: DataFrame) -> DataFrame:
    """day, category, items: the daily digest of monitored entries."""
    return entries.groupBy(F.to_date("updated").alias("day"), "category").agg(F.count(F.lit(1)).alias("items"))


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives now, as a table in memory (tests and small reports)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)

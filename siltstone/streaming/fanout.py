"""Ingest of batches into every store: all stores of a batch, or none.

A batch writes each store below the batch's number, and a mark last. What has no mark is not read, and is written again when the batch comes again; a
batch that has its mark does nothing. So failures and replays change nothing that a reader sees. Stores hold the rows of every batch; ``current`` gives, of
each key, those of its last batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import tables

Writer = Callable[[DataFrame, str], None]


def write(rows: DataFrame, path: str) -> None:
    """A store's rows of one batch, in the place of what an earlier try left."""
    rows.write.mode("overwrite").parquet(path)


def store_everywhere(stores: dict[str, DataFrame], batch: int, folder: str, writers: dict[str, Writer] | None = None) -> bool:
    """Writes every store of a batch, then its mark. False where the batch was complete before."""
    spark = next(iter(stores.values())).sparkSession
    mark = f"{folder}/_marks/batch={batch}"
    if tables.exists(spark, mark):
        return False
    for name, rows in stores.items():
        (writers or {}).get(name, write)(rows, f"{folder}/{name}/batch={batch}")
    where, fs = tables._fs(spark, mark)
    fs.create(where, True).close()
    return True


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The complete batches."""
    where, fs = tables._fs(spark, f"{folder}/_marks")
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(where)) if fs.exists(where) else []


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A store's rows of all complete batches, and batch."""
    paths = [f"{folder}/{name}/batch={b}" for b in batches(spark, folder)]
    if not paths:
        raise ValueError(f"no complete batch in {folder}")
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*paths)


def current(spark: SparkSession, folder: str, name: str, key: str, of: str = "papers") -> DataFrame:
    """Of each key the rows of the last complete batch that has it in the store ``of``: what a later batch does not say again is gone."""
    last = read(spark, folder, of).groupBy(key).agg(F.max("batch").alias("batch"))
    return read(spark, folder, name).join(last, [key, "batch"], "left_semi").drop("batch")


def ingest_batches(stream: DataFrame, derive: Callable[[DataFrame], dict[str, DataFrame]], folder: str, checkpoint: str, writers: dict[str, Writer] | None = None) -> StreamingQuery:
    """Every batch of the stream goes to all the stores that ``derive`` makes of it; takes what is there and ends. The batch is kept while it is written."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            store_everywhere(derive(df), number, folder, writers)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

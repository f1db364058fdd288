"""Streams that are restarted, replayed and cut off: the cache's state and the fan-out to every store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import similar, stores
from siltstone.session import fresh_path
from siltstone.streaming import caches, fanout, streams

PUTS = "query string, event_id long, created_at long, ttl_seconds long"


def put(spark, folder, rows):
    spark.createDataFrame(rows, PUTS).coalesce(1).write.mode("append").parquet(folder)


def test_cache_state_survives_a_restart_and_equals_the_batch_filter(spark):
    folder = fresh_path(spark, "cache")
    schema = "query string, event_id long, created_at long, ttl_seconds long"

    def run(out="out", ck="ck"):
        with caches.with_state(spark):
            changed = caches.changes(streams.arrivals(spark, f"{folder}/in", schema, 1))
            changed.writeStream.format("parquet").option("path", f"{folder}/{out}").option("checkpointLocation", f"{folder}/{ck}").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in caches.live(spark.read.schema(caches.CHANGES).parquet(f"{folder}/{out}")).collect())

    def batch():
        every = spark.read.schema(schema).parquet(f"{folder}/in")
        last = every.groupBy("query").agg(F.max_by(F.struct("event_id", "created_at", "ttl_seconds"), F.struct("created_at", "event_id")).alias("e")).select("query", "e.*")
        return sorted((r.query, r.event_id) for r in stores.cache_live(last, F.lit(every.agg(F.max("created_at")).first()[0])).collect())

    put(spark, f"{folder}/in", [("a", 1, 1000, 50), ("b", 2, 1010, 500), ("a", 3, 1020, 30), ("c", 4, 1020, 30)])
    assert run() == batch() == [("a", 3), ("b", 2), ("c", 4)]
    put(spark, f"{folder}/in", [("d", 5, 1050, 10), ("a", 6, 1050, 5)])  # c lives in its last second, a is renewed
    assert run() == batch() == [("a", 6), ("b", 2), ("c", 4), ("d", 5)]
    put(spark, f"{folder}/in", [("e", 7, 1061, 10)])
    assert run() == batch() == [("b", 2), ("e", 7)]
    assert run() == [("b", 2), ("e", 7)]  # nothing new
    assert run("again", "ck2") == [("b", 2), ("e", 7)]  # all of it replayed


def _stores(df):
    return {"papers": df.select("paper_id", "v"), "chunks": df.select("paper_id", F.explode(F.sequence(F.lit(1), F.col("v"))).alias("n")), "claims": df.filter("v > 1").select("paper_id", "v")}


def test_a_batch_that_failed_midway_changes_nothing_and_is_run_again(spark):
    folder = fresh_path(spark, "stores")
    df = lambda rows: spark.createDataFrame(rows, "paper_id string, v int").coalesce(1)
    df([("a", 2), ("b", 1)]).write.parquet(f"{folder}/in")
    broken = []

    def fails(rows, path):
        if not broken:
            broken.append(path)
            raise RuntimeError("the third store is away")
        fanout.write(rows, path)

    def run():
        fanout.ingest_batches(streams.arrivals(spark, f"{folder}/in", "paper_id string, v int", 1), _stores, f"{folder}/out", f"{folder}/ck", {"claims": fails}).awaitTermination()

    with pytest.raises(Exception, match="third store"):
        run()
    assert fanout.batches(spark, f"{folder}/out") == [] and broken
    run()
    assert fanout.batches(spark, f"{folder}/out") == [0]
    now = lambda name: sorted(tuple(r) for r in fanout.current(spark, f"{folder}/out", name, "paper_id").collect())
    assert now("papers") == [("a", 2), ("b", 1)] and now("chunks") == [("a", 1), ("a", 2), ("b", 1)] and now("claims") == [("a", 2)]
    assert not fanout.store_everywhere(_stores(df([("z", 9)])), 0, f"{folder}/out")  # complete: a replay writes nothing
    assert now("papers") == [("a", 2), ("b", 1)]
    df([("a", 1)]).write.mode("append").parquet(f"{folder}/in")  # a comes again, without claims
    run()
    assert now("papers") == [("a", 1), ("b", 1)] and now("chunks") == [("a", 1), ("b", 1)] and now("claims") == []


def test_similarity_join_finds_every_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.random((30, 40)) * (rng.random((30, 40)) < 0.3)
    data = np.vstack([base, base + 0.1 * rng.random(base.shape) * (base > 0), base[:5], np.eye(40)[:2]])
    data = data[np.linalg.norm(data, axis=1) > 0]
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(data)], "key long, idx array<int>, w array<double>")
    for t in (0.5, 0.92, 0.999):
        got = {(r.query_id, r.key) for r in similar.above(df.withColumnRenamed("key", "query_id"), df, "key", t).collect()}
        scores = np.round(data @ data.T, 9)
        assert got == {(i, j) for i, j in np.argwhere(scores >= t).tolist()}
    assert similar.above(df.withColumnRenamed("key", "query_id").limit(0), df, "key", 0.9).count() == 0


def test_batches_of_several_files_give_the_same_stores(spark, monkeypatch):
    from siltstone.queries import QUERIES, relational
    from siltstone.session import shared_dir

    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES["str07_batch_ingest"](spark, folder).collect()))
    monkeypatch.setattr(relational, "ARRIVAL", 8000)
    made = []
    monkeypatch.setattr(relational, "fresh_path", lambda s, name: made.append(fresh_path(s, name)) or made[-1])
    assert sorted(map(tuple, QUERIES["str07_batch_ingest"](spark, folder).collect())) == want
    assert made[0].startswith(shared_dir(spark)) and len(fanout.batches(spark, f"{made[0]}/out")) == 5
    assert spark.read.parquet(f"{made[0]}/in").select(F.input_file_name()).distinct().count() > 10

"""Stored tables: bucketed stores, the segmented inverted index and the clustered vector index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import bm25, postings, tables, vector_index
from siltstone.operators.postings import Postings
from siltstone.operators.tables import Bucketed
from siltstone.session import fresh_path


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_bucketed_table_writes_only_what_a_change_touches(spark):
    data = spark.range(500).select(F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("paper"), F.col("id").alias("n"))
    held = Bucketed(spark, fresh_path(spark, "t"), "paper", 16).create(data)
    assert rows(held.read(), "paper", "n") == rows(data, "paper", "n")
    before = tables.files(spark, f"{held.path}/rows")
    fresh = spark.createDataFrame([("p7", 1000), ("p7", 1001), ("new", 1002)], "paper string, n long")
    touched = held.replace(fresh, spark.createDataFrame([("p8",)], "paper string"))
    after = tables.files(spark, f"{held.path}/rows")
    of = lambda f: int(f.rsplit("bucket_=", 1)[1].split("/")[0])
    assert len(touched) <= 3 and {of(f) for f in set(before) ^ set(after)} <= set(touched)
    assert {f: v for f, v in before.items() if of(f) not in touched} == {f: v for f, v in after.items() if of(f) not in touched}
    assert rows(held.read(), "paper", "n") == rows(data.filter("paper NOT IN ('p7', 'p8')").unionByName(fresh), "paper", "n")
    assert held.rows_of(fresh).count() == 3
    held.replace(fresh)  # again: the same rows
    assert held.read().count() == 493
    held.remove(held.read().select("paper"))
    assert held.read().count() == 0


def test_a_hot_key_fills_one_bucket_of_several_rows(spark):
    data = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    held = Bucketed(spark, fresh_path(spark, "t"), "k", 8).create(data)
    held.remove(spark.createDataFrame([("hot",), (None,)], "k string"))
    assert held.read().count() == 2000


def test_once_builds_once(spark):
    made = []
    build = lambda path: (made.append(path), spark.range(3).write.parquet(f"{path}/rows"))
    a, b = tables.once(spark, "x", "v1", build), tables.once(spark, "x", "v1", build)
    assert a == b and len(made) == 1 and spark.read.parquet(f"{a}/rows").count() == 3
    assert tables.once(spark, "x", "v2", build) != a and len(made) == 2


WORDS = [f"w{i}" for i in range(400)]


def corpus(seed, n):
    r = random.Random(seed)
    return [(f"c{i:05d}", " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=r.randint(0, 60)))) for i in range(n)]


def asked(spark, seed, n=12):
    r = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(r.choices(WORDS, k=r.randint(1, 6))) + (" w0 w0" if i % 3 == 0 else "")) for i in range(n)] + [(99, "nothing known"), (98, "")], "query_id long, question string")


def same_hits(found, want):
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"]))] == [(r.query_id, r.chunk_id, r["rank"]) for r in sorted(want.collect(), key=lambda r: (r.query_id, r["rank"]))]


@pytest.mark.parametrize("k", [1, 5])
def test_search_is_exact_and_skips_blocks(spark, monkeypatch, k):
    chunks = spark.createDataFrame(corpus(1, 800), "chunk_id string, text string")
    index = Postings(spark, fresh_path(spark, "postings")).create(chunks)
    full = bm25.build(chunks)
    questions = asked(spark, 2)
    found = index.search(questions, k)
    same_hits(found.hits, bm25.top(full, questions, k))
    work = found.work.agg(F.sum("blocks_read"), F.sum("blocks_skipped")).first()
    print("blocks read, skipped", work)
    assert work[0] > 0 and work[1] > 0.2 * work[0]
    monkeypatch.setattr(postings, "PRODUCT_ROWS", 0)
    same_hits(index.search(questions, k).hits, bm25.top(full, questions, k))
    got, want = (rows(s.select("query_id", "chunk_id", F.round("score", 9).alias("s")), "query_id", "chunk_id", "s") for s in (index.scores(questions), bm25.search(full, questions)))
    assert got == want
    assert rows(index.terms().select("term", "df", F.round("idf", 9)), "*") == rows(full.terms.select("term", "df", F.round("idf", 9)), "*")


def test_changes_write_segments_and_equal_a_rebuild(spark):
    first, more = corpus(3, 300), corpus(4, 80)
    df = lambda data: spark.createDataFrame(data, "chunk_id string, text string")
    index = Postings(spark, fresh_path(spark, "postings")).create(df(first))
    before = tables.files(spark, index.path)
    fresh = [*more[:40], *[(f"n{i}", t + " brandnew") for i, (_, t) in enumerate(more[40:])]]  # 40 replace, 40 are new
    index.add(df(fresh))
    assert before.items() <= tables.files(spark, index.path).items()  # no file of before was written again
    index.remove(df([*first[100:130], ("unknown", "")]))
    index.add(df([(first[100][0], "w1 back again")]))
    state = dict(first) | dict(fresh)
    for key, _ in first[100:130]:
        del state[key]
    state[first[100][0]] = "w1 back again"
    full = bm25.build(df(list(state.items())))
    rebuilt = rows(full.terms.select("term", "df", F.round("idf", 9)), "*")
    assert rows(index.terms().select("term", "df", F.round("idf", 9)), "*") == rebuilt
    questions = asked(spark, 5).unionByName(spark.createDataFrame([(50, "brandnew back")], "query_id long, question string"))
    same_hits(index.search(questions, 4).hits, bm25.top(full, questions, 4))
    # a segment that was cut off before its statistics does not count
    df([("half", "w1 w2")]).write.parquet(f"{index.path}/forward/seg=9")
    assert index.segments() == [0, 1, 2, 3]
    whole = index.compact(fresh_path(spark, "postings"))
    assert whole.segments() == [0] and rows(whole.terms().select("term", "df", F.round("idf", 9)), "*") == rebuilt
    same_hits(whole.search(questions, 4).hits, bm25.top(full, questions, 4))


def test_empty_index(spark):
    index = Postings(spark, fresh_path(spark, "postings")).create(spark.createDataFrame([], "chunk_id string, text string"))
    assert index.search(asked(spark, 1), 3).hits.count() == 0 and index.terms().count() == 0
    index.add(spark.createDataFrame([("a", "w1 w2"), ("b", None), ("c", "")], "chunk_id string, text string"))
    assert index.stats()["n"] == 3 and [r.chunk_id for r in index.search(spark.createDataFrame([(1, "w1")], "query_id long, question string"), 3).hits.collect()] == ["a"]


def vectors(spark, data):
    return spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(data)], "vec_id long, idx array<int>, w array<double>")


def test_vector_search_is_exact_and_prunes_clusters(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((20, 24))
    data = np.vstack([c + 0.15 * rng.standard_normal((100, 24)) for c in centres])
    data[5] = data[6]  # ties
    index = vector_index.create(vectors(spark, data), fresh_path(spark, "v"), "vec_id", 24, clusters=20)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    chosen = [3, 5, 250, 777]
    questions = vectors(spark, data[chosen]).withColumnRenamed("vec_id", "query_id")
    found = index.search(questions, 10)
    got = {}
    for r in sorted(found.hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, i in enumerate(chosen):
        scores = np.round(unit @ unit[i], 9)
        assert got[q] == np.lexsort((np.arange(len(data)), -scores))[:10].tolist()
    print("clusters read", found.read, found.clusters)
    assert found.read[0] < found.clusters / 2
    odd = index.search(questions, 10, where=F.col("vec_id") % 2 == 1).hits.collect()
    scores = np.where(np.arange(len(data)) % 2 == 1, np.round(unit @ unit[3], 9), -9)
    assert [r.vec_id for r in sorted(odd, key=lambda r: r["rank"]) if r.query_id == 0] == np.lexsort((np.arange(len(data)), -scores))[:10].tolist()


def test_vector_index_of_nothing(spark):
    index = vector_index.create(vectors(spark, np.zeros((0, 3))), fresh_path(spark, "v"), "vec_id", 3)
    assert index.search(vectors(spark, np.ones((2, 3))).withColumnRenamed("vec_id", "query_id"), 2).hits.count() == 0
    zero = vector_index.create(vectors(spark, np.zeros((2, 3))), fresh_path(spark, "v"), "vec_id", 3)
    assert [r.score for r in zero.search(vectors(spark, np.ones((1, 3))).withColumnRenamed("vec_id", "query_id"), 5).hits.collect()] == [0.0, 0.0]


def test_blocks_do_not_repeat_keys_and_texts_are_not_exchanged(spark):
    few = [(str(i), text) for i, (_, text) in enumerate(corpus(6, 300))]
    size = lambda data: sum(n for n, _ in tables.files(spark, f"{Postings(spark, fresh_path(spark, 'postings')).create(spark.createDataFrame(data, 'chunk_id string, text string')).path}/blocks").values())
    r = random.Random(7)
    assert size([("".join(r.choices("0123456789abcdef", k=400)) + i, text) for i, text in few]) < 1.1 * size(few)


def test_keys_that_come_again_count_once(spark):
    twice = spark.createDataFrame([("a", "w1 w2"), ("a", "w1 w2"), ("b", "w1 w1 w3")], "chunk_id string, text string")
    index = Postings(spark, fresh_path(spark, "postings")).create(twice)
    assert index.stats()["n"] == 2 and rows(index.frequencies(), "term", "df") == [("w1", 2), ("w2", 1), ("w3", 1)]


def test_a_removal_writes_and_sends_places_and_not_keys_or_terms(spark, monkeypatch):
    r = random.Random(8)
    long = {key: "".join(r.choices("0123456789abcdef", k=400)) + key for key, _ in corpus(8, 300)}
    df = lambda data: spark.createDataFrame([(long[k], t) for k, t in data], "chunk_id string, text string").repartition(5, "chunk_id")
    data = corpus(8, 300)
    monkeypatch.setattr(postings, "DEAD_WORDS", 1)  # a range of shards for almost every word
    index = Postings(spark, fresh_path(spark, "postings")).create(df(data))
    index.remove(df(data[:120])).add(df([(k, t + " again") for k, t in data[100:150]])).remove(df(data[290:]))
    assert sum(n for f, (n, _) in tables.files(spark, f"{index.path}/dead").items()) < 120 * 400
    kept = [(k, t + " again" if 100 <= i < 150 else t) for i, (k, t) in enumerate(data) if 100 <= i < 290]
    full = bm25.build(df(kept))
    assert rows(index.terms().select("term", "df", F.round("idf", 9)), "*") == rows(full.terms.select("term", "df", F.round("idf", 9)), "*")
    questions = asked(spark, 9, 4)
    same_hits(index.search(questions, 4).hits, bm25.top(full, questions, 4))
    monkeypatch.setattr(postings, "PRODUCT_ROWS", 0)
    same_hits(index.search(questions, 4).hits, bm25.top(full, questions, 4))


def test_keys_are_sent_to_rows_for_some_buckets_at_a_time(spark, monkeypatch):
    data = spark.range(400).select(F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("paper"), F.col("id").alias("n"))
    gone = spark.createDataFrame([*((f"p{i}",) for i in range(40)), ("unknown",), (None,)], "paper string")
    for keys in (5, 500_000):  # some buckets' keys are too many to send, or all go at once
        monkeypatch.setattr(tables, "KEYS", keys)
        held = Bucketed(spark, fresh_path(spark, "t"), "paper", 8).create(data)
        fresh = spark.createDataFrame([("p1", 1000), ("p50", 1001), (None, 1002)], "paper string, n long")
        held.replace(fresh, gone)
        want = [r for r in rows(data, "paper", "n") if r[0] not in {f"p{i}" for i in (*range(40), 50)}] + rows(fresh, "paper", "n")
        assert rows(held.read(), "paper", "n") == sorted(want, key=repr)


def test_hits_meet_texts_where_texts_are_read(spark, tmp_path, monkeypatch):
    from siltstone.operators import fusion

    spark.range(300).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("words").alias("text")).write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    hits = spark.range(40).select((F.col("id") % 3).alias("query_id"), F.concat(F.lit("c"), (F.col("id") * 11).cast("string")).alias("chunk_id"))
    want = sorted(tuple(r) for r in hits.join(texts, "chunk_id").collect())
    for most in (7, 100_000):
        monkeypatch.setattr(fusion, "SENT", most)
        assert sorted(tuple(r) for r in fusion.bodies(hits, texts).collect()) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(fusion, "checkpointed", lambda df: df)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = fusion.bodies(hits, texts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_products_need_no_blocks(spark, monkeypatch):
    from siltstone.operators import postings

    data = spark.range(300).select(F.col("id").cast("string").alias("chunk_id"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 11)).alias("text"))
    asked = spark.createDataFrame([(1, "w1 v2 word"), (2, "w3 v3")], "query_id long, question string")
    index = Postings(spark, fresh_path(spark, "postings")).create(data, made=False)
    hits = lambda: sorted(tuple(r) for r in index.search(asked, 5).hits.collect())
    monkeypatch.setattr(postings, "PRODUCT_ROWS", 0)
    want = hits()
    assert want and not tables.exists(spark, f"{index.path}/blocks")
    monkeypatch.setattr(postings, "PRODUCT_ROWS", 10**9)
    assert hits() == want and tables.exists(spark, f"{index.path}/blocks/seg=0")


def test_a_flat_index_is_exact_and_compares_no_vector_with_centroids(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(np.sort(rng.choice(64, rng.integers(0, 7), replace=False)), rng.choice([-1.0, 1.0, 2.0], 6)) for _ in range(700)]
    rows = [(i, at.tolist(), w[: len(at)].tolist()) for i, (at, w) in enumerate(data)]
    monkeypatch.setattr(vector_index, "_centroids", None)  # not called
    index = vector_index.create(spark.createDataFrame(rows, "vec_id long, idx array<int>, w array<double>"), fresh_path(spark, "v"), "vec_id", 64, flat=True)
    asked = spark.createDataFrame([(10, [1, 5, 9, 30], [1.0, -1.0, 1.0, 1.0]), (11, [2], [-1.0]), (12, [], [])], "query_id long, idx array<int>, w array<double>")
    unit = lambda idx, w: np.bincount(np.array(idx, int), weights=np.array(w, float), minlength=64) / (np.linalg.norm(w) or 1.0)
    found = index.search(asked, 12, shared=True)
    assert found.clusters == 1 and found.read == [1]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.hits.collect())
    want = []
    for q in asked.collect():
        scores = sorted((-float(np.round(unit(q.idx, q.w) @ unit(idx, w), 9)) + 0.0, i) for i, idx, w in rows if set(idx) & set(q.idx))
        want += [(q.query_id, n, i, -s + 0.0) for n, (s, i) in enumerate(scores[:12], 1)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_products_and_the_best_of_a_task_are_those_of_every_batch(monkeypatch):
    from siltstone.operators import blocks

    rng = np.random.default_rng(9)
    matrix = np.where(rng.random((40, 6)) < rng.random((40, 1)), rng.integers(-2, 3, (40, 6)), 0).astype(float)
    monkeypatch.setattr(blocks, "COMMON", 7)
    monkeypatch.setattr(blocks, "PRODUCT", 200)
    best, every = blocks.Best([5, 6, 7, 8, 9, 10], 3), []
    for b in range(30):
        rows = [rng.choice(40, rng.integers(0, 9), replace=False) for _ in range(25)]
        at, sizes = np.concatenate(rows).astype(np.int64), np.array([len(x) for x in rows])
        w = rng.integers(1, 4, len(at)).astype(float)
        scores = blocks.products(at, w, sizes, matrix)
        assert scores == pytest.approx(np.array([sum((x * matrix[p] for p, x in zip(r, w[sizes[:i].sum() :], strict=False)), np.zeros(6)) for i, r in enumerate(rows)]))
        keys = np.array([f"k{rng.integers(10**9)}" for _ in rows], object)
        best.add(keys, scores, best.open(scores))
        every += [(5 + j, -scores[i, j], keys[i]) for i in range(25) for j in range(6)]
    got = sorted(zip(*(x.tolist() for x in best.rows()), strict=True))
    assert got == sorted((q, k, -s) for j in range(5, 11) for q, s, k in sorted(x for x in every if x[0] == j)[:3])


def test_a_task_yields_its_best_rows_once(spark):
    from siltstone.operators import blocks

    class Sent:
        value = ([4, 5], np.array([[1.0, 0.5], [0.0, 2.0]]))

    import pandas as pd

    batches = [pd.DataFrame({"row": [f"r{b}{i}" for i in range(9)], "_i": [[i % 2] for i in range(9)], "w": [[float(b + i)] for i in range(9)]}) for b in range(8)]
    out = list(blocks._scorer(Sent, "row", 2, False, 9)(iter(batches)))
    assert len(out) == 1 and sorted(map(tuple, out[0].to_numpy().tolist())) == [(4, "r68", 14.0), (4, "r78", 15.0), (5, "r67", 26.0), (5, "r77", 28.0)]

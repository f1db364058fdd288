"""A stored inverted index: postings by falling impact, in blocks that a search skips, changed by segments.

Every change writes one segment; nothing written before is touched:

* ``forward``: the terms of each key, with a place (shard, place) that stands for it in blocks, and a bucket of the key by which rows are sorted, so that
  removing a key skips what lies in other buckets. A task writes the rows that it reads: no text is exchanged;
* ``blocks``: the postings of a term, cut by impact into ``LEVELS`` levels, and each level into blocks of at most ``BLOCK`` postings (place, tf) of a shard.
  A search that reads blocks makes those that a segment lacks; products read forward rows alone and need none. They are made and written where the forward rows are read, sorted by a bucket of the term, so nothing is exchanged for them and Parquet's statistics skip other buckets. The impact is what a posting adds to a score, but for the weight of the term: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean));
* ``terms``: by term and level, by how many postings a segment changes their number (``n``, negative where keys went), so document frequencies are
  sums of deltas and are not counted again;
* ``dead``: the places of earlier segments (of) that a segment removes or replaces, as bits of words of 64 places: these no longer count. They are sent to
  where forward rows are read, ``DEAD_WORDS`` words and their range of shards at a time, so that no terms are exchanged for a removal;
* ``stats``: changes of the number of keys and of their total length, and the mean idf after the change. It is written last: a segment counts once it is there.

The levels are those of the mean length at the time the index was made; a longer mean since then raises the bounds by its ratio.

``search`` finds the exact best ``k`` of each question: it reads the highest levels of the question's terms for a first k-th score; then it chooses the levels to
read, such that a key in none of them stays below that score; completes those that can still reach it from ``forward``; and leaves the other
blocks unread. It returns how many blocks that were. Where a batch asks so much of common terms that rows of question and posting would be more than
``PRODUCT_ROWS``, the forward rows are read once for all questions instead and multiplied where they are read; the hits are the same.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators import blocks, fusion, tables
from siltstone.operators.bm25 import EPSILON, K1, B
from siltstone.session import checkpointed

LEVELS, BLOCK, TERM_BUCKETS, KEY_BUCKETS = 32, 512, 32, 64
TOP = K1 + 1
#: Postings that the first read asks of every term, for each of the k results.
FIRST = 4
#: Rows of question and posting from which a batch is scored as a product instead: each posting is then read once for all questions.
PRODUCT_ROWS = 2_000_000
SLACK = 1e-8
#: Words of 64 places that are sent to the tasks together.
DEAD_WORDS = 500_000
#: Postings that a task turns into blocks together.
TURNED = 2_000_000


def impact(tf, dl, mean: float):
    """Of columns or of arrays."""
    return tf * TOP / (tf + K1 * (1 - B + B * dl / mean))


def _level(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return np.minimum(np.ceil(impact(tf, dl, mean) * LEVELS / TOP), LEVELS).astype(np.int32)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and their words to keys, their place, distinct terms, counts and length."""
    shard, first = TaskContext.get().partitionId(), 0
    for batch in batches:
        n, words = batch.num_rows, batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(words.flatten().cast(pa.string()))
        order = pc.sort_indices(coded.dictionary)
        known = np.empty(len(order), np.int64)
        known[order.to_numpy()] = np.arange(len(order))
        each = np.repeat(np.arange(n), sizes) * max(1, len(order)) + known[coded.indices.to_numpy()]
        each, tf = np.unique(each, return_counts=True)  # by row, then by term
        row, term = np.divmod(each, max(1, len(order)))
        own = np.bincount(row, minlength=n)
        terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), coded.dictionary.take(order).take(pa.array(term)))
        place = np.arange(first, first + n, dtype=np.int32)
        first += n
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, shard, np.int32)), pa.array(place), terms, _lists(tf, own), pa.array(sizes)], ["key", "shard", "place", "terms", "tfs", "dl"])


def _turned(mean: float):
    """Forward rows (shard, place, terms, tfs, dl) to blocks (term, level, shard, places, tfs)."""

    def turn(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sizes = pc.list_value_length(rows.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        shard, place, dl = (np.repeat(rows.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("shard", "place", "dl"))
        tf = rows.column("tfs").flatten().to_numpy(zero_copy_only=False)
        level = _level(tf, dl, mean)
        coded = pc.dictionary_encode(rows.column("terms").flatten())
        term = coded.indices.to_numpy()
        order = np.lexsort((place, shard, -level, term))
        term, level, shard, place, tf = term[order], level[order], shard[order], place[order], tf[order]
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (level[1:] != level[:-1]) | (shard[1:] != shard[:-1])]))
        number = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
        starts = np.flatnonzero(number % BLOCK == 0)
        lengths = np.diff(np.append(starts, len(term)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[starts])), pa.array(level[starts]), pa.array(shard[starts]), _lists(place, lengths), _lists(tf, lengths)], ["term", "level", "shard", "places", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            more = len(batch.column("terms").flatten())
            if more:
                held.append(batch)
                n += more
            if n >= TURNED:
                yield turn(held)
                held, n = [], 0
        if held:
            yield turn(held)

    return run


def _leveled(mean: float):
    """Forward rows (terms, tfs, dl) to how many postings a term has in a level (term, level, n), by batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
            if not sizes.sum():
                continue
            dl = np.repeat(batch.column("dl").to_numpy(zero_copy_only=False), sizes)
            level = _level(batch.column("tfs").flatten().to_numpy(zero_copy_only=False), dl, mean)
            coded = pc.dictionary_encode(batch.column("terms").flatten())
            each, n = np.unique(coded.indices.to_numpy().astype(np.int64) * (LEVELS + 1) + level, return_counts=True)
            term, level = np.divmod(each, LEVELS + 1)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term)), pa.array(level.astype(np.int32)), pa.array(n.astype(np.int64))], ["term", "level", "n"])

    return run


def _scorer(sent, mean: float, k: int | None, keep_zero: bool, digits: int):
    """Forward rows (key, terms, tfs, dl) times the questions: the best ``k`` of a task's rows, or (None) every pair that shares a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, places, matrix = sent.value
        vocabulary = pa.array(places, pa.string())
        # terms shared, unless a product that is not zero says so already
        shares = (matrix != 0).astype(np.float64) if keep_zero or (k is None and (matrix < 0).any()) else None
        best = None if k is None else blocks.Best(queries, k)
        for batch in batches:
            terms = batch.column(1)
            at = pc.fill_null(pc.index_in(terms.flatten().cast(pa.string()), value_set=vocabulary), -1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            asked = at >= 0
            at, row = at[asked], row[asked]
            if not len(at):
                continue
            w = impact(batch.column(2).flatten().to_numpy(zero_copy_only=False)[asked], batch.column(3).to_numpy(zero_copy_only=False)[row], mean)
            sizes = np.bincount(row, minlength=batch.num_rows)
            some = np.flatnonzero(sizes)
            scores = blocks.products(at, w, sizes[some], matrix)
            if k is None:
                pairs = scores != 0 if shares is None else blocks.products(at, np.ones(len(at)), sizes[some], shares) > 0
                i, j = np.nonzero(pairs)
                ids, asking, score = some[i], np.asarray(queries)[j], scores[i, j]
            else:
                scores = np.round(scores, digits)
                kind, open_ = batch.column(0).type, best.open(scores)
                zero = open_ & (scores == 0)
                if zero.any():  # a product that is not zero says that a term is shared
                    open_ &= ~zero if shares is None else ~zero | (blocks.products(at, np.ones(len(at)), sizes[some], shares) > 0)
                best.add(batch.column(0).take(pa.array(some)).to_numpy(zero_copy_only=False), scores, open_)
                continue
            for a in range(0, len(ids), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(asking[b].astype(np.int64)), batch.column(0).take(pa.array(ids[b])), pa.array(score[b])], ["query_id", "key", "score"])
        if best is not None and best.n:
            query, keys, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(keys, kind), pa.array(score)], ["query_id", "key", "score"])

    return run


@dataclass(frozen=True)
class Found:
    """hits (query_id, key, score, rank); work (query_id, blocks_read, blocks_skipped), counted when it is asked for."""

    hits: DataFrame
    counted: Callable[[], DataFrame]

    @property
    def work(self) -> DataFrame:
        return self.counted()


class Postings:
    """The index below a path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", tokenizer=tokens):
        self.spark, self.path, self.key, self.tokenizer = spark, path, key, tokenizer
        self._seen: list[int] | None = None  # the segments of a snapshot
        self._kind: str | None = None

    def snapshot(self) -> Postings:
        """The index as it is now: what is read through it stays the same while others change the index."""
        out = Postings(self.spark, self.path, self.key, self.tokenizer)
        out._seen = self.segments()
        return out

    # --- reading

    def _read(self, table: str) -> DataFrame:
        """The table's rows in finished segments."""
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        if table == "blocks":
            self._build()
        if table in ("forward", "blocks"):  # a segment without rows has no files there
            self._kind = kind = self._kind or self.spark.read.parquet(f"{self.path}/stats").first()["kind"]
            key = {"forward": f"{self.key} {kind}, shard int, place int, terms array<string>, tfs array<int>, dl long, bucket int, seg int", "blocks": "term string, level int, shard int, places array<int>, tfs array<int>, bucket int, seg int"}[table]
            reader = reader.schema(key)
        return reader.parquet(*(f"{self.path}/{table}/seg={s}" for s in self.segments()))

    def _build(self) -> None:
        """Makes the blocks of segments that have none yet; each appears whole, under a name of its own before."""
        missing = [s for s in self.segments() if not tables.exists(self.spark, f"{self.path}/blocks/seg={s}")]
        reference = self.stats()["reference"] if missing else 1.0
        for seg in missing:
            forward = self._read("forward").filter(F.col("seg") == seg).select("shard", "place", "terms", "tfs", "dl")
            block = forward.mapInArrow(_turned(reference), "term string, level int, shard int, places array<int>, tfs array<int>")
            block = block.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")).sortWithinPartitions("bucket", "term", F.desc("level"))
            made = f"{self.path}/_making-{uuid.uuid4().hex}"
            block.write.option("compression", "zstd").parquet(made)
            if not tables.move(self.spark, made, f"{self.path}/blocks/seg={seg}"):  # another was first
                tables.delete(self.spark, made)

    def segments(self) -> list[int]:
        if self._seen is not None:
            return self._seen
        if not tables.exists(self.spark, f"{self.path}/stats"):
            return []
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/stats").select("seg").distinct().collect())

    def stats(self) -> dict:
        """n (keys), mean (length), mean_idf, reference (the mean length that the levels go by)."""
        rows = sorted((r for r in self.spark.read.parquet(f"{self.path}/stats").collect() if self._seen is None or r["seg"] in self._seen), key=lambda r: r["seg"])  # a row a segment
        n, total = sum(r["n"] for r in rows), sum(r["total"] for r in rows)
        return {"n": n, "total": total, "mean": total / n if n else 1.0, "mean_idf": rows[-1]["mean_idf"], "reference": rows[0]["reference"]}

    def frequencies(self) -> DataFrame:
        """term, df: summed deltas."""
        return self._read("terms").groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    def terms(self) -> DataFrame:
        """term, df, idf: a negative idf becomes a share of the mean."""
        s = self.stats()
        return self.frequencies().withColumn("idf", self._idf(F.col("df"), s))

    @staticmethod
    def _raw(df: Column, n: int) -> Column:
        return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)

    def _idf(self, df: Column, s: dict) -> Column:
        raw = self._raw(df, s["n"])
        return F.when(raw < 0, F.lit(s["mean_idf"] * EPSILON)).otherwise(raw)

    def _alive(self, rows: DataFrame, stored: bool = True) -> DataFrame:
        """``rows`` (seg, shard, place) that no later segment removed; ``stored``: rows of forward tables, which stay where they are read."""
        dead = self._read("dead")
        if dead.isEmpty():
            return rows
        found = [r.withColumn("bits", F.coalesce("bits", F.lit(0))).filter(F.getbit("bits", F.pmod("place", F.lit(64))) == 0) for r in self._marked(rows, dead, "left", stored)]
        return functools.reduce(DataFrame.unionByName, found).drop("bits")

    def _marked(self, rows: DataFrame, dead: DataFrame, how: str, stored: bool = True) -> list[DataFrame]:
        """Ranges of ``rows`` (seg, shard, place) by shard, with the bits of their words in ``dead``."""
        bits = dead.groupBy(F.col("of").alias("seg"), "shard", "word").agg(F.bit_or("bits").alias("bits"))
        rows = rows.withColumn("word", F.floor(F.col("place") / 64).cast("int"))
        if not stored:
            return [rows.join(bits, ["seg", "shard", "word"], how).drop("word")]
        sizes = sorted(dead.groupBy("shard").count().collect())  # a row a task that wrote
        ends, n = [], 0
        for shard, more in sizes:
            if n and n + more > DEAD_WORDS:
                ends.append(shard)
                n = 0
            n += more
        out = []
        for low, high in zip([None, *ends], [*ends, None], strict=True):
            own = (F.lit(True) if low is None else F.col("shard") >= low) & (F.lit(True) if high is None else F.col("shard") < high)
            out.append(rows.filter(own).join(F.broadcast(bits.filter(own)), ["seg", "shard", "word"], how).drop("word"))
        return out

    # --- changing

    def create(self, chunks: DataFrame, text: str = "text", made: bool = True) -> Postings:
        """``made``: with its blocks; else the first search that reads blocks makes them."""
        return self._change(chunks, None, text, made)

    def add(self, chunks: DataFrame, text: str = "text") -> Postings:
        """Chunks are added; those known by key are replaced."""
        return self._change(chunks, chunks.select(self.key), text)

    def remove(self, keys: DataFrame) -> Postings:
        return self._change(None, keys.select(self.key), "text")

    def _change(self, chunks: DataFrame | None, gone: DataFrame | None, text: str, made: bool = True) -> Postings:
        spark, key = self.spark, self.key
        before = self.segments()
        seg = before[-1] + 1 if before else 0

        def write(df: DataFrame, table: str) -> DataFrame:
            path = f"{self.path}/{table}/seg={seg}"
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # a segment that was left half-written is written again
            return spark.read.schema(df.schema).parquet(path)

        kind = (chunks if chunks is not None else gone).schema[key].dataType.simpleString()
        kinds = "shard int, place int, terms array<string>, tfs array<int>, dl long"

        def deal(rows: DataFrame) -> DataFrame:
            counted = rows.select(F.col(key).alias("key"), self.tokenizer(F.col(text)).alias("t")).mapInArrow(_counted, f"key {kind}, {kinds}").withColumnRenamed("key", key)
            return counted.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")).sortWithinPartitions("bucket")

        if chunks is None:
            forward = write(spark.createDataFrame([], f"{key} {kind}, {kinds}, bucket int"), "forward")
        else:
            forward = write(deal(chunks), "forward")
            if not forward.groupBy(F.xxhash64(key)).count().filter("count > 1").isEmpty():  # keys that come again, if not by chance
                forward = write(deal(chunks.select(key, text).dropDuplicates([key])), "forward")
        stats = forward.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        old = self.stats() if before else {"n": 0, "total": 0, "reference": stats["total"] / stats["n"] if stats["n"] and stats["total"] else 1.0}
        level = F.least(F.ceil(impact(F.col("tf"), F.col("dl"), old["reference"]) * LEVELS / TOP), F.lit(LEVELS)).cast("int")

        def spread(rows: DataFrame) -> DataFrame:
            each = rows.select(key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(key, "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
            return each.withColumn("level", level)

        counts = forward.select("terms", "tfs", "dl").mapInArrow(_leveled(old["reference"]), "term string, level int, n long").groupBy("term", "level").agg(F.sum("n").alias("n"))
        went = spark.createDataFrame([], "of int, shard int, word int, bits long, n long, dl long")
        if gone is not None and before:
            keys = gone.distinct().withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int"))
            touched = [r[0] for r in keys.select("bucket").distinct().collect()]
            held = self._read("forward").filter(F.col("bucket").isin(touched))
            known = self._alive(held.select(key, "dl", "seg", "shard", "place").join(keys.select(key), key, "left_semi"), False)  # keys and places only
            bit = F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))")
            went = known.groupBy(F.col("seg").alias("of"), "shard", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"))
        went = write(went, "dead")
        lost = went.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        if lost["n"]:
            rows = functools.reduce(DataFrame.unionByName, self._marked(held, went, "inner"))
            less = spread(rows.filter(F.getbit("bits", F.pmod("place", F.lit(64))) == 1)).groupBy("term", "level").agg((-F.count(F.lit(1))).cast("long").alias("n"))
            counts = counts.unionByName(less).groupBy("term", "level").agg(F.sum("n").alias("n")).filter("n <> 0")
        change = write(counts, "terms")
        n = old["n"] + stats["n"] - lost["n"]
        every = change.select("term", "n") if not before else self._read("terms").select("term", "n").unionByName(change.select("term", "n"))
        mean_idf = every.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0").agg(F.avg(self._raw(F.col("df"), n))).first()[0] or 0.0
        row = [(int(stats["n"] - lost["n"]), int(stats["total"] - lost["total"]), float(mean_idf), float(old["reference"]), kind)]
        write(spark.createDataFrame(row, "n long, total long, mean_idf double, reference double, kind string").coalesce(1), "stats")
        if made:
            self._build()
        return self

    # --- searching

    def _asked(self, questions: DataFrame, text: str, s: dict) -> DataFrame:
        """query_id, term and weight (times the idf and the number of times it is asked)."""
        asked = questions.select("query_id", F.explode(self.tokenizer(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
        known = self._read("terms").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
        return asked.join(known, "term").select("query_id", "term", (F.col("qn") * self._idf(F.col("df"), s)).alias("w"))

    def scores(self, questions: DataFrame, text: str = "question") -> DataFrame:
        """query_id, key, score of every key that shares a term with a question."""
        if self._seen is None:
            return self.snapshot().scores(questions, text)
        s = self.stats()
        return self._products(self._asked(questions, text, s), s, None, True, 0)

    def _postings(self, chosen: DataFrame, s: dict) -> DataFrame:
        """query_id, term, key, part of the postings of the chosen (query_id, term, w, least: the lowest level to read)."""
        chosen = chosen.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int"))
        touched = [r[0] for r in chosen.select("bucket").distinct().collect()]
        near = self._read("blocks").filter(F.col("bucket").isin(touched)).select("seg", "bucket", "term", "level", "shard", "places", "tfs").join(chosen, ["bucket", "term"])
        each = near.filter("level >= least").select("query_id", "term", "w", "seg", "shard", F.explode(F.arrays_zip("places", "tfs")).alias("p")).select("query_id", "term", "w", "seg", "shard", F.col("p.places").alias("place"), F.col("p.tfs").alias("tf"))
        each = each.join(self._read("forward").select("seg", "shard", "place", self.key, "dl"), ["seg", "shard", "place"])
        return self._alive(each, False).select("query_id", "term", self.key, (F.col("w") * impact(F.col("tf"), F.col("dl"), s["mean"])).alias("part"))

    def search(self, questions: DataFrame, k: int, text: str = "question", keep_zero: bool = False, digits: int = 9) -> Found:
        """The best ``k`` keys of each question. Zero scores go unless kept; ties break by key."""
        if self._seen is None:
            return self.snapshot().search(questions, k, text, keep_zero, digits)
        key, s = self.key, self.stats()
        raised = max(1.0, s["mean"] / s["reference"])
        asked = checkpointed(self._asked(questions, text, s))
        if self._rows(asked) > PRODUCT_ROWS:
            return self._product(asked, s, k, keep_zero, digits)
        sizes = self._read("blocks").groupBy("term", "level").agg(F.count(F.lit(1)).alias("blocks"))
        levels = self._read("terms").select("term", "level", "n").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "level").agg(F.sum("n").alias("n")).filter("n > 0")
        levels = checkpointed(levels.join(sizes.join(asked.select("term").distinct(), "term", "left_semi"), ["term", "level"], "left").fillna(1, "blocks"))
        heads = asked.join(levels, "term")  # a question's terms times LEVELS at most

        def first(frame: pd.DataFrame) -> pd.DataFrame:
            """Of every term the highest levels with FIRST * k postings together; all of them where a weight is not positive."""
            whole = (frame["w"] <= 0).any()
            out = []
            for term, own in frame.groupby("term"):
                own = own.sort_values("level", ascending=False)
                enough = own["n"].cumsum() >= FIRST * k
                out.append((frame["query_id"].iloc[0], term, own["w"].iloc[0], 0 if whole or not enough.any() else int(own["level"][enough].iloc[0])))
            return pd.DataFrame(out, columns=["query_id", "term", "w", "least"])

        def best(frame: pd.DataFrame) -> pd.DataFrame:
            """The levels to read, such that a key in none of them stays below the k-th score so far: always on where most of the bound falls for a posting."""
            query, kth = frame["query_id"].iloc[0], frame["kth"].iloc[0]
            terms = []
            for term, own in frame.groupby("term"):
                own = own.sort_values("level", ascending=False)
                w = own["w"].iloc[0]
                edges = [lv * TOP / LEVELS * raised * w for lv in own["level"]] + [0.0]  # what a posting below can add at most
                terms.append([term, w, own["level"].tolist(), own["n"].tolist(), edges, 0])
            whole = pd.isna(kth) or (frame["w"] <= 0).any()
            if whole:
                for t in terms:
                    t[5] = len(t[2])
            while not whole and sum(t[4][t[5]] for t in terms) + SLACK >= kth:
                t = max((t for t in terms if t[5] < len(t[2])), key=lambda t: ((t[4][t[5]] - t[4][t[5] + 1]) / t[3][t[5]], t[0]), default=None)
                if t is None:
                    break
                t[5] += 1
            return pd.DataFrame([(query, term, w, ls[d - 1] if d else LEVELS + 1, edges[d]) for term, w, ls, _, edges, d in terms], columns=["query_id", "term", "w", "least", "left"])

        start = heads.groupBy("query_id").applyInPandas(first, "query_id long, term string, w double, least int")
        partial = self._postings(start, s).groupBy("query_id", key).agg(F.round(F.sum("part"), digits).alias("score"))
        kth = fusion.top(partial, ["query_id"], k, key=key).groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found")).select("query_id", F.when(F.col("found") == k, F.col("kth")).alias("kth"))
        chosen = checkpointed(heads.join(kth, "query_id", "left").groupBy("query_id").applyInPandas(best, "query_id long, term string, w double, least int, left double"))
        read = self._postings(chosen.select("query_id", "term", "w", "least"), s)
        seen = read.join(chosen.select("query_id", "term", "left"), ["query_id", "term"]).groupBy("query_id", key).agg(F.sum("part").alias("sure"), F.sum("left").alias("known"))
        rest = chosen.groupBy("query_id").agg(F.sum("left").alias("rest"))
        able = seen.join(rest, "query_id").join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("sure") + F.col("rest") - F.col("known") + SLACK >= F.col("kth")))
        whole = able.filter("rest = 0").select("query_id", key, F.col("sure").alias("score"))
        open_ = able.filter("rest > 0").select("query_id", key)
        fits = self._alive(self._read("forward").select(key, "terms", "tfs", "dl", "seg", "shard", "place")).join(open_, key).select("query_id", key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        exact = fits.select("query_id", key, F.col("p.terms").alias("term"), impact(F.col("p.tfs"), F.col("dl"), s["mean"]).alias("i")).join(asked, ["query_id", "term"])
        scored = whole.unionByName(exact.groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("i")).alias("score"))).withColumn("score", F.round("score", digits))
        hits = fusion.top(scored if keep_zero else scored.filter("score <> 0"), ["query_id"], k, key=key)
        used = heads.join(chosen.select("query_id", "term", "least"), ["query_id", "term"])
        work = used.groupBy("query_id").agg(F.sum(F.when(F.col("level") >= F.col("least"), F.col("blocks")).otherwise(0)).alias("blocks_read"), F.sum(F.when(F.col("level") < F.col("least"), F.col("blocks")).otherwise(0)).alias("blocks_skipped"))
        return Found(hits, lambda: work)

    def _rows(self, asked: DataFrame) -> int:
        """How many rows of a question and a posting of its terms there are."""
        return self.frequencies().join(asked, "term").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]

    def _product(self, asked: DataFrame, s: dict, k: int, keep_zero: bool, digits: int) -> Found:
        """The same hits for many questions of common terms."""
        hits = fusion.top(self._products(asked, s, k, keep_zero, digits), ["query_id"], k, key=self.key)

        def work() -> DataFrame:
            sizes = self._read("blocks").groupBy("term").agg(F.count(F.lit(1)).alias("blocks"))
            return asked.join(sizes, "term").groupBy("query_id").agg(F.sum("blocks").alias("blocks_read"), F.lit(0).cast("long").alias("blocks_skipped"))

        return Found(hits, work)

    def _products(self, asked: DataFrame, s: dict, k: int | None, keep_zero: bool, digits: int) -> DataFrame:
        """query_id, key, score: the forward rows times each block of questions, where they are read; the best ``k`` of every batch of rows, or every pair."""
        held = self._alive(self._read("forward").select(self.key, "terms", "tfs", "dl", "seg", "shard", "place")).select(F.col(self.key).alias("key"), "terms", "tfs", "dl")
        out = None
        for block in blocks.questions(asked.select("query_id", F.col("term").alias("place"), "w")):
            found = held.mapInArrow(_scorer(self.spark.sparkContext.broadcast(block), s["mean"], k, keep_zero, digits), f"query_id long, key {dict(held.dtypes)['key']}, score double")
            out = found if out is None else out.unionByName(found)
        return out.withColumnRenamed("key", self.key)

    def compact(self, path: str) -> Postings:
        """What counts now, as the one segment of a new index below ``path``."""
        words = F.flatten(F.transform(F.arrays_zip("terms", "tfs"), lambda p: F.array_repeat(p["terms"], p["tfs"])))
        alive = self._alive(self._read("forward").select(self.key, "terms", "tfs", "seg", "shard", "place")).select(self.key, words.alias("text"))
        Postings(self.spark, path, self.key, lambda c: c).create(alive)
        return Postings(self.spark, path, self.key, self.tokenizer)


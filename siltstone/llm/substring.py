"""Substring deduplication by suffix automata of reference shards.

Two operators stream documents through suffix automata for matching statistics and remove the maximal spans at or above the
length threshold. They differ in how a document's reference shard reaches it:

``remove_known`` broadcasts automata of a bounded reference, cut into shards.

``remove_repeats`` takes all earlier documents as the reference. Their automata have no bound to broadcast, and streaming every
document past every shard grows with the square of the corpus; so every batch of documents gets a shard of its own, cut to what
can match there:
1. documents are dealt once into batches of neighbouring ids, of bounded bytes; batches are ordered as ids are;
2. a batch sends the hashes of its distinct windows, packed by hash range (a hot passage costs one hash a batch, however many
   documents hold it); a range tells, for each batch that has a window too, the last batch before it which of its windows it wants;
3. that batch sends the passages themselves, each once: they are the reference shard, no larger than the windows it was asked for;
4. a batch builds the suffix automaton of the passages that it got and streams its whole documents through it in the order of
   their ids; passages of its own that recur in it join the automaton as soon as their id is done. Where a matching
   statistic reaches the window, the words that it covers go. Hashes choose what is sent; only equal words are removed.
Every group is one batch or one hash range. A batch is asked for a passage by one other batch, however many hold it.

Defined results: null and empty texts have no words (digest of the empty string); rows of one doc_id are judged apart but never
against each other, also where one id (or null) fills many batches; null ids come first; repeated rows are kept; an empty table
gives no rows; other columns are ignored. Two windows of one batch with the same 64-bit hash could hide each other's repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.automata import SuffixAutomaton
from siltstone.llm.common import table
from siltstone.llm.ordering import LEAST, UNIT, buckets, tie_of, weight

WINDOW = 13
#: Units of weight of a batch, windows of a hash range, bytes of a partition of texts (all about).
BATCH, RANGE_WINDOWS, PARTITION_BYTES = 1024, 1_000_000, 24 << 20
SHARD_WORDS = 200_000
#: Bytes that are hashed at once.
PIECE = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_space = re.compile(rb"[\x20\x09-\x0d]")
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse, as long as any piece so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base)]) for base in (_R, _R_INVERSE))
        return self.up, self.down


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray) -> np.ndarray:
    space = np.r_[True, _SPACES[data], True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers.get(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _R_INVERSE)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than space, tab, line feed, VT, FF, CR), piece by piece between words."""
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        cut = _space.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        found.append(_hashed(np.frombuffer(raw, np.uint8, end - at, at)))
        at = end
    return np.concatenate(found)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(window):
        out = out * _R + words[j : j + n]
    return _mix(out)


def distinct_windows(frame: pd.DataFrame, window: int) -> np.ndarray:
    """The ascending distinct window hashes of some documents."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(window_hashes(word_hashes(t.encode("utf-8", "surrogatepass")), window) for t in frame["text"])]))


class Batch:
    """The windows of some documents, in ascending order of ids."""

    def __init__(self, frame: pd.DataFrame, window: int):
        self.frame = frame.sort_values(["k", "tie", "text"], kind="stable")
        self.texts = [t.encode("utf-8", "surrogatepass") for t in self.frame["text"]]
        self.window = window
        hashes = [word_hashes(t) for t in self.texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        windows = [window_hashes(h, window) for h in hashes]
        counts = np.array([len(w) for w in windows], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *windows])
        #: Of each window its document and its place there; of each document its first window.
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.place = np.arange(len(every)) - self.begin[self.doc]
        self.distinct, self.first, self.which = np.unique(every, return_index=True, return_inverse=True)
        self.ids = self.frame["k"].to_numpy(np.int64)

    def passages(self, chosen: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first word, end) of the stretches that the chosen windows (ascending) cover."""
        if not len(chosen):
            return
        doc, place = self.doc[chosen], self.place[chosen]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + self.window)])
        last = np.r_[new[1:], len(chosen)] - 1
        yield from zip(doc[new].tolist(), place[new].tolist(), (place[last] + self.window).tolist(), strict=True)

    def texts_of(self, chosen: np.ndarray) -> list[bytes]:
        """The words of the passages of the chosen windows, each text once."""
        held, words, out = -1, [], {}
        for doc, a, b in self.passages(chosen):
            if doc != held:
                held, words = doc, self.texts[doc].split()
            out[b" ".join(words[a:b])] = None
        return list(out)


def covered(ends: list[int], n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that ends at one of the places."""
    change = np.zeros(n + 1, np.int64)
    at = np.asarray(ends, np.int64)
    np.add.at(change, at - window + 1, 1)
    np.add.at(change, at + 1, -1)
    return np.cumsum(change)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (or kept_sha256): the words that no window shared with a smaller doc_id covers."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", tie_of(F.col("text")))
    weighed = rows.withColumn("weight", weight(F.col("text")))
    units = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    bits = max(4, int(np.ceil(np.log2(max(1, units * UNIT / 6 / RANGE_WINDOWS)))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units * UNIT // PARTITION_BYTES))
    dealt = buckets(weighed, BATCH, isolate=True).assign(rows).select("doc_id", "k", "tie", "text", F.col("bucket").alias("batch"), "order").repartition(parts, "batch")
    shift = np.uint64(64 - bits)

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        found = distinct_windows(frame, window)
        batch, order = int(frame["batch"].iloc[0]), int(frame["order"].iloc[0])
        if not len(found):
            return pd.DataFrame([], columns=["range", "batch", "order", "hashes"])
        part = found >> shift
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])  # the ranges that occur: no more than there are windows
        out = [(int(part[a]), batch, order, found[a:b].astype("<u8").tobytes()) for a, b in zip(new, [*new[1:], len(part)], strict=True)]
        return pd.DataFrame(out, columns=["range", "batch", "order", "hashes"])

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "batch"], kind="stable")
        own = [np.frombuffer(h, "<u8") for h in frame["hashes"]]
        sizes = [len(h) for h in own]
        every = np.concatenate(own)
        sorting = np.argsort(every, kind="stable")  # equal hashes stay in the order of their batches
        batch = np.repeat(frame["batch"].to_numpy(np.int64), sizes)[sorting]
        order = np.repeat(frame["order"].to_numpy(np.int64), sizes)[sorting]
        place = np.concatenate([np.arange(n) for n in sizes])[sorting]
        every = every[sorting]
        run = np.maximum.accumulate(np.where(np.r_[True, (every[1:] != every[:-1]) | (order[1:] != order[:-1])], np.arange(len(every)), 0))
        before = np.maximum(run - 1, 0)  # the last one of a smaller order, if the hash is the same
        asks = (run > 0) & (every[before] == every)
        if not asks.any():
            return pd.DataFrame([], columns=["batch", "range", "wants", "asked"])
        origin, asked, wants = batch[before[asks]], place[before[asks]], batch[asks]
        grouped = np.argsort(origin, kind="stable")
        origin, asked, wants = origin[grouped], asked[grouped], wants[grouped]
        new = np.flatnonzero(np.r_[True, origin[1:] != origin[:-1]])
        out = [(int(origin[a]), int(frame["range"].iloc[0]), wants[a:b].astype("<i8").tobytes(), asked[a:b].astype("<i4").tobytes()) for a, b in zip(new, [*new[1:], len(origin)], strict=True)]
        return pd.DataFrame(out, columns=["batch", "range", "wants", "asked"])

    def serve(frame: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(asks):
            return pd.DataFrame([], columns=["batch", "passages"])
        own = Batch(frame, window)
        cuts = np.searchsorted(own.distinct >> shift, asks["range"].to_numpy(np.uint64))
        wants = np.concatenate([np.frombuffer(w, "<i8") for w in asks["wants"]])
        chosen = own.first[np.concatenate([np.frombuffer(p, "<i4") + cut for cut, p in zip(cuts.tolist(), asks["asked"], strict=True)])]
        grouped = np.lexsort((chosen, wants))
        wants, chosen = wants[grouped], chosen[grouped]
        new = np.flatnonzero(np.r_[True, wants[1:] != wants[:-1]])
        out = [(int(wants[a]), b"\n".join(own.texts_of(chosen[a:b]))) for a, b in zip(new, [*new[1:], len(wants)], strict=True)]
        return pd.DataFrame(out, columns=["batch", "passages"])

    def drop(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "n_words": [], "n_removed": [], last: []})
        own = Batch(frame, window)
        shard = SuffixAutomaton()
        for passage in dict.fromkeys(p for row in got["passages"] for p in bytes(row).split(b"\n")):
            shard.extend(passage.split())
        owner = own.ids[own.doc]
        again = np.zeros(len(own.distinct), bool)
        again[own.which[owner > owner[own.first][own.which]]] = True
        recurring = np.sort(own.first[again])  # first windows of passages that a greater id of the batch repeats
        waiting: list[list[bytes]] = []
        kept, removed = [], []
        for i, text in enumerate(own.texts):
            if i and own.ids[i] != own.ids[i - 1]:
                for passage in waiting:
                    shard.extend(passage)
                waiting = []
            words = text.split()
            ends = shard.reached(words, window)
            gone = covered(ends, len(words), window) if ends else None
            a, b = np.searchsorted(recurring, own.begin[i : i + 2])
            waiting += [words[x:y] for _, x, y in own.passages(recurring[a:b])]
            removed.append(int(gone.sum()) if ends else 0)
            if ends:
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(words)
            kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode("utf-8", "surrogatepass"))
        ids = own.frame["doc_id"]
        ids = pd.Series(ids.to_numpy(), dtype="Float64" if ids.dtype.kind == "f" else "Int64").astype("Int64")
        return pd.DataFrame({"doc_id": ids, "n_words": own.sizes, "n_removed": removed, last: kept})

    last = "kept_sha256" if digests else "kept"
    batches = dealt.groupBy("batch")
    asks = batches.applyInPandas(send, "range int, batch long, order long, hashes binary").groupBy("range").applyInPandas(match, "batch long, range int, wants binary, asked binary")
    shards = batches.cogroup(asks.groupBy("batch")).applyInPandas(serve, "batch long, passages binary")
    return batches.cogroup(shards.groupBy("batch")).applyInPandas(drop, f"doc_id long, n_words long, n_removed long, {last} string")


def remove_known(docs: DataFrame, reference: list[str], window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: spans of at least ``window`` words that ``reference`` (bounded, on the driver) holds go.

    Shards of about ``shard_words`` words overlap by nothing: a text is never split, so no match is lost.
    """
    spark = docs.sparkSession
    shards, held = [SuffixAutomaton()], 0
    for text in reference:
        words = text.encode("utf-8", "surrogatepass").split()
        if held and held + len(words) > shard_words:
            shards.append(SuffixAutomaton())
            held = 0
        shards[-1].extend(words)
        held += len(words)
    sent = [spark.sparkContext.broadcast(s) for s in shards]
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words), bool)
                for automaton in sent:
                    gone |= covered(automaton.value.reached(words, window), len(words), window)
                rows.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass")))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(columns, list(kind)[1:], strict=True))], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, i AS pos, array_to_string(words[i : i + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), f AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY gram) AS least FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM f WHERE least < doc_id
), k AS (
  SELECT w.doc_id, w.words, coalesce(list(c.pos) FILTER (c.pos IS NOT NULL), []) AS gone FROM w LEFT JOIN c USING (doc_id) GROUP BY ALL
)
SELECT doc_id, len(words) AS n_words, len(gone) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM k
"""

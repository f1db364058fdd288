"""Periodic runs of words by bit-parallel lags.

The ids of a document's words are laid out as bit planes: big integers, one bit a word. For a lag q every plane is compared with
itself shifted by q (exclusive or), and the mismatches of the planes are joined (or). A run of period q and length n is a stretch of n - q
places without a mismatch; and-ing the agreement with itself, shifted by a doubled distance each time, leaves the places where a stretch of the
needed length begins, and with that most lags are done.

Lags below ``DENSE`` are all tried. From there on a lag q in [2g, 4g) is tried only if it can have a run: the run's stretch of q places or more
holds a window of g words that begins at a multiple of g, and that window recurs q words on. Windows of g words are told apart exactly,
by doubling (two windows are equal if their halves are), and only words whose window recurs go on to the next size, so a document without long
repeats is done after a few sizes. Two windows that lie in the same run of a period that divides q are passed over: a stretch around them has that
smaller period. So are windows in two runs of one small period that do not touch, unless these begin or end q words apart: a stretch around
them would end with the first run, before it is long enough. This leaves a number of pairs in proportion to the words at each size.

A run of period q counts if no smaller period fits, which, as it spans two periods, only divisors of q can.

Defined results: null and empty texts have no words and no runs; repeated rows and null ids are kept, each row by itself; an empty table gives no
rows; other columns are ignored. Nothing is shuffled and every row is read whole: a text needs about 40 bytes a word beside itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table

LEAST_LENGTH, LEAST_PERIODS = 12, 2
#: All lags below are tried; a power of two, at least LEAST_LENGTH.
DENSE = 32
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SPACE = " \t\n\x0b\f\r"


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit planes of the ids: bit i of plane b is bit b of the i-th id."""
    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def mismatches(planes: list[int], lag: int) -> int:
    """Bit i is set where word i and word i + lag differ (places from n - lag on say nothing)."""
    out = 0
    for p in planes:
        out |= p ^ (p >> lag)
    return out


def stretches(agree: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal stretches of at least ``least`` set bits, in ascending order."""
    left, have = agree, 1
    while left and have < least:
        step = min(have, least - have)
        left &= left >> step
        have += step
    if left:
        bits = np.unpackbits(np.frombuffer(agree.to_bytes(agree.bit_length() // 8 + 2, "little"), np.uint8), bitorder="little")  # the last bit is clear
        edges = np.flatnonzero(np.diff(bits, prepend=0))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)


def primes_of(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def primitive(word: np.ndarray) -> bool:
    """Whether the word is no repetition of a shorter one."""
    n = len(word)
    return not any(np.array_equal(word[n // p :], word[: n - n // p]) for p in primes_of(n))


def _runs_at(ids: np.ndarray, planes: list[int], lag: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, lag) of the runs whose smallest period is the lag."""
    n = len(ids)
    agree = ~mismatches(planes, lag) & ((1 << (n - lag)) - 1)
    for start, end in stretches(agree, max(LEAST_LENGTH, LEAST_PERIODS * lag) - lag):
        if primitive(ids[start : start + lag]):
            yield start, end - start + lag, lag


def _lags(place: np.ndarray, kind: np.ndarray, size: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The lags in [2 size, 4 size) at which some window that begins at a multiple of ``size`` recurs, but for those that lie in one run of a period that divides the lag.

    ``place`` (ascending) and ``kind`` are the windows that recur.
    """
    top = int(place[-1]) + 1 + 4 * size
    order = np.lexsort((place, kind))
    key = kind[order].astype(np.int64) * top + place[order]
    at = np.flatnonzero(place % size == 0)
    base = kind[at].astype(np.int64) * top + place[at]
    a, b = np.searchsorted(key, base + 2 * size), np.searchsorted(key, base + 4 * size)
    many = b - a
    if not many.sum():
        return np.zeros(0, np.int64)
    i = np.repeat(place[at], many)
    j = place[order[np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]]
    lag = j - i
    held = np.array(found, np.int64).reshape(-1, 3)
    held = held[(held[:, 1] >= size) & (held[:, 2] <= 2 * size)]
    for period in np.unique(held[:, 2]).tolist():
        own = held[held[:, 2] == period]  # ascending by start and by end; two of them share less than a period
        start, end = own[:, 0], own[:, 0] + own[:, 1]
        x = np.searchsorted(start, i, "right") - 1
        same = (x >= 0) & (j + size <= end[x]) & (lag % period == 0)
        if period <= size:
            y = np.searchsorted(start, j, "right") - 1
            within = (x >= 0) & (i + size <= end[x]) & (j + size <= end[y])
            same |= within & (start[y] > end[x]) & (lag != start[y] - start[x]) & (lag != end[y] - end[x])
        i, j, lag = i[~same], j[~same], lag[~same]
    return np.unique(lag)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, ascending by start, then period."""
    n = len(words)
    if n < LEAST_LENGTH:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) > n - LEAST_LENGTH // LEAST_PERIODS:  # a run repeats that many words at least
        return []
    planes = planes_of(ids)
    found = [r for lag in range(1, min(DENSE, n // 2 + 1)) for r in _runs_at(ids, planes, lag)]
    size, place, kind = 1, np.arange(n), ids
    while size * 4 <= n:
        if 2 * size >= DENSE:
            for lag in _lags(place, kind, size, found).tolist():
                if lag <= n // 2:
                    found += _runs_at(ids, planes, lag)
        # windows of twice the size: those whose halves both recur, if the pair does
        follow = np.searchsorted(place, place + size)
        there = follow < len(place)
        there[there] = place[follow[there]] == place[there] + size
        if not there.any():
            break
        pair = kind[there].astype(np.int64) * (int(kind.max()) + 1) + kind[follow[there]]
        _, kind, count = np.unique(pair, return_inverse=True, return_counts=True)
        place, again = place[there], count[kind] > 1
        place, kind, size = place[again], kind[again], 2 * size
        if not len(place):
            break
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    if runs:
        start, length, period = np.array(runs, np.int64).T
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] > 0


def periodic_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, n_words, runs and collapsed (the words that no run repeats, joined by one space) for every row of ``docs``."""
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(item)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, every, texts = [], [], []
            for value in batch.column("text"):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of(words)
                sizes.append(len(words))
                every.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(compress(words, (~repeated_words(len(words), runs)).tolist()) if runs else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(every, pa.list_(item)), pa.array(texts, pa.string())], schema=kind)

    return docs.select("doc_id", (F.col("text") if text is None else text).alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text, for about a tenth of the ids with a period set into its words from some place on (see the query's contract)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def spelled(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        use = lambda s: F.transform(s["words"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["words"], (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))))
        return F.transform(F.array(F.struct(words.alias("words"), a.alias("a"), p.alias("p"))), lambda s: F.array_join(use(s), " "))[0]

    words = F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    chosen = (F.pmod(h, F.lit(10)) == 0) & (F.btrim(text, F.lit(SPACE)) != "")
    return F.when(chosen, F.transform(F.array(words), spelled)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, planted(F.col("text"), F.col("doc_id")))
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))  # by start, then period
    every = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

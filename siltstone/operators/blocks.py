"""The best rows for each question of a batch: blockwise products, cut to the best where they are made.

Questions and rows are sparse vectors (place, w). A block of questions, bounded in questions and places, is sent to the tasks as a
matrix; rows are gathered by key, only with places that a question has, and never paired with questions in a shuffle: each task
yields its own best ``k`` for every question, and the best of those are the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import fusion

#: Questions of a block, and their places.
QUESTIONS, PLACES = 256, 20_000
#: Stands for a weight of zero, so that a shared place still makes a pair.
NOTHING = 1e-300
#: Numbers of one product of rows and questions, and places that are multiplied as a dense block.
PRODUCT, COMMON = 4 << 20, 256


def top(asked: DataFrame, held: DataFrame, key: str, k: int, keep_zero: bool = True, digits: int = 9) -> DataFrame:
    """query_id, key, score, rank: the ``k`` largest products of rows that share a place with a question.

    asked: query_id, place, w. held: key, place, w. Scores are rounded, ties break by key; zero scores go unless kept.
    """
    kinds = dict(held.dtypes)
    out = None
    for queries, places, matrix in questions(asked):
        vocabulary = asked.sparkSession.createDataFrame([(p, i) for i, p in enumerate(places)], f"place {kinds['place']}, _i int")
        near = held.join(F.broadcast(vocabulary), "place").groupBy(key).agg(F.collect_list(F.struct("_i", "w")).alias("_v")).select(key, "_v._i", "_v.w")  # a row's places that a question has
        found = near.mapInPandas(_scorer(asked.sparkSession.sparkContext.broadcast((queries, matrix)), key, k, keep_zero, digits), f"query_id long, {key} {kinds[key]}, score double")
        out = found if out is None else out.unionByName(found)
    return fusion.top(out.withColumn("score", F.round("score", digits)), ["query_id"], k, key=key)


def top_rows(asked: DataFrame, rows: DataFrame, key: str, k: int, keep_zero: bool = True, digits: int = 9) -> DataFrame:
    """As ``top``, of rows whose places (numbers from 0) and weights are arrays (key, idx, w): multiplied where they are read, without an exchange."""
    kind = dict(rows.dtypes)[key]
    out = None
    for queries, places, matrix in questions(asked):
        sent = asked.sparkSession.sparkContext.broadcast((queries, matrix, np.array(places, np.int64)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            queries, matrix, places = sent.value
            known = np.full(int(places.max(initial=-1)) + 2, -1)
            known[places] = np.arange(len(places))
            best = Best(queries, k)
            for batch in batches:
                row = np.repeat(np.arange(len(batch)), [len(x) for x in batch["idx"]])
                at = known[np.minimum(np.concatenate([np.zeros(0, np.int64), *batch["idx"]]).astype(np.int64), len(known) - 1)]
                w = np.concatenate([np.zeros(0), *batch["w"]])
                _count(best, batch[key].to_numpy(), at[at >= 0], w[at >= 0], np.bincount(row[at >= 0], minlength=len(batch)), matrix, keep_zero, digits)
            if best.n:
                yield pd.DataFrame(dict(zip(("query_id", key, "score"), best.rows(), strict=True)))

        found = rows.select(key, "idx", "w").mapInPandas(run, f"query_id long, {key} {kind}, score double")
        out = found if out is None else out.unionByName(found)
    return fusion.top(out, ["query_id"], k, key=key)


def questions(asked: DataFrame) -> Iterator[tuple[list, list, np.ndarray]]:
    """Blocks of questions (query_id, place, w): their ids, their places, and the weights of places by questions."""
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("q")).first()
    blocks = max(1, -(-sizes["q"] // QUESTIONS), -(-sizes["n"] // PLACES))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "place", "w").collect()  # about PLACES rows
        queries = sorted({r["query_id"] for r in rows})
        places = sorted({r["place"] for r in rows})
        q_at, p_at = ({x: i for i, x in enumerate(xs)} for xs in (queries, places))
        matrix = np.zeros((len(places), len(queries)))
        for r in rows:
            matrix[p_at[r["place"]], q_at[r["query_id"]]] = r["w"] or NOTHING
        yield queries, places, matrix


def products(at: np.ndarray, w: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of weights (their places and weights one after the other) times the matrix: places that many questions have as a dense product, others by the questions that have them."""
    n_asked = matrix.shape[1]
    out = np.zeros((len(sizes), n_asked))
    place, query = np.nonzero(matrix)
    asks = np.bincount(place, minlength=len(matrix))
    starts, weights = np.cumsum(asks) - asks, matrix[place, query]
    common = np.sort(np.argsort(-asks, kind="stable")[:COMMON])
    common = common[asks[common] > 1]
    column = np.full(len(matrix), -1)
    column[common] = np.arange(len(common))
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes) and n_asked:  # as many rows as fit into PRODUCT numbers, one at least
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + max(1, PRODUCT // n_asked), "right")))
        a, b, n = (ends[first - 1] if first else 0), ends[last - 1], last - first
        row, own = np.repeat(np.arange(n), sizes[first:last]), column[at[a:b]]
        held = own >= 0
        if held.any():
            out[first:last] = np.bincount(row[held] * len(common) + own[held], weights=w[a:b][held], minlength=n * len(common)).reshape(n, -1) @ matrix[common]
        rare = np.flatnonzero(~held)
        times = asks[at[a:b][rare]]
        if times.sum():
            which = np.repeat(rare, times)
            found = np.repeat(starts[at[a:b][rare]] - (np.cumsum(times) - times), times) + np.arange(len(which))
            out[first:last] += np.bincount(row[which] * n_asked + query[found], weights=w[a:b][which] * weights[found], minlength=n * n_asked).reshape(n, -1)
        first = last
    return out


class Best:
    """The best ``k`` keys of each question among all rows that a task has seen; ties go to the lesser key. Rows below a question's k-th score so far are passed over together."""

    def __init__(self, queries: list, k: int):
        self.queries, self.k, self.kth = np.asarray(queries, np.int64), k, np.full(len(queries), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def open(self, scores: np.ndarray) -> np.ndarray:
        """Which pairs of a row and a question can still count."""
        return scores >= self.kth

    def add(self, keys: np.ndarray, scores: np.ndarray, open_: np.ndarray) -> None:
        k, n = self.k, len(scores)
        if n > k and np.count_nonzero(open_) > 4 * k * len(self.queries):
            open_ = open_ & (scores >= np.partition(np.where(open_, scores, -np.inf), n - k, axis=0)[n - k])
        i, j = np.nonzero(open_)
        if len(i):
            self.parts.append((j, scores[i, j], keys[i]))
            self.n += len(i)
            if self.n > 4 * k * len(self.queries):
                self._cut()

    def _cut(self) -> None:
        j, score, keys = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((keys.astype(str) if keys.dtype == object else keys, -score, j))
        j, score, keys = j[order], score[order], keys[order]
        place = np.arange(len(j)) - np.searchsorted(j, j)
        self.kth[j[place == self.k - 1]] = score[place == self.k - 1]
        self.parts = [tuple(x[place < self.k] for x in (j, score, keys))]
        self.n = len(self.parts[0][0])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, keys and scores."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self._cut()
        j, score, keys = self.parts[0]
        return self.queries[j], keys, score


def _scorer(sent, key: str, k: int, keep_zero: bool, digits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, matrix = sent.value
        best = Best(queries, k)
        for batch in batches:
            sizes = np.array([len(x) for x in batch["_i"]], np.int64)
            at = np.concatenate([np.zeros(0, np.int64), *batch["_i"]]).astype(np.int64)
            _count(best, batch[key].to_numpy(), at, np.concatenate([np.zeros(0), *batch["w"]]).astype(np.float64), sizes, matrix, keep_zero, digits)
        if best.n:
            yield pd.DataFrame(dict(zip(("query_id", key, "score"), best.rows(), strict=True)))

    return run


def _count(best: Best, ids: np.ndarray, at: np.ndarray, w: np.ndarray, sizes: np.ndarray, matrix: np.ndarray, keep_zero: bool, digits: int) -> None:
    """Rows of a batch to the best: where zero scores are kept, those that share a place."""
    scores = np.round(products(at, w, sizes, matrix), digits)
    open_ = best.open(scores)
    zero = open_ & (scores == 0)
    if zero.any():
        open_ &= ~zero if not keep_zero else ~zero | (products(at, np.ones(len(at)), sizes, (matrix != 0).astype(np.float64)) > 0)
    best.add(ids, scores, open_)

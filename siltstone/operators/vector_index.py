"""A stored index of unit vectors, searched exactly by visiting clusters in the order of their bounds.

Vectors are written where they are read, without an exchange, sorted by cluster, so that Parquet's statistics skip other clusters: rows of the key, the places
that are not zero and their weights (no places where a vector is dense), and whatever columns a filter may ask for. Centroids come from a bounded sample; every vector then goes to the nearest one, and
a cluster's reach is the least cosine of a member to its centroid. By the triangle inequality of angles no member is nearer to a
question than the angle to the centroid less the reach. A block of questions visits the clusters in the order of that bound, a
few more each round, until no cluster left can hold one of the best ``k``. The texts are never read.

Where vectors have no clusters (hash embeddings of unlike texts are nearly orthogonal), bounds exclude little and most clusters are read. Such an index is made
``flat``: all vectors are one cluster, so that none is compared with centroids, whose number grows with the table, and a search reads each vector once.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import blocks, fusion, tables
from siltstone.session import checkpointed

#: Vectors that centroids are fitted on, rounds of fitting, and the most centroids (of at most CENTROID_FLOATS numbers together).
SAMPLE, ROUNDS, MOST_CLUSTERS, CENTROID_FLOATS = 8192, 6, 1024, 4 << 20
#: Vectors of a cluster, about, where MOST_CLUSTERS allows.
CLUSTER = 2048
#: Clusters that a question visits in the first round; each round visits four times as many.
FIRST = 2
#: Bytes of a row group and rows of a page: what is skipped together.
GROUP, PAGE = 8 << 20, 512
#: Room for rounding: a bound that is so near to the k-th score still counts.
SLACK = 1e-7


@dataclass(frozen=True)
class Found:
    """hits (query_id, key, score, rank), and for each block of questions how many clusters were read, of how many."""

    hits: DataFrame
    read: list[int]
    clusters: int


def _dense(idx, w, dim: int) -> np.ndarray:
    """Rows as a dense block."""
    out = np.zeros((len(w), dim))
    sizes = [len(x) for x in w]
    if not sum(sizes):
        return out
    every = np.concatenate(list(w)).astype(np.float64)
    at = np.concatenate([np.arange(len(x)) if i is None else np.asarray(i, np.int64) for i, x in zip(idx, w, strict=True)])
    out[np.repeat(np.arange(len(w)), sizes), at] = every
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(n > 0, n, 1.0)


def _units(w) -> list[np.ndarray]:
    """Weights of rows made unit before they are spread."""
    sizes = [len(x) for x in w]
    if not sum(sizes):
        return list(w)
    every, row = np.concatenate(list(w)).astype(np.float64), np.repeat(np.arange(len(sizes)), sizes)
    n = np.sqrt(np.bincount(row, weights=every * every, minlength=len(sizes)))
    return np.split(every / np.where(n > 0, n, 1.0)[row], np.cumsum(sizes)[:-1])


def _centroids(sample: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means over a sample: means of the nearest, made unit, a few times."""
    rng = np.random.default_rng(seed)
    found = sample[np.sort(rng.choice(len(sample), min(k, len(sample)), replace=False))]
    for _ in range(ROUNDS):
        near = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        held = np.linalg.norm(sums, axis=1) > 0
        found = np.where(held[:, None], _unit(sums), found)
    return found


def create(vectors: DataFrame, path: str, key: str, dim: int, *carried: str, clusters: int | None = None, flat: bool = False) -> VectorIndex:
    """Writes the index of ``vectors`` (key, idx, w, carried columns): idx null for dense rows. Weights are kept as given (counts take little room) and made unit when read."""
    spark = vectors.sparkSession
    rows = vectors.select(key, "idx", "w", *carried)
    if flat:
        rows.withColumn("cluster", F.lit(0)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
        n = spark.read.parquet(f"{path}/vectors").count()
        return _described(spark, path, key, dim, [(0, [0.0] * dim, -1.0, n)] if n else [])
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/given")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/given")
    n = rows.count()
    k = clusters or max(1, min(MOST_CLUSTERS, CENTROID_FLOATS // dim, -(-n // CLUSTER)))
    near = rows if n <= SAMPLE else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))
    taken = near.select("idx", "w").limit(2 * SAMPLE).toPandas()  # a bounded sample
    sample = _unit(_dense(taken["idx"], taken["w"], dim)) if len(taken) else np.zeros((1, dim))
    centres = _centroids(sample, k)
    sent = spark.sparkContext.broadcast(centres)  # CENTROID_FLOATS numbers at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit = _unit(_dense(b["idx"], b["w"], dim))
            cosines = unit @ sent.value.T
            b["cluster"] = cosines.argmax(axis=1).astype(np.int32)
            b["cosine"] = cosines.max(axis=1)
            yield b

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "w")
    placed = rows.mapInPandas(assign, f"{kinds}, w array<double>, cluster int, cosine double")
    sorted_ = placed.sortWithinPartitions("cluster")
    sorted_.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP).option("parquet.page.row.count.limit", PAGE).parquet(f"{path}/vectors")
    tables.delete(spark, f"{path}/given")
    reach = {r["cluster"]: (r["reach"], r["n"]) for r in spark.read.parquet(f"{path}/vectors").groupBy("cluster").agg(F.min("cosine").alias("reach"), F.count(F.lit(1)).alias("n")).collect()} if n else {}  # a row a cluster
    meta = [(int(c), centres[c].tolist(), float(reach[c][0]), int(reach[c][1])) for c in sorted(reach)]
    return _described(spark, path, key, dim, meta)


def _described(spark: SparkSession, path: str, key: str, dim: int, meta: list) -> VectorIndex:
    spark.createDataFrame(meta, "cluster int, centroid array<double>, reach double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")
    spark.createDataFrame([(json.dumps({"key": key, "dim": dim}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return VectorIndex(spark, path)


def _among(numbers: list[int]) -> Column:
    """Whether the cluster is one of ``numbers`` (rising): ranges, which Parquet's statistics can answer for any number of them."""
    ends = [i for i in range(len(numbers)) if i + 1 == len(numbers) or numbers[i + 1] != numbers[i] + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return functools.reduce(Column.__or__, [(F.col("cluster") >= numbers[a]) & (F.col("cluster") <= numbers[b]) for a, b in zip(starts, ends, strict=True)])


class VectorIndex:
    """An index that ``create`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        self.key, self.dim = meta["key"], meta["dim"]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, asked: DataFrame, k: int, where: Column | None = None, digits: int = 9, shared: bool = False) -> Found:
        """The ``k`` nearest of each question (query_id, idx, w) by cosine, among rows that fit ``where`` and, if ``shared``, have a place in common. Ties break by key."""
        meta = self.spark.read.parquet(f"{self.path}/clusters").orderBy("cluster").collect()  # MOST_CLUSTERS rows at most
        n_asked = asked.select("query_id").count()
        n_blocks = max(1, -(-n_asked // blocks.QUESTIONS))
        kind = "long" if not meta else dict(self.rows().dtypes)[self.key]
        out, read = None, []
        for b in range(n_blocks):
            own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).select("query_id", "idx", "w").toPandas()  # about QUESTIONS rows
            if not len(own) or not meta:
                continue
            own = own.sort_values("query_id", kind="stable")
            found, n = self._visit(own, meta, k, where, digits, kind, shared)
            out = found if out is None else out.unionByName(found)
            read.append(n)
        if out is None:
            out = self.spark.createDataFrame([], f"query_id long, {self.key} {kind}, score double")
        return Found(fusion.top(out, ["query_id"], k, key=self.key), read, len(meta))

    def _visit(self, asked: pd.DataFrame, meta: list, k: int, where: Column | None, digits: int, kind: str, shared: bool) -> tuple[DataFrame, int]:
        queries = _unit(_dense(asked["idx"], asked["w"], self.dim))
        ids = [int(q) for q in asked["query_id"]]
        cosine = np.clip(queries @ np.array([m["centroid"] for m in meta]).T, -1.0, 1.0)
        angle = np.arccos(cosine) - np.arccos(np.clip([m["reach"] for m in meta], -1.0, 1.0))[None, :]
        bound = np.cos(np.maximum(angle, 0.0))
        order = np.argsort(-bound, axis=1, kind="stable")
        sent = self.spark.sparkContext.broadcast((ids, np.ascontiguousarray(queries.T)))
        visited: set[int] = set()
        least = np.full(len(ids), -np.inf)
        parts, step = None, FIRST
        while True:
            wanted: set[int] = set()
            for q in range(len(ids)):
                open_ = [c for c in order[q] if bound[q, c] + SLACK >= least[q] and int(c) not in visited]
                wanted |= {int(c) for c in open_[:step]}
            if not wanted:
                break
            visited |= wanted
            rows = self.rows().filter(_among([meta[c]["cluster"] for c in sorted(wanted)]))
            if where is not None:
                rows = rows.filter(where)
            scored = checkpointed(fusion.top(rows.select(self.key, "idx", "w").mapInPandas(_scorer(sent, self.key, self.dim, k, digits, shared), f"query_id long, {self.key} {kind}, score double"), ["query_id"], k, key=self.key).drop("rank"))
            parts = scored if parts is None else parts.unionByName(scored)
            kth = {r["query_id"]: r["s"] for r in fusion.top(parts, ["query_id"], k, key=self.key).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).collect()}
            least = np.array([kth.get(q, -np.inf) for q in ids])
            step *= 4
        return parts, len(visited)


def _scorer(sent, key: str, dim: int, k: int, digits: int, shared: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = sent.value
        best = blocks.Best(ids, k)
        for batch in batches:
            rows = _dense(batch["idx"], _units(batch["w"]), dim)
            scores = np.round(rows @ matrix, digits)
            open_ = best.open(scores)
            if shared and (open_ & (scores == 0)).any():  # a product that is not zero says that a place is shared
                open_ &= (rows != 0).astype(np.float32) @ (matrix != 0).astype(np.float32) > 0
            best.add(batch[key].to_numpy(), scores, open_)
        query, keys, score = best.rows()
        if len(query):
            yield pd.DataFrame({"query_id": query, key: keys, "score": score})

    return run
